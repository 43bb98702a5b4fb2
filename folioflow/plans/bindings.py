"""Base relations of the registered queries over the test tables, in Spark and as SQL fragments.

A document of four pages is four consecutive rows of ``documents``; a candidate pool is a ``source``; queries are the
``benchmark`` items, item i asking the pool ``src{i % 20}``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import scoring
from folioflow.functions.text import STOPWORDS, compact, tokens
from folioflow.operators import artifacts as A
from folioflow.operators import pages as P
from folioflow.operators import retrieval as R
from folioflow.sources.readers import spread


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def doc_pages(spark, sf_dir, only: DataFrame | None = None) -> DataFrame:
    """Pages; with ``only`` (number) just those, chosen before anything is made of them."""
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    d = spread(d) if only is None else d.join(only.select(F.col("number").alias("doc_id")), "doc_id", "left_semi")
    return d.select(n.alias("number"), F.concat(F.lit("d"), F.floor(n / 4).cast("string")).alias("doc_id"), F.pmod(n, F.lit(4)).cast("int").alias("page_index"), "text")


def blocks(spark, sf_dir, only: DataFrame | None = None) -> DataFrame:
    return P.chunks(doc_pages(spark, sf_dir, only)).drop("text")


def artifacts(spark, sf_dir, only: DataFrame | None = None) -> DataFrame:
    return A.compile_blocks(blocks(spark, sf_dir, only))


def classified(spark, sf_dir, only: DataFrame | None = None) -> DataFrame:
    return A.classify_locators(artifacts(spark, sf_dir, only))


def items(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("source").alias("pool"), F.col("doc_id").alias("item"), "text")


def asked(spark, sf_dir) -> DataFrame:
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(i.alias("query"), F.concat(F.lit("src"), F.pmod(i, F.lit(20)).cast("string")).alias("pool"), "text")


def text_branch(spark, sf_dir, k: int = 10) -> DataFrame:
    top = R.bm25_topk(asked(spark, sf_dir), items(spark, sf_dir), k)
    return top.select("query", F.lit("text").alias("branch"), (F.col("rank") - 1).alias("rank"), F.col("item").alias("page_index"), "score")


def image_branch(spark, sf_dir, k: int = 10) -> DataFrame:
    """A second, text-free ranking of the pool."""
    q, it = asked(spark, sf_dir).select("query", "pool"), items(spark, sf_dir).select("pool", "item")
    mixed = F.pmod(F.col("item") * 31 + F.col("query") * 17, F.lit(97))
    s = q.join(it, "pool").select("query", "item", (1.0 - mixed / 97.0).alias("score"))
    top = R.ranked(s, ["query"], [F.desc("score"), F.asc("item")], k)
    return top.select("query", F.lit("image").alias("branch"), (F.col("rank") - 1).alias("rank"), F.col("item").alias("page_index"), F.round("score", 6).alias("score"))


def branches(spark, sf_dir, k: int = 10) -> DataFrame:
    return text_branch(spark, sf_dir, k).unionByName(image_branch(spark, sf_dir, k))


def artifact_scores(spark, sf_dir, pages: DataFrame) -> DataFrame:
    """(query, page_index, score, weight) of the eligible artifacts on asked pages: the share of the query's words that each holds."""
    e = A.eligibility(classified(spark, sf_dir, pages.select(F.col("page_index").alias("number")))).filter("reason = 'eligible'")
    e = e.select(F.col("number").alias("page_index"), tokens(F.col("content")).alias("_held"), "weight")
    q = asked(spark, sf_dir).select("query", tokens(F.col("text")).alias("_asked"))
    return pages.join(e, "page_index").join(q, "query").select("query", "page_index", F.round(scoring.overlap(F.col("_asked"), F.col("_held")), 6).alias("score"), "weight")


def gold(spark, sf_dir) -> DataFrame:
    """Good documents of a query's pool whose number leaves the query's remainder by 7."""
    lab = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("item"))
    j = asked(spark, sf_dir).select("query", "pool").join(items(spark, sf_dir).select("pool", "item"), "pool")
    return j.filter(F.pmod("item", F.lit(7)) == F.pmod("query", F.lit(7))).join(lab, "item", "left_semi").select("query", "item")


#: The questions' templates; ``#`` stands for the item's number modulo five, ``@`` for its text. One for each way that a question is decided.
TEMPLATES = [
    "What is the total for code AR0#: @",
    "Which metric period",
    "Who revised the document version #: @",
    "Show the chart of #: @",
    "What is the return on asset",
    "Zqxw vkjh",
    "What is the total of children who are older",
    "Do higher income seniors go online in 2019",
]


def questions(spark, sf_dir) -> DataFrame:
    """(query, doc_id, question): item i asks document i."""
    i = F.col("item_id")
    text = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.pmod(i, F.lit(len(TEMPLATES))) + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("#"), F.pmod(i, F.lit(5)).cast("string")), F.lit("@"), F.col("text"))
    return table(spark, sf_dir, "benchmark").select(i.alias("query"), F.concat(F.lit("d"), i.cast("string")).alias("doc_id"), text.alias("question"))


def asked_pages(spark, sf_dir) -> DataFrame:
    """(number): the pages of the documents that questions ask; chosen before anything is made of pages."""
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(F.explode(F.sequence(4 * i, 4 * i + 3)).alias("number")).distinct()


def contexts(spark, sf_dir) -> DataFrame:
    """(query, page_text): the pages of a question's document, whole; each third document opens with a heading."""
    shown = compact(F.coalesce("text", F.lit("")))
    pages = doc_pages(spark, sf_dir, asked_pages(spark, sf_dir)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", shown.alias("t")))).alias("p"))
    heading = F.when(F.pmod("query", F.lit(3)) == 0, "Net income and total assets of children and older people. ").otherwise("")
    q = questions(spark, sf_dir).join(pages, "doc_id")
    return q.select("query", F.concat(heading, F.array_join(F.transform("p", lambda x: x["t"]), " ")).alias("page_text"))


def deduped(df: DataFrame, by: str, order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter("_n = 1").drop("_n")


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9%]+'), lambda t: t NOT IN ({_STOP}))"


BLOCKS = r"""
raw AS (SELECT doc_id AS number, 'd' || (doc_id // 4) AS doc_id, CAST(doc_id % 4 AS INT) AS page_index, text,
  unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS b FROM documents),
blk AS (SELECT number, doc_id, page_index, CAST(b AS INT) AS block_no, CAST(b * 1000 AS INT) AS char_start,
  CAST(b * 1000 + length(substr(text, b * 1000 + 1, 1000)) AS INT) AS char_end,
  regexp_replace(substr(text, b * 1000 + 1, 1000), '^\s+|\s+$', '', 'g') AS block_text FROM raw),
blocks AS (SELECT * FROM blk WHERE block_text <> '')"""

ARTIFACTS = (
    BLOCKS
    + r""",
a0 AS (SELECT *, ['text_span', 'numeric_fact', 'table', 'table_cell', 'figure', 'caption', 'visual_region', 'visual_observation',
    'section_header'][(number * 7 + block_no * 3 + copy * 5) % 9 + 1] AS t
  FROM (SELECT *, unnest(CASE WHEN (number + block_no) % 6 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM blocks)),
art AS (SELECT number, doc_id, page_index, block_no, printf('a%06d_%03d', number, block_no) || CASE WHEN copy = 1 THEN '_2' ELSE '' END AS artifact_id,
  printf('%s#p%03d', doc_id, page_index) AS page_id, t AS artifact_type,
  CASE t WHEN 'numeric_fact' THEN 'numeric' WHEN 'table' THEN 'table' WHEN 'table_cell' THEN 'table' WHEN 'figure' THEN 'image'
    WHEN 'visual_region' THEN 'image' WHEN 'visual_observation' THEN 'image' WHEN 'section_header' THEN 'layout' ELSE 'text' END AS modality,
  CASE WHEN number % 11 = 0 THEN 'mock ' ELSE '' END || block_text AS content,
  printf('p%d_text_%03d', number, block_no) AS source_id,
  CASE (number + block_no) % 4 WHEN 0 THEN 'full_page_image' WHEN 3 THEN 'table_cell' ELSE 'text_block' END AS anchor_type,
  number % 5 = 0 AS has_bbox, char_start, char_end,
  CASE WHEN t IN ('table', 'table_cell') AND number % 5 <> 1 THEN 't' || block_no END AS table_id,
  CASE WHEN t = 'table_cell' AND number % 4 <> 1 THEN CAST(number % 7 AS VARCHAR) END AS row_index,
  CASE WHEN t = 'table_cell' AND number % 7 <> 2 THEN CAST(number % 3 AS VARCHAR) END AS column_index,
  CASE WHEN t IN ('figure', 'visual_region', 'caption') AND number % 2 = 0 THEN 'f' || block_no END AS figure_id,
  CASE WHEN t = 'caption' AND number % 7 <> 1 THEN 'c' || block_no END AS caption_id,
  CASE WHEN t = 'section_header' AND number % 4 <> 3 THEN 's' || block_no END AS section_id,
  CAST((number * 13 + block_no) % 10 AS DOUBLE) / 10.0 AS confidence,
  CASE WHEN t IN ('numeric_fact', 'table_cell', 'table') AND number % 4 <> 2 THEN CASE WHEN number % 4 = 1 THEN 'AR0' || (number // 4 % 5) ELSE CAST(number AS VARCHAR) END END AS value_text,
  CASE WHEN number % 3 <> 2 THEN CASE WHEN number % 2 = 0 THEN 'net income' ELSE 'metric' END END AS row_label,
  CASE WHEN number % 5 <> 3 THEN CASE WHEN number % 4 = 1 THEN 'total assets' ELSE 'period' END END AS column_label,
  CASE WHEN number % 2 = 0 THEN 'anchored' ELSE 'schema_valid' END AS status FROM a0)"""
)

CLASSIFIED = (
    ARTIFACTS
    + r""",
k0 AS (SELECT *, list_filter([CASE WHEN anchor_type = 'full_page_image' THEN 'full_page_anchor' ELSE 'source_block' END,
    CASE WHEN has_bbox THEN 'bbox' END, CASE WHEN anchor_type <> 'full_page_image' THEN 'text_offset' END,
    CASE WHEN table_id IS NOT NULL AND row_index IS NOT NULL AND column_index IS NOT NULL THEN 'table_cell' END,
    CASE WHEN artifact_type IN ('figure', 'visual_region') AND figure_id IS NOT NULL AND has_bbox THEN 'figure_region' END,
    CASE WHEN artifact_type = 'caption' AND caption_id IS NOT NULL THEN 'caption_block' END,
    CASE WHEN artifact_type = 'section_header' AND section_id IS NOT NULL THEN 'section_block' END], lambda x: x IS NOT NULL) AS kinds FROM art),
k1 AS (SELECT *, list_contains(kinds, 'text_offset') AS ht, list_contains(kinds, 'table_cell') AS hc, list_contains(kinds, 'bbox') AS hb,
  list_contains(kinds, 'source_block') AS hs, list_contains(kinds, 'figure_region') AS hf, list_contains(kinds, 'full_page_anchor') AS hp FROM k0),
k2 AS (SELECT *, source_id <> '' AS source_anchored, CASE artifact_type WHEN 'text_span' THEN ht WHEN 'numeric_fact' THEN ht OR hc
  WHEN 'table_cell' THEN hc WHEN 'table' THEN table_id IS NOT NULL AND (hb OR hs) WHEN 'figure' THEN hf OR (figure_id IS NOT NULL AND (hb OR hs))
  WHEN 'caption' THEN list_contains(kinds, 'caption_block') OR hb OR hs WHEN 'visual_region' THEN hf OR hb
  WHEN 'visual_observation' THEN hb OR hs OR hf ELSE list_contains(kinds, 'section_block') OR ht OR hs END AS element_locatable FROM k1),
cls AS (SELECT *, source_anchored AND element_locatable AND NOT (hp AND NOT (hb OR hs OR hc OR hf)) AS proof_trace_eligible,
  coalesce(CASE WHEN element_locatable THEN list_filter(['table_cell', 'figure_region', 'caption_block', 'section_block', 'text_offset',
    'bbox', 'source_block'], lambda x: list_contains(kinds, x))[1] END, CASE WHEN hp THEN 'full_page_anchor' WHEN hs THEN 'source_block' ELSE 'none' END)
    AS locator_kind, len(list_filter(kinds, lambda x: x <> 'full_page_anchor' AND x <> 'section_block')) > 0 AS strong FROM k2)"""
)

POOLS = f"""
q AS (SELECT item_id AS query, 'src' || (item_id % 20) AS pool, text FROM benchmark),
it AS (SELECT source AS pool, doc_id AS item, {sql_tokens("text")} AS terms FROM documents),
st AS (SELECT pool, count(*) AS n, avg(len(terms)) AS mean_length FROM it GROUP BY pool),
po AS (SELECT pool, item, len(terms) AS length, unnest(terms) AS term FROM it),
tf AS (SELECT pool, item, length, term, count(*) AS tf FROM po GROUP BY ALL),
df AS (SELECT pool, term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT query, pool, unnest({sql_tokens("text")}) AS term FROM q),
qf AS (SELECT query, pool, term, count(*) AS qtf FROM qt GROUP BY ALL),
sc AS (SELECT query, item, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
    / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean_length))), 6) AS score
  FROM qf JOIN df USING (pool, term) JOIN st USING (pool) JOIN tf USING (pool, term) GROUP BY query, item),
every AS (SELECT query, it.item, coalesce(score, 0.0) AS score FROM q JOIN it USING (pool) LEFT JOIN sc USING (query, item)),
ord AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM every)"""

BRANCHES = (
    POOLS
    + """,
im AS (SELECT query, item, round(1.0 - ((item * 31 + query * 17) % 97) / 97.0, 6) AS score,
  row_number() OVER (PARTITION BY query ORDER BY (item * 31 + query * 17) % 97, item) AS rank FROM q JOIN it USING (pool)),
br AS (SELECT query, 'text' AS branch, CAST(rank - 1 AS INT) AS rank, item AS page_index, score FROM ord WHERE rank <= 10
  UNION ALL SELECT query, 'image', CAST(rank - 1 AS INT), item, score FROM im WHERE rank <= 10)"""
)



def sql_artifact_scores(pages: str, name: str = "asc_") -> str:
    """(query, page_index, raw): the best weighted share of a query's words in an eligible artifact of an asked page; needs POOLS and ``elig``."""
    return f"""{name}q AS (SELECT query, list_distinct({sql_tokens("text")}) AS asked FROM q), {name}e AS (SELECT number AS page_index, list_distinct({sql_tokens("content")}) AS held, weight FROM elig WHERE reason = 'eligible'),
{name} AS (SELECT query, page_index, max(round(CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, held)) / len(asked) ELSE 0.0 END, 6) * weight) AS raw
  FROM ({pages}) JOIN {name}e USING (page_index) JOIN {name}q USING (query) GROUP BY ALL)"""


GOLD = """
gold AS (SELECT query, item FROM q JOIN it USING (pool) WHERE item % 7 = query % 7
  AND item IN (SELECT doc_id FROM labels WHERE quality = 1))"""

QUESTIONS = f"""
qs AS (SELECT item_id AS query, 'd' || item_id AS doc_id,
  replace(replace([{", ".join(f"'{t}'" for t in TEMPLATES)}][item_id % {len(TEMPLATES)} + 1], '#', CAST(item_id % 5 AS VARCHAR)), '@', text) AS question FROM benchmark)"""

CONTEXTS = r"""
cx AS (SELECT query, CASE WHEN query % 3 = 0 THEN 'Net income and total assets of children and older people. ' ELSE '' END || page_text AS page_text FROM qs
  JOIN (SELECT 'd' || (doc_id // 4) AS doc_id, string_agg(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ' ORDER BY doc_id % 4) AS page_text FROM documents GROUP BY 1) USING (doc_id))"""
