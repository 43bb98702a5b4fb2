"""Page files of documents: a data source that plans its partitions from listings, and a writer.

A page has a text file and an image file. For each there are six places, of which the first that exists counts (:func:`places`). The source lists the root and its
folders ``texts`` and ``images`` once, on the driver, names only; a document is there if any file bears its name and a page's number. It deals
documents out to tasks by their number of pages, and tasks read the text files that were chosen. Filters on ``doc_id`` and ``page_index`` are applied to the
listing, so files of other documents and pages are never opened.

Defined results: a page without a text file has a null text, bytes that aren't UTF-8 become replacement marks; an absent folder is an empty one; the files
``page_<n>``, which bear no document's name, serve every document that lacks its own.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "doc_id string, page_index int, text_path string, image_path string, text string"
_NAMED = re.compile(r"^(.+)_(\d+)\.(txt|png)$", re.DOTALL)
#: Pages that a task reads.
PAGES = 2000


def places(doc: str, page: int, kind: str) -> list[str]:
    """Where a page's file may lie below the root, most wanted first: ``kind`` is txt or png. A document's name loses ``.pdf``."""
    name, folder = doc.removesuffix(".pdf"), {"txt": "texts", "png": "images"}[kind]
    own = [f"{name}_{page}.{kind}", f"{name}_{page:03d}.{kind}"]
    return [*own, *(f"{folder}/{o}" for o in own), f"{folder}/page_{page}.{kind}", f"{folder}/page_{page:03d}.{kind}"]


def _opened(folder: str):
    """(pyarrow file system, path in it)."""
    from pyarrow import fs

    url = urlparse(folder)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(url.path)
    return fs.FileSystem.from_uri(folder)


def listed(root: str) -> set[str]:
    """Names of the files in the root and its two folders, relative to the root."""
    from pyarrow import fs

    store, path = _opened(root)
    out = set()
    for folder in ("", "texts/", "images/"):
        found = store.get_file_info(fs.FileSelector(f"{path}/{folder}".rstrip("/"), allow_not_found=True))
        out |= {folder + f.base_name for f in found if f.type == fs.FileType.File}
    return out


def _text(root: str, path: str) -> str:
    store, base = _opened(root)
    with store.open_input_stream(f"{base}/{path}") as f:
        return f.readall().decode("utf-8", "replace")


class Pages(InputPartition):
    """Pages of a task: (doc, page, text path, image path)."""

    def __init__(self, pages: list[tuple]):
        self.pages = pages


class PageReader(DataSourceReader):
    def __init__(self, root: str, texts: bool):
        self.root, self.texts, self.docs, self.tests = root, texts, None, []

    def pushFilters(self, filters):
        """Takes tests of document and page; others are left to Spark."""
        ops = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("doc_id",):
                wanted = set(f.value if isinstance(f, In) else [f.value])
                self.docs = wanted if self.docs is None else self.docs & wanted
            elif type(f) in ops and f.attribute == ("page_index",) and f.value is not None:
                self.tests.append((ops[type(f)], f.value))
            else:
                yield f

    def partitions(self):
        names = listed(self.root)
        pages: dict[str, set[int]] = defaultdict(set)
        for n in names:
            m = _NAMED.match(n.rsplit("/", 1)[-1])
            if m and not (m[1] == "page" and "/" in n):
                pages[m[1]].add(int(m[2]))
        out, group = [], []
        for doc in sorted(pages if self.docs is None else self.docs & pages.keys()):
            for page in sorted(pages[doc]):
                if all(test(page, value) for test, value in self.tests):
                    text, image = (next((p for p in places(doc, page, kind) if p in names), None) for kind in ("txt", "png"))
                    group.append((doc, page, text, image))
            if len(group) >= PAGES:
                out.append(Pages(group))
                group = []
        return [*out, Pages(group)]

    def read(self, partition):
        for doc, page, text, image in partition.pages:
            yield doc, page, text, image, _text(self.root, text) if text and self.texts else None


class PageStore(DataSource):
    """``spark.read.format("page_store").load(root)``; option ``texts`` false leaves texts unread."""

    @classmethod
    def name(cls):
        return "page_store"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PageReader(self.options["path"], str(self.options.get("texts", "true")).lower() == "true")


def read(spark: SparkSession, root: str, texts: bool = True) -> DataFrame:
    """(doc_id, page_index, text_path, image_path, text) of all pages that have a file."""
    spark.dataSource.register(PageStore)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("page_store").option("texts", texts).load(root)


def contents(spark: SparkSession, root: str, most_pages: int | None = None, most_chars: int | None = None) -> DataFrame:
    """(doc_id, page_index, image_path, text) of the pages before each document's first page without an image; line ends are blanks."""
    pages = read(spark, root)
    if most_pages is not None:
        pages = pages.filter(F.col("page_index") < most_pages)
    w = Window.partitionBy("doc_id").orderBy("page_index")
    pages = pages.filter("image_path IS NOT NULL").withColumn("_n", F.row_number().over(w) - 1).filter("page_index = _n").drop("_n")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n|\r|\n", " ")
    return pages.select("doc_id", "page_index", "image_path", (text if most_chars is None else F.left(text, F.lit(most_chars))).alias("text"))


def requested(spark: SparkSession, root: str, requests: DataFrame) -> DataFrame:
    """``requests`` (doc_id, page_index) with page_text, the paths, and whether there are any. A document without files of its own is served by ``page_<n>``."""
    names = [n for n in sorted(listed(root)) if re.match(r"(texts|images)/page_\d+\.(txt|png)$", n)]
    numbers = sorted({int(re.search(r"_(\d+)\.", n)[1]) for n in names})
    first = lambda page, kind: next((p for p in places("", page, kind)[4:] if p in names), None)
    shared = spark.createDataFrame([(i, first(i, "txt"), first(i, "png")) for i in numbers], "page_index int, _txt string, _png string")
    pages = read(spark, root)
    asked = requests.withColumn("_doc", F.regexp_replace("doc_id", r"\.pdf$", ""))
    found = asked.join(pages.withColumnsRenamed({"doc_id": "_doc"}), ["_doc", "page_index"], "left")
    if numbers:
        read_text = F.udf(lambda path: None if path is None else _text(root, path), "string").asNondeterministic()
        found = found.join(F.broadcast(shared), "page_index", "left")  # a row a page number
        late = F.when(F.col("text_path").isNull(), F.col("_txt"))
        found = found.withColumns({"text": F.coalesce("text", read_text(late)), "text_path": F.coalesce("text_path", "_txt"), "image_path": F.coalesce("image_path", "_png")})
    there = lambda c: F.col(c).isNotNull()
    return found.select("doc_id", "page_index", F.col("text").alias("page_text"), F.col("text_path").alias("page_text_path"), F.col("image_path").alias("page_image_path"), there("text_path").alias("has_page_text"), there("image_path").alias("has_page_image"))


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, pages): the sorted numbers of each document's pages that have a file."""
    return read(spark, root, texts=False).groupBy("doc_id").agg(F.array_sort(F.collect_set("page_index")).alias("pages"))


def write(files: DataFrame, root: str) -> int:
    """Write ``files`` (path below the root, content binary), each under another name first; returns their number."""
    def put(batches):
        store, base = _opened(root)
        n = 0
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                folder = f"{base}/{path}".rsplit("/", 1)[0]
                store.create_dir(folder, recursive=True)
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as f:
                    f.write(content)
                store.move(draft, f"{base}/{path}")
                n += 1
        yield pd.DataFrame({"n": [n]})

    return files.select("path", "content").mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0
