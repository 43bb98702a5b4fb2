"""Extractors: atomic table cells from line layouts, code/name lists, page text from HTML."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import compact, number_in

#: Fixed values.
VALUE = r"(?i)(?<![A-Za-z0-9-])\(?\s*-?\$?\s*\d[\d,]*(?:\.\d+)?\s*\)?\s*(?:%|percent|percentage|bps|bp|million|billion|thousand|m\b|bn\b)?"
YEAR = r"^(19|20)\d{2}$"
LOOK_AHEAD, LOOK_BACK, MOST_VALUES, MOST_CELLS = 14, 30, 4, 8


def _is_value(t: Column) -> Column:
    return t.rlike(VALUE)


def _words(t: Column) -> Column:
    return F.size(F.split(t, " "))


def atomic_cells(lines: DataFrame, keys: list[str], most: int = MOST_CELLS) -> DataFrame:
    """(keys, row_label, column_label, value_text, row_index, column_index, confidence, cell_rank) of each page.

    ``lines``: (keys, line_index, line). A label line that at least two value lines follow makes a row; its
    headers are the last year lines before it, or else the last short lines. All by windows over the page's lines.
    """
    page = Window.partitionBy(*keys)
    by_line = page.orderBy("line_index")
    t = F.col("line")
    rows = lines.withColumns(
        {
            "is_value": _is_value(t),
            "is_year": t.rlike(YEAR),
            "is_currency": t.rlike(r"^\$+$"),
        }
    )
    rows = rows.withColumn("is_header", F.col("is_year") | (~F.col("is_value") & ~F.col("is_currency") & (_words(t) <= 5) & t.rlike(r"(?U)\p{L}")))
    ahead = F.collect_list(F.struct("line", "is_value", "is_year", "is_currency")).over(by_line.rowsBetween(1, LOOK_AHEAD))
    behind = by_line.rowsBetween(-LOOK_BACK, -1)
    rows = rows.withColumn("ahead", ahead)
    rows = rows.withColumn("years", F.collect_list(F.when(F.col("is_year"), t)).over(behind))
    rows = rows.withColumn("shorts", F.collect_list(F.when(F.col("is_header"), t)).over(behind))
    label = (
        ~F.col("is_value") & ~F.col("is_currency") & (F.length("line") >= 2) & (F.length("line") <= 180)
        & t.rlike(r"(?U)\p{L}") & (_words(t) <= 24) & ~(t.endswith(".") & (_words(t) > 14))
    )
    # Values after a label: a fold that stops at the first other line.
    empty = F.struct(F.array().cast("array<string>").alias("v"), F.lit(False).alias("stop"), F.lit(True).alias("years"))

    def step(s, x):
        full = F.size(s["v"]) >= MOST_VALUES
        over = s["stop"] | full | (~x["is_currency"] & ((x["is_year"] & (F.size(s["v"]) >= 2)) | ~x["is_value"]))
        take = ~over & ~x["is_currency"]
        return F.struct(
            F.when(take, F.concat(s["v"], F.array(x["line"]))).otherwise(s["v"]).alias("v"),
            over.alias("stop"),
            (s["years"] & (~take | x["is_year"])).alias("years"),
        )

    rows = rows.filter(label).withColumn("fold", F.aggregate("ahead", empty, step))
    rows = rows.filter((F.size("fold.v") >= 2) & ~F.col("fold.years")).withColumn("vals", F.col("fold.v"))
    n = F.size("vals")
    last = lambda c: F.slice(c, F.size(c) - n + 1, n)
    heads = F.when(F.size("years") >= n, last(F.col("years"))).when(F.size("shorts") >= n, last(F.col("shorts")))
    rows = rows.withColumn("heads", heads).filter("heads IS NOT NULL")
    numbered = F.transform(
        "heads",
        lambda h, i: F.concat(
            h,
            F.when(
                F.size(F.filter(F.slice("heads", F.lit(1), i), lambda x: x == h)) > 0,
                F.concat(F.lit(" #"), (F.size(F.filter(F.slice("heads", F.lit(1), i), lambda x: x == h)) + 1).cast("string")),
            ).otherwise(""),
        ),
    )
    rows = rows.withColumn("row_index", F.row_number().over(by_line) - 1)
    cells = rows.select(*keys, "row_index", F.substring("line", 1, 180).alias("row_label"), numbered.alias("heads"), "vals", F.posexplode("vals").alias("column_index", "value_line"))
    rest = F.trim(F.regexp_replace(compact(F.regexp_replace("value_line", VALUE, " ")), r"^[:\-–—,;()\[\]\s]+|[:\-–—,;()\[\]\s]+$", ""))
    own = (rest != "") & (F.length(rest) <= 60) & rest.rlike(r"(?U)\p{L}") & (_words(rest) <= 6)
    value = compact(F.replace(F.regexp_extract("value_line", f"({VALUE})", 1), F.lit("$"), F.lit("")))
    source = F.concat_ws(" ", F.col("row_label"), F.array_join("vals", " "))
    cells = cells.select(
        *keys, "row_index", "column_index", "row_label", F.when(own, rest).otherwise(F.get("heads", F.col("column_index"))).alias("column_label"), value.alias("value_text"), source.alias("source_text")
    )
    same = Window.partitionBy(*keys, F.lower("row_label"), F.lower("column_label"), F.lower("value_text")).orderBy("row_index", "column_index")
    cells = cells.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")
    cells = cells.withColumn("_n", F.row_number().over(page.orderBy("row_index", "column_index"))).filter(F.col("_n") <= 4 * most).drop("_n")
    words = _words(F.col("row_label"))
    confidence = (
        F.when(F.col("column_label").rlike(YEAR), 4.0).when(~F.col("column_label").startswith("value_"), 3.0).otherwise(0.0)
        + F.when(F.col("value_text").contains("%"), 2.0).otherwise(0.0)
        + F.when(number_in(F.col("value_text")).isNotNull(), 1.0).otherwise(0.0)
        + F.when(words <= 8, 2.0).when(words <= 14, 1.0).otherwise(0.0)
        + F.when(F.length("source_text") <= 160, 1.0).otherwise(0.0)
        + F.when(F.col("column_index") == 0, 0.4).otherwise(0.0)
    )
    cells = cells.withColumn("confidence", F.round(confidence, 4))
    best = page.orderBy(F.desc("confidence"), "row_index", "column_index", "row_label", "column_label")
    return cells.withColumn("cell_rank", F.row_number().over(best)).filter(F.col("cell_rank") <= most)


_GROUP = re.compile(r"(.+?)\s*\(([A-Z]{2,4})\)")
_CODE = re.compile(r"[A-Z]{2,4}\d{2,4}")
_ITEM = re.compile(r"(\d+)\.\s*(.*)", re.S)


def pairs_in(text: str, most: int = 80) -> list[tuple[str, str, str, str, str]]:
    """(code, name, group, group code, ordinal) of a page that lists numbered names, each followed by its code."""
    out, seen = [], set()
    group = ("", "")
    ordinal, name = "", []
    for line in (" ".join(x.split()) for x in text.splitlines()):
        if not line:
            continue
        code, item, head = _CODE.fullmatch(line), _ITEM.fullmatch(line), _GROUP.fullmatch(line)
        if head and not code:
            group, ordinal, name = (head[1].strip(), head[2]), "", []
        elif item:
            ordinal, name = item[1], [item[2].strip()] if item[2].strip() else []
        elif code:
            whole = " ".join(name)
            key = (line.lower(), whole.lower())
            if whole and group[0] and key not in seen and len(out) < most:
                seen.add(key)
                out.append((line, whole, *group, ordinal))
            ordinal, name = "", []
        elif ordinal:
            name.append(line)
    return out


def code_names(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, code, name, group_label, group_code, ordinal): the state runs from line to line, so pages go to Python whole."""

    def run(batches):
        for b in batches:
            rows = [(k, *p) for k, t in zip(b[key], b[text], strict=True) if t for p in pairs_in(t)]
            yield pd.DataFrame(rows, columns=[key, "code", "name", "group_label", "group_code", "ordinal"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, text).mapInPandas(run, f"{key} {kind}, code string, name string, group_label string, group_code string, ordinal string")


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags dropped, common entities read, blanks compacted."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return compact(t)


def html_title(html: Column) -> Column:
    return compact(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
