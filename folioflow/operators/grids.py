"""Cells of HTML tables, on the grid that row and column spans make, with their labels.

A page is read once, tag by tag; a table inside a cell is a table of its own, whose text its outer cell lacks. A cell goes to the first free column of its row and covers its
spans; spans end with the table, a row span of 0 goes to its end, and a column span is at most 1000, as browsers have it. The rows before the first that
holds a ``td`` are headers (if all have one, the first row is). A cell's column label is what the header rows say in its column, and its row label what the first column
says in its row, both without repeats.

Defined results: null and empty pages have no tables; cells without text are places without a row of the result; a page that breaks off counts as far as it
goes; tables are numbered from 0 in the order in which they begin.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)(table|tr|td|th|script|style)\b([^>]*)>|<!--.*?-->|<[a-zA-Z/!][^>]*>", re.IGNORECASE | re.DOTALL)
_SPAN = {k: re.compile(rf"\b{k}\s*=\s*[\"']?\s*(\d+)", re.IGNORECASE) for k in ("rowspan", "colspan")}
_INLINE = re.compile(r"</?(?:a|abbr|b|bdi|bdo|big|cite|code|em|font|i|kbd|mark|q|s|samp|small|span|strong|sub|sup|tt|u|var|wbr)\b", re.IGNORECASE)
MOST_COLUMNS = 1000
_CELL = "table_no int, row_index int, column_index int, row_label string, column_label string, value_text string"


def tables_of(page: str) -> list[list[list[tuple[str, bool, int, int]]]]:
    """Tables as lists of rows of (text, whether a header, row span, column span)."""
    out, open_, silent, at = [], [], None, 0

    def say(text):
        if open_ and open_[-1]["cell"] is not None and silent is None:
            open_[-1]["cell"][0].append(unescape(text))

    for m in _TAG.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        closing, tag, rest = m[1], (m[2] or "").lower(), m[3] or ""
        if tag in ("script", "style"):
            silent = None if closing else tag
        elif tag == "table" and not closing:
            table = {"rows": [], "cell": None}
            out.append(table)
            open_.append(table)
        elif not open_ or silent:
            continue
        elif tag == "table":
            open_.pop()
        elif tag in ("tr", "td", "th"):
            now = open_[-1]
            now["cell"] = None
            if not closing:
                if tag == "tr" or not now["rows"]:
                    now["rows"].append([])
                if tag != "tr":
                    span = [int(s[1][:6]) if (s := _SPAN[k].search(rest)) else 1 for k in ("rowspan", "colspan")]
                    now["cell"] = ([], tag == "th", span[0], min(max(span[1], 1), MOST_COLUMNS))
                    now["rows"][-1].append(now["cell"])
        elif m[0][:2] != "<!" and not _INLINE.match(m[0]):
            say(" ")
    say(page[at:])
    return [[[(" ".join("".join(t).split()), h, r, c) for t, h, r, c in row] for row in table["rows"]] for table in out]


def grid(rows: list) -> list[dict[int, tuple[str, bool, bool]]]:
    """Each row's columns: (text, whether a header, whether the cell begins here)."""
    out: list[dict] = [{} for _ in rows]
    for i, row in enumerate(rows):
        col = 0
        for text, head, down, across in row:
            while col in out[i]:
                col += 1
            for r in range(i, len(rows) if down == 0 else min(len(rows), i + down)):
                for c in range(col, col + across):
                    out[r].setdefault(c, (text, head, r == i and c == col))
            col += across
    return out


def cells_of(page: str) -> list[tuple]:
    found = []
    for no, rows in enumerate(tables_of(page)):
        g = grid(rows)
        heads = next((i for i, row in enumerate(rows) if any(not h for _, h, _, _ in row)), len(rows)) or 1
        once = lambda texts: " ".join(dict.fromkeys(t for t in texts if t))
        labels: dict[int, str] = {}
        for i, row in enumerate(g[heads:], heads):
            side = row.get(0, ("",))[0]
            for c in sorted(row):
                text, _, begins = row[c]
                if begins and text and c:
                    if c not in labels:
                        labels[c] = once(h[c][0] for h in g[:heads] if c in h)
                    found.append((no, i, c, side or None, labels[c] or None, text))
    return found


def table_cells(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """(keys, table_no, row_index, column_index, row_label, column_label, value_text) of all tables of whole pages."""
    fields = [f.split(" ") for f in _CELL.split(", ")]

    @F.pandas_udf("array<struct<" + ",".join(f"{n}:{t}" for n, t in fields) + ">>")
    def run(html: pd.Series) -> pd.Series:
        names = [n for n, _ in fields]
        return pd.Series([[dict(zip(names, c, strict=True)) for c in cells_of(h)] for h in html], dtype=object)

    return pages.select(*keys, F.explode(run(F.coalesce(F.col(html), F.lit("")))).alias("x")).select(*keys, "x.*")
