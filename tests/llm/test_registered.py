"""The registered queries and the pipeline on the smallest tables: against their SQL, or against brute force."""

import hashlib
import os
import re
import sys
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))

from test_dedup import plain_components, plain_fingerprint
from test_records import plain_quality, plain_spans

import corpus_pipeline
from folioflow.llm import common, decontaminate, pii, quality, queries
from verify import TABLES, compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "") for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text or "") for r in common.table(spark, SF, "benchmark").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, con, name):
    said = compare(spark, con, name, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert said.startswith("same"), said


def rows(spark, name, *cols):
    return sorted(tuple(r[c] for c in cols) for r in queries.QUERIES[name](spark, SF).collect())


def test_op1(spark, docs):
    library = Tokenizer.from_file(common.tokenizer_json("word_bpe_49k.json"))
    at, want = 0, []
    for i, t in sorted(docs):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert rows(spark, "op1_token_blocks", "doc_id", "start", "n_tokens", "ids_crc32") == want


def found_items(text, items):
    """(item, edits) of all items against a whole text, by Myers' distance without pieces."""
    t, out = decontaminate.normal(text), []
    for i, item in items:
        x = decontaminate.normal(item)
        if len(x) < decontaminate.MIN_CHARS:
            out += [(i, 0)] * (bool(x) and f" {x} " in f" {t} ")
        elif t and (hit := decontaminate.myers(x, t, len(x) // decontaminate.CHARS_PER_EDIT)):
            out.append((i, hit[0]))
    return out


def test_op2(spark, docs, items):
    want = sorted((d, i, n) for d, t in docs for i, n in found_items(t, items))
    assert rows(spark, "op2_decontaminate", "doc_id", "item_id", "edits") == want and want


def test_op5(spark, docs):
    got = rows(spark, "op5_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = []
    for i, t in docs:
        spans = plain_spans(t)
        want.append((i, *[sum(s[0] == k for s in spans) for k in pii.KINDS], hashlib.sha256(pii.spelled(spans).encode()).hexdigest()))
    assert got == sorted(want)


def test_op7(spark, docs):
    fps = [plain_fingerprint(t) for _, t in docs]
    group = plain_components((docs[i][0], docs[j][0]) for i in range(len(docs)) for j in range(i + 1) if (fps[i] ^ fps[j]).bit_count() <= 4)
    want = sorted((d, f"{fp:016x}", group[d]) for (d, _), fp in zip(docs, fps, strict=True))
    assert rows(spark, "op7_simhash", "doc_id", "fingerprint", "component_id") == want


def test_op8(spark, docs):
    library = Tokenizer.from_file(common.tokenizer_json("byte_bpe_50k.json"))
    want = []
    for i, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert rows(spark, "op8_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


# ---- the pipeline, stage by stage, in plain Python


def good(text):
    """Whether the quality rules keep a text."""
    n, chars, symbols, dup, _, failed = plain_quality(text)
    if failed:
        return False
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in text.split("\n"))
    stop = sum(w.lower() in quality.STOP_WORDS for w in words)
    return 2.5 <= chars / n <= 12.0 and symbols / n <= 0.10 and stop / n >= 0.04 and dup / max(1, lines) <= 0.45


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def first_of_each(rows):
    """The first row by (id, nulls last) of each group of rows that five-word sets link at 0.8."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i + 1) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return [rows[i] for i in sorted(set(plain_components(near).values()))]


def through_all_stages(docs, items, model):
    kept = [r for r in first_of_each([r for r in docs if good(r[1])]) if not found_items(r[1], items)]
    library = Tokenizer.from_file(common.tokenizer_json("byte_bpe_50k.json"))
    out = []
    for i, t in kept:
        ((_, spans),) = pii.find(model, [t])
        ids = library.encode(pii.redact(t, spans), add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()))
    return sorted(out, key=str)


def test_pipeline_on_the_tables(spark, docs, items):
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()), key=str)
    # the model learns from what reaches its stage; base spans alone make up what these texts hold
    model = pii.trained()
    assert got == through_all_stages(docs, items, model) and len(got) > 100


def test_pipeline_with_odd_rows(spark, docs, items, tmp_path):
    """Null and shared ids, null and empty texts, repeated rows, a very long text, columns that clash with those the stages make."""
    clean = [t for _, t in docs if good(t)][:30]
    odd = [(1, clean[0]), (1, clean[1]), (None, clean[2]), (None, clean[3]), (2, clean[2]), (3, None), (4, ""), (5, clean[4]), (5, clean[4]), (6, " ".join(clean)), (7, clean[5] + " a@b.cd")]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, 2, "r", 3) for i, t in odd], "doc_id long, text string, lang string, source string, _row long, __hits int, key string, node long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    common.table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    assert got == through_all_stages([(i, t or "") for i, t in odd], items, pii.trained())
