"""op11, op12, op13: brute force, odd rows, held-out accuracy."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import main_text, maxscore, resampling
from folioflow.llm.words import words

RUN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_words(text):
    return RUN.findall(small(text))


ODD = [None, "", " \n", "ÀB cÉ x_y", "a\x00b c\x7fd", "日本語 ABC", "x" * 5000, "the the THE", "İİ ß"]


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_words(at_once):
    for t in [*ODD, " ".join(ODD[3:])]:
        found = [w.decode() for some in words((t or "").encode(), at_once) for w in some]
        assert found == plain_words(t)


# ---- op11 ----------------------------------------------------------------------------------------


def plain_top(docs, items, k=10):
    held = [(i, Counter(plain_words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 90 + (90 * c.total() * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(plain_words(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def made_up(seed, n, vocabulary=40):
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.expovariate(0.12)), vocabulary)}"
    return [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(n)]


@pytest.fixture(scope="module")
def odd_docs():
    rows = made_up(1, 300) + list(enumerate(ODD, 300)) + [(None, "w1 w2 w30"), (None, "w39 w40"), (7, "w1 w2 w30"), (-(2**63), "w40 w39")]
    return rows + [(1000 + i, "w5 w6 w7 w33") for i in range(40)] + [(1000, "w5 w6 w7 w33")]  # ties and a repeated row


def test_top_k(spark, odd_docs):
    items = [(0, "w1 w2 w3 w30 w39 w40"), (1, "W5 w5, w33!"), (2, None), (3, "nothing here"), (None, "w40"), (4, "x" * 5000 + " ab"), (5, " ".join(f"w{i}" for i in range(41)))]
    docs = spark.createDataFrame([(t, i, "extra") for i, t in odd_docs], "text string, doc_id long, q string").repartition(3)
    got = maxscore.top_k(docs, spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, w int"), segment=4000)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=repr) == plain_top(odd_docs, items)


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, None), (2, "...")], [(1, "a")]), ([(1, "a b")], [])])
def test_top_k_of_nothing(spark, docs, items):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert maxscore.top_k(d, i).collect() == []


def test_blocks_of_items_and_terms(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(maxscore, "ITEMS", 3)
    monkeypatch.setattr(maxscore, "TERMS", 5)
    items = made_up(2, 20, 45)
    docs = spark.createDataFrame(odd_docs, "doc_id long, text string")
    got = maxscore.top_k(docs, spark.createDataFrame(items, "item_id long, text string"), k=3, segment=3000)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=repr) == plain_top(odd_docs, items, 3)


def test_non_essential_postings_are_skipped(tmp_path):
    """A rare term decides; the postings of frequent ones are only probed where a document can still enter."""
    docs, draft = made_up(3, 6000), maxscore.Draft()
    for i, t in docs:
        draft.add(i, True, t.encode())
    name, n, length = draft.write(str(tmp_path))
    segment = maxscore.Segment(str(tmp_path), name, n, length)
    terms = [b"w0", b"w1", b"w2", b"w3", b"w4", b"w5", b"w39", b"w40"]
    df = {t: len(segment.postings(segment.at[t])[0]) for t in terms}
    w = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms])
    best = maxscore.Best(10)
    maxscore.search(segment, terms, w, best, window=256)
    want = plain_top(docs, [(0, " ".join(t.decode() for t in terms))])
    assert sorted(zip(best.id.tolist(), best.score.tolist(), strict=True)) == sorted((i, s) for _, _, i, s in want)
    assert best.seen < 0.6 * sum(df.values())
    for t, at in segment.at.items():
        assert segment.postings(at)[1].max() <= segment.most[at], t  # bounds hold


# ---- op12 ----------------------------------------------------------------------------------------


def plain_resampled(docs, target, percent=10, least=20, longest=1, buckets=10000, seed=2024):
    def feats(text):
        ws = [w.encode() for w in plain_words(text)]
        return len(ws), [zlib.crc32(b" ".join(ws[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]

    held = [(i, *feats(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for x in target for b in feats(x)[1])
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    rows = []
    for i, n, f in held:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    k = percent * len(able) // 100
    return sorted(((*r, n + 1) for n, r in enumerate(able[:k])), key=repr), Counter(able[k:] + [r for r in rows if r[1] < least])


@pytest.mark.parametrize("percent,longest,least", [(10, 1, 20), (37, 3, 0), (100, 2, 20), (0, 1, 0)])
def test_resample(spark, odd_docs, percent, longest, least):
    docs = odd_docs + [(5000 + i % 3, "w1 w2 " * 12) for i in range(150)] + [(None, "w1 w2 " * 12)] * 4 + [(2**63 - 1, "w9 " * 30)]
    target = ["w1 w2 w3 w40", None, "W9 w9"]
    d = spark.createDataFrame([(t, "x", i) for i, t in docs], "text string, score string, doc_id long").repartition(3)
    got = resampling.resample(d, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, longest=longest, least_words=least)
    rows = [tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()]
    drawn, rest = plain_resampled(docs, target, percent, least, longest)
    assert sorted((r for r in rows if r[5] is not None), key=repr) == drawn
    assert Counter(r[:5] for r in rows if r[5] is None) == rest


def test_resample_of_nothing(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a " * 30)] * 10, "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    assert sum(r["rank"] == 1 for r in resampling.resample(some, none).collect()) == 1


@pytest.mark.parametrize("k", [1, 2, 500, 777, 1999, 2000])
def test_kth_key(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice([-(2**63), 2**63 - 1, 0, -1, 5, *range(100, 140)]), rng.choice([3, 9, 10**15, -7]), n) for n in range(2000)]
    df = spark.createDataFrame(rows, "a long, b long, n long")
    key = [resampling.bits(F.col("a"), falling=True), resampling.bits(F.col("b")), resampling.bits(F.col("n"))]
    got = df.filter(resampling.up_to(resampling.kth_key(df, key, k))).collect()
    assert sorted(map(tuple, got)) == sorted(sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[:k])


# ---- op13 ----------------------------------------------------------------------------------------


def test_held_out_pages():
    """Blocks of pages that the field has not seen."""
    pages = [main_text.leaf_blocks(p) for p in main_text.labelled_pages(300, seed=2026)]
    right = said = meant = 0
    for blocks, label in zip(pages, main_text.viterbi(main_text.trained(), pages), strict=True):
        right += sum(bool(x) and b.labelled for b, x in zip(blocks, label, strict=True))
        said += int(label.sum())
        meant += sum(b.labelled for b in blocks)
    assert right / said > 0.985 and right / meant > 0.985


REST = {
    "menu": '<nav class="main-menu"><ul><li><a href=/a>Home</a><li><a href=/b>News and more</a></ul></nav>',
    "header": "<header><h1>The Site</h1><p>All that is new.</p></header>",
    "sidebar": '<aside class="sidebar"><h3>Read next</h3><p>Ten things that nobody has told you about this. Really, nobody has.</p></aside>',
    "notice": '<div class="cookie-notice"><p>We use cookies to make this site better for all. Do you agree with that?</p><button>Yes</button></div>',
    "advert": '<div class="ad">Buy two for the price of three, today, and only today.</div>',
    "form": '<form action=/s><label>Your name</label><input name=n><p>Write to us, and we write to you.</p><button>Send it</button></form>',
    "comments": '<section class="comments"><h3>Two comments</h3><div class="comment"><p>I have read this, and I liked it. It is a fine piece of work.</p></div></section>',
    "footer": "<footer>&copy; site.example.com &middot; All rights reserved.</footer>",
}


def test_parts_of_pages():
    story = "<article><h1>A  title&nbsp;here</h1><p>First &lt;part&gt; of\n the <b>story</b>, as it is told.<br>It goes on.<p>And <a href=x>a link</a> in its second part. <script>var a='</p>';</script>More.</p></article>"
    want = "A title here\nFirst <part> of the story, as it is told. It goes on.\nAnd a link in its second part. More."
    page = f"<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style></head><body>{REST['notice']}{REST['header']}{REST['menu']}<!-- <p>no</p> -->{REST['advert']}{story}{REST['sidebar']}{REST['comments']}{REST['form']}{REST['footer']}"
    assert main_text.extract(main_text.trained(), [page]) == [want]
    for kind, part in REST.items():
        after = kind in ("sidebar", "comments", "footer", "form")
        page = f"<html><body>{'' if after else part}{story}{part if after else ''}</body></html>"
        assert main_text.extract(main_text.trained(), [page]) == [want], kind


def test_blocks():
    said = lambda page: [b.text for b in main_text.leaf_blocks(page)]
    assert said("a<p>b <i>c</i>d<div>e</div>f") == ["a", "b cd", "e", "f"]
    assert said("<ul><li>x<li>y</ul>z &amp &am &quot;q&quot;") == ["x", "y", 'z & &am "q"']
    assert said("1 < 2 <3 <p title='>'>t</p>") == ["1 < 2 <3", "t"]
    assert said("<p>a<script>b</p>") == ["a"] and said("<p>a</p><!-- b") == ["a"] and said("a<p b='c>d</p>e") == ["a", "d", "e"]
    assert said("") == said("<p> &nbsp;</p>") == said("<p") == []


@pytest.mark.parametrize("page", ["<p a=\"" * 40_000, "<" * 200_000, "<div>" * 60_000 + "x", "<a '\">" * 40_000, "&amp" * 80_000, "<script>" * 40_000, "<!--" * 60_000, "<p>x" * 60_000])
def test_time_grows_with_length(page):
    began = time.time()
    main_text.leaf_blocks(page)
    assert time.time() - began < 10


def test_extracted(spark):
    story = "<article><p>One line of the story, and a long one.</p></article>"
    rows = [(1, "u", story, 9), (None, None, None, None), (3, "v", "", 1), (1, "u", story, 9), (4, "w", "<body>" + story * 3000, 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in main_text.extracted(df).collect()), key=repr)
    line = "One line of the story, and a long one."
    many = "\n".join([line] * 3000)
    assert got == sorted([(1, "u", line, 38), (1, "u", line, 38), (None, None, "", 0), (3, "v", "", 0), (4, "w", many, len(many))], key=repr)
    assert main_text.extracted(df.limit(0)).collect() == []
    assert main_text.extracted(df).columns == ["page_id", "url", "text", "n_chars"]

