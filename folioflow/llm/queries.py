"""The registered queries of this subpackage: ``QUERIES`` name -> (spark, sf_dir) -> DataFrame, ``ORACLE`` name -> DuckDB SQL."""

from __future__ import annotations

from folioflow.llm import bpe, decontaminate, main_text, maxscore, pfor, pii, quality, resampling, shards, simhash, substrings, url_filter, warc
from folioflow.llm.common import spread, table, tokenizer_json


def op1_token_blocks(spark, sf_dir):
    return pfor.tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_json("word_bpe_49k.json"))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))


def op3_repeats(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_warc(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.detect(spread(docs), model=pii.trained_on(docs))


def op6_quality(spark, sf_dir):
    return quality.judge(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_bpe(spark, sf_dir):
    return bpe.encode_and_decode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer_json("byte_bpe_50k.json"))


def op9_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.listed_from_pages(pages))


def op10_shards(spark, sf_dir):
    return shards.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_maxscore(spark, sf_dir):
    return maxscore.top_k(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_resampling(spark, sf_dir):
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return resampling.resample(spread(docs), target)


def op13_main_text(spark, sf_dir):
    return main_text.extracted(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


QUERIES = {f.__name__: f for f in (op1_token_blocks, op2_decontaminate, op3_repeats, op4_warc, op5_pii, op6_quality, op7_simhash, op8_bpe, op9_url_filter, op10_shards, op11_maxscore, op12_resampling, op13_main_text)}
ORACLE = {"op3_repeats": substrings.ORACLE, "op4_warc": warc.ORACLE, "op6_quality": quality.ORACLE, "op9_url_filter": url_filter.ORACLE, "op10_shards": shards.oracle(), "op11_maxscore": maxscore.ORACLE, "op12_resampling": resampling.oracle(), "op13_main_text": main_text.ORACLE}
