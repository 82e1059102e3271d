"""Registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballgraph.llm import oracles, sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op4_token_counts")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from ballgraph.llm.tokens import count_tokens

    return count_tokens(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from ballgraph.llm.packing import pack

    return pack(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op8_site_lines", oracles.SITE_LINES)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from ballgraph.llm.site_lines import drop_boilerplate

    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, counts=True)


@query("op10_quality", oracles.QUALITY)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from ballgraph.llm.divergence import quality

    return quality(table(spark, folder, "documents"))


#: Fixed values of the url query.
URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
    ("block", "net/fr/"),
]
LISTED_LABELS = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")


@query("op3_url_filter", oracles.url_filter(URL_RULES, LISTED_LABELS))
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from ballgraph.llm.url_filter import judge_urls

    return judge_urls(table(spark, folder, "pages"), URL_RULES, listed_labels=LISTED_LABELS)


@query("op5_decontamination")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from ballgraph.llm.decontaminate import find_leaks

    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_warc_derivatives")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from ballgraph.llm.warc import derive, page_responses

    records = derive(page_responses(table(spark, folder, "pages")))
    return records.withColumnRenamed("key", "page_id").withColumn("record", F.sha2("record", 256)).withColumnRenamed(
        "record", "record_sha256"
    )


@query("op7_chat_format", oracles.CHAT)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from ballgraph.llm.chat import format_turns, read_back

    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    path = tokenizer_path("byte_bpe_50k.json")
    return read_back(format_turns(turns.union(more), path), path)


@query("op1_class_lm")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from ballgraph.llm.class_lm import score_texts

    return score_texts(table(spark, folder, "documents").select("doc_id", "text"))


@query("op2_ngram_jaccard")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from ballgraph.llm.jaccard import jaccard_join

    return jaccard_join(table(spark, folder, "documents").select("doc_id", "text"))


@query("op11_merkle_manifest", oracles.MANIFEST)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from ballgraph.llm.manifest import manifest

    return manifest(table(spark, folder, "documents"))


@query("op12_ring_shards", oracles.shards(40, sharding.VIRTUAL_NODES, sharding.WAVES, sharding.PARTS))
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(table(spark, folder, "documents"), 40)


@query("op13_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from ballgraph.llm.whitening import whiten

    return whiten(table(spark, folder, "embeddings"))
