"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from typeloom.llm.bagminhash import near_duplicates
from typeloom.llm import toxicity as toxic
from typeloom.llm.common import fold_of, table
from typeloom.llm.decontamination import benchmark_matches, hit_words
from typeloom.llm import language_id as lid
from typeloom.llm import merkle
from typeloom.llm.lm_scoring import lm_scores
from typeloom.llm.packing import pack
from typeloom.functions.sizing import work_folder
from typeloom.llm import quality_rules as quality
from typeloom.llm import warc
from typeloom.llm.pii import personal_data
from typeloom.llm import prefix_trie as trie
from typeloom.llm import url_filters as urls
from typeloom.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


#: Rules that the contract of op1 gives.
URL_RULES = (
    (urls.BLOCK, "net/"),
    (urls.ALLOW, "example.net/en/"),
    (urls.BLOCK, "example.com/de/"),
    (urls.ALLOW, "org/fr/"),
)


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    mined = urls.mine(urls.labelled(pages, URL_RULES))
    return urls.judge_urls(pages, URL_RULES, mined)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(fold_of("doc_id", 3) != 1)
    scored = toxic.toxicity(docs, toxic.fit(docs, labels), threshold=0.7)
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(table(spark, sf_dir, "documents"), path, limit=1024)


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("lost", "clean_text")


ORACLES["op4_quality_rules"] = quality.ORACLE_SQL


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = f"{work_folder(spark)}/warc"
    warc.write_warc(pages, folder, min_bytes=1000)
    return warc.read_warc(spark, folder).select(
        warc.as_type("id", pages, "page_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.as_type("refers_to", pages, "page_id").alias("refers_to"),
        "intact",
    )


ORACLES["op5_warc"] = warc.ORACLE_SQL.replace("refers_to\nfrom", "refers_to, true as intact\nfrom")


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return lm_scores(table(spark, sf_dir, "documents"), fold_of("doc_id", 7) == 2, path)


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(table(spark, sf_dir, "documents"), path, end_id=1, window=2048).drop("ids")


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10
    )
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("item_names").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_names", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "longest_match",
    )


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


@query
def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    stripped = F.replace(docs["text"], F.lit("\n"), F.lit(""))
    leaves = docs.select(
        docs["doc_id"],
        docs["source"],
        merkle.digest_of(*fields, docs["text"]).alias("leaf"),
        F.when(fold_of(docs["doc_id"], 2) == 0, merkle.digest_of(*fields, stripped)).alias("changed"),
    )
    proven = merkle.manifest(leaves, "doc_id", "source", "leaf", "changed")
    return proven.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"),
        "folded_root",
        "verified",
    )


ORACLES["op11_merkle_manifest"] = merkle.ORACLE_SQL


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lid.fit(docs.filter(fold_of("doc_id", 4) != 2), public_tokenizers.path("piece_bpe_32k.model"))
    held_out = (fold_of(docs["doc_id"], 4) == 2).alias("held_out")
    return lid.languages(docs, model, ["doc_id", held_out])


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), group=100, heads=6)


ORACLES["op13_prefix_trie"] = trie.ORACLE_SQL
