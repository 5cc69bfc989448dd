"""The operators over the driver's tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm import (
    bpe_tree, byte_conv, centroids, fm_index, hilbert_shards, host_rules, longest_match, phrases, pii_votes, revisits, simhash_tree, sql, suffix_automaton, url_filter,
)
from skysift.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(sql.ORACLES)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_tree.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_automaton.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", suffix_automaton.contaminated())


@query
def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_tree.decode(bpe_tree.encode(table(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_rules.host_rules(table(spark, sf_dir, "documents"))
    return found.select("doc.doc_id", *host_rules.MEASURES, "base_failed", "kept")


@query
def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards.hilbert_shards(table(spark, sf_dir, "documents"))
    return placed.select("row.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_votes.find(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.expr(f"size(filter(spans, s -> s.base and s.kind = '{k}'))").cast("bigint").alias(f"n_{k}") for k in pii_votes.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op8_byte_conv_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = byte_conv.score(docs, byte_conv.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", byte_conv.held_out().alias("held_out"), "score", (F.col("score") >= byte_conv.CUT).cast("int").alias("predicted"))


@query
def op1_longest_match_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_match.token_counts(table(spark, sf_dir, "documents"))


@query
def op3_not_modified_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.captures(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "\n")
    return found.select("record_id", "canonical", "status", "refers_to", "digest", headers.alias("headers"))


@query
def op11_son_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query
def op12_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.rule_table(spark), url_filter.junk_pages(pages)).select("doc.page_id", "host", "path", "rule", "verdict", "listed")


@query
def op13_integer_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(*centroids.cluster(table(spark, sf_dir, "embeddings")))
