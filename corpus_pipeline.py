"""From raw documents to token ids, in five stages.

Each stage reads what the stage before it wrote. The first four return the
columns of ``documents``; the last adds the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm import bpe_tree, host_rules, near_copies, pii_votes, simhash_tree, suffix_automaton
from skysift.llm.common import free_names, table
from skysift.session import cut_lineage, drop_scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go."""
    return host_rules.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8) stays, the one with the smallest id.

    Operator 4's fingerprints and trees propose pairs, bands of minima add those that
    differ in more bits; all are checked on exact shingle sets.
    """
    pairs = simhash_tree.candidate_pairs(docs)
    found = near_copies.near_copies(docs, pairs=pairs)
    drop_scratch(pairs)
    return simhash_tree.keep_least(docs, found)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages cover beyond the limit go; all others stay as they are."""
    return suffix_automaton.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return pii_votes.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*[F.col(f"`{c}`") for c in docs.columns])


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids, n_tokens, and whether the tokens decode to the text (columns of these names get an underscore behind)."""
    packed = docs.select("text", F.struct("*").alias("doc"))
    coded = bpe_tree.round_trip(packed, ["doc"])
    names = free_names(docs.columns, ("token_ids", "n_tokens", "round_trip"))
    return coded.select(
        *[F.col("doc").getField(c).alias(n) for c, n in zip(docs.columns, names)], "token_ids", F.size("token_ids").cast("bigint").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("doc.text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("byte_level_bpe", byte_level_bpe),
]

#: Near duplicates, weak supervision and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        out = cut_lineage(stage(spark, docs, sf_dir), "pipeline")
        drop_scratch(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
