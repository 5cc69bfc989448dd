"""URLs judged by prefix rules and by a list of canonical URLs, through a Bloom filter.

Rules name a host and the beginning of a path; they fit the host, its subdomains and all
paths that begin so. Rules and listed URLs are keys of one table. Each page asks for a few
keys: its canonical URL, and every suffix of its host together with every beginning of its
path that has the length of some rule's. A blocked Bloom filter of all keys, whose size is
bounded, answers no to nearly all questions within the scan. What may be listed goes to an
exact join, which removes false positives.

Rule keys such as a top-level domain are asked for by a large share of all pages. The
questions are therefore first reduced to different keys, joined to the list, and the few
keys that are really listed are joined back to the pages over ``SALTS`` parts of each key.

Of several rules the one with most characters counts, of equally long ones that with the
longer host; a rule listed with both verdicts blocks. Without a rule a listed URL is
blocked, others are allowed.

Defined cases: a null URL or one without "://" has an empty host and path, fits no rule and
is not listed. Repeated rows and ids are judged one by one. Rules without a host never fit.
An empty table gives an empty table, an empty list none that is listed. ``carry`` columns
travel in a struct, whatever their names; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from skysift.llm import bloom
from skysift.llm.common import list_array
from skysift.llm.revisits import canonical_url
from skysift.session import cut_lineage, drop_scratch

#: verdict, host and path of the rules of the registered query (fixed values).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
SALTS = 16


def host(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), ascii_uppercase, ascii_lowercase)


def path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _keys(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, verdict, long, host_long) of rules and listed URLs, one row a key."""
    own = rules.filter("host != ''").select(
        F.concat(F.lit("r:"), "host", "path").alias("key"), "verdict", F.length(F.concat("host", "path")).alias("long"), F.length("host").alias("host_long"))
    urls = listed.select(F.concat(F.lit("u:"), canonical_url("url")).alias("key"), F.lit("block").alias("verdict"), F.lit(-1).alias("long"), F.lit(-1).alias("host_long"))
    return own.unionByName(urls).filter("key is not null").groupBy("key").agg(*[F.max(c).alias(c) for c in ("verdict", "long", "host_long")])


def _asked(rules: DataFrame) -> Column:
    """The keys that a row with host, path and url asks for."""
    # As many labels and lengths as rules have: a few numbers, whatever the pages hold.
    shape = rules.filter("host != ''").agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    labels, lengths = shape.labels or 0, sorted(shape.lengths or [])
    split = F.split("host", r"\.")
    suffixes = F.array(*[F.when(F.size(split) >= n, F.array_join(F.slice(split, -n, n), ".")) for n in range(1, labels + 1)])
    starts = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    fit = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(F.lit("r:"), s, p))))
    by_rule = F.when(F.col("host") != "", fit).otherwise(F.array()) if labels and lengths else F.array().cast("array<string>")
    return F.filter(F.concat(by_rule, F.array(F.concat(F.lit("u:"), "canonical"))), lambda k: k.isNotNull())


def _possible(listed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hashes")
            counts = np.diff(hashes.offsets.to_numpy())
            flat = hashes.flatten().to_numpy()
            maybe = pa.array(listed.value.might_hold(flat) if len(flat) else np.zeros(0, bool))
            yield pa.record_batch([*(batch.column(c) for c in ("doc", "host", "path", "keys")), list_array(maybe, counts)], ["doc", "host", "path", "keys", "maybe"])

    return run


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, carry: Sequence[str] = ("page_id",)) -> DataFrame:
    """(doc, host, path, rule, listed, verdict) of each page; ``doc`` is a struct of the carried columns, ``listed`` has a url column."""
    spark = pages.sparkSession
    keys = cut_lineage(_keys(rules, listed), "keys")
    filter_ = spark.sparkContext.broadcast(bloom.build(keys.select(F.xxhash64("key").alias("h"))))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.when(F.col("url").contains("://"), F.col("url")).alias("url"))
    rows = rows.select("doc", host("url").alias("host"), path("url").alias("path"), canonical_url("url").alias("canonical")).withColumn("keys", _asked(rules))
    rows = rows.select("doc", "host", "path", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("hashes"))
    schema = StructType([*rows.schema.fields[:-1], StructField("maybe", ArrayType(BooleanType()))])
    tested = rows.mapInArrow(_possible(filter_), schema)
    tested = cut_lineage(tested.select(
        F.monotonically_increasing_id().alias("row"), "doc", "host", "path", F.filter("keys", lambda k, i: F.get("maybe", i)).alias("keys")), "tested")
    filter_.destroy()
    asked = tested.filter(F.size("keys") > 0).withColumn("key", F.explode("keys")).drop("keys")
    # Written with its salts, so that Spark knows the size it would broadcast.
    spread = cut_lineage(asked.select("key").distinct().join(keys, "key").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), "real")
    found = asked.withColumn("salt", F.pmod("row", F.lit(SALTS))).join(spread, ["key", "salt"], "left")
    best = found.groupBy("row").agg(
        F.first("doc").alias("doc"), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max(F.when(F.col("long") >= 0, F.struct("long", "host_long", "verdict", F.expr("substr(key, 3)").alias("rule")))).alias("best"),
        F.coalesce(F.bool_or(F.col("long") < 0), F.lit(False)).alias("listed"))
    quiet = tested.filter(F.size("keys") == 0).select(
        "row", "doc", "host", "path", F.lit(None).cast(best.schema["best"].dataType).alias("best"), F.lit(False).alias("listed"))
    drop_scratch(keys)
    return best.unionByName(quiet).select(
        "doc", "host", "path", F.col("best.rule").alias("rule"), "listed",
        F.coalesce("best.verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


#: Runs of symbols that mark a page as junk.
JUNK = r"###|\*\*\*|%%%"


def junk_pages(pages: DataFrame) -> DataFrame:
    """(url): the pages whose text holds runs of symbols; their canonical URLs make the block list of the registered query."""
    return pages.filter(F.rlike("html", F.lit(JUNK))).select("url")
