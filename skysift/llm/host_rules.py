"""Quality rules with a verdict on hosts.

Every document is measured and held against rules; failures are summed per host
(domain), the rates shrunk towards a beta prior fitted to all hosts by moments,
and the verdicts joined back. A document goes if it fails a base rule, if it
fails a soft rule in which its host is notorious (shrunk rate of at least
``NOTORIOUS``), or if nearly all of its host fails something (``BLOCKED``).
A document that fails no rule only goes with a blocked host.

Only DataFrame functions are used. A word window is known by a 64-bit hash
within its own document; for a document of n windows two different ones are
mistaken for each other with a chance below n * n / 2**65.

Defined cases: a null text has no words and fails the base rule, like an empty
one. A null host is a host of its own. Rows are measured one by one, and repeated
rows count as often as they occur. An empty table gives an empty table. Measures
are kept apart from the document's own columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.session import cut_lineage

#: White space and symbols, as character classes.
SPACE, SYMBOL = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
#: Base rules: least words, and percent of words in repeated three-word windows.
MIN_WORDS, MAX_REPEAT = 50, 50
#: Soft rules: percent of symbols to words, percent of repeated lines to words, letters to words.
SOFT = {
    "symbols": "100 * n_symbols > 20 * n_words",
    "lines": "100 * n_dup_lines > 10 * n_words",
    "letters": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}
RULES = {"few": f"n_words < {MIN_WORDS}", "repeats": f"100 * n_repeat_words > {MAX_REPEAT} * n_words", **SOFT}
#: Shrunk failure rates from which a host is notorious for a rule, and blocked for any.
NOTORIOUS, BLOCKED = 0.5, 0.95
#: Hosts with a verdict against them that may be broadcast.
BROADCAST_HOSTS = 100_000
#: Shares of a host's rows that join its verdict separately beyond that.
SALTS = 64


def measures(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text column."""
    # Each step is used at least twice further down, so that none is folded into a lambda.
    split = docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumns({
        "_words": F.array_remove(F.split("_text", SPACE + "+"), ""),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))),
    })
    hashed = split.withColumn("n_words", F.size("_words").cast("bigint")).withColumn("_windows", F.expr("""
        case when n_words < 3 then cast(array() as array<struct<h:bigint,at:int>>)
        else sort_array(transform(sequence(0, size(_words) - 3),
            i -> struct(xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2)) as h, i as at))) end"""))
    twice = hashed.withColumn("_twice", F.expr("""
        sort_array(transform(filter(_windows, (x, k) ->
            coalesce(x.h = get(_windows, k - 1).h, false) or coalesce(x.h = get(_windows, k + 1).h, false)), x -> x.at))"""))
    return twice.withColumns({
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOL, ""))).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        # A window adds the words that the repeated window before it did not cover.
        "n_repeat_words": F.expr("""aggregate(_twice, struct(-3 as before, 0L as n),
            (a, at) -> struct(at as before, a.n + least(3, at - a.before) as n), a -> a.n)"""),
    }).drop("_text", "_words", "_lines", "_windows", "_twice")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _prior(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Beta prior (a, b) of each rule's failure rate by moments over the hosts; one row reaches the driver."""
    sums = hosts.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"),
        *[F.sum(r).alias(r) for r in RULES], *[F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_2") for r in RULES]).first()
    out = {}
    for r in RULES:
        total = sums["n"] or 1
        mean = (sums[r] or 0) / total
        spread = mean * (1 - mean)
        # Variance between hosts, without what drawing n documents each explains.
        between = max((sums[f"{r}_2"] or 0) / total - mean * mean - spread * (sums["hosts"] or 0) / total, 1e-9)
        strength = min(max(spread / between - 1, 1.0), 1e6) if spread else 1e6
        out[r] = (mean * strength, (1 - mean) * strength)
    return out


def _shrunk(rule: str, prior: dict[str, tuple[float, float]]) -> Column:
    a, b = prior[rule]
    return (F.col(rule) + F.lit(a)) / (F.col("n") + F.lit(a + b))


def host_rules(docs: DataFrame, carry: Sequence[str] = ("doc_id",), host: str = "source") -> DataFrame:
    """(doc, measures, base_failed, kept): ``doc`` is a struct of the carried columns.

    The measured documents are written once; the hosts' sums and the join read them back.
    """
    measured = measures(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.col(host).cast("string").alias("_host"), F.col("text").alias("_own")), "_own").drop("_own")
    measured = cut_lineage(measured.withColumns({f"_{r}": F.expr(x) for r, x in RULES.items()}), "measured")
    hosts = cut_lineage(measured.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"_{r}").alias(r) for r in RULES]), "hosts")
    prior = _prior(hosts)
    rates = {r: _shrunk(r, prior) for r in RULES}
    verdicts = hosts.select(
        "_host", F.greatest(*rates.values(), F.lit(0.0)).alias("worst"), *[(rates[r] >= NOTORIOUS).alias(f"host_{r}") for r in SOFT])
    verdicts = verdicts.filter(" or ".join([f"worst >= {BLOCKED}", *(f"host_{r}" for r in SOFT)]))
    failed = F.col("_few") | F.col("_repeats")
    found = verdicts.count()
    if not found:
        judged = measured.withColumn("_bad", F.lit(False))
    else:
        if found <= BROADCAST_HOSTS:
            joined = measured.join(F.broadcast(verdicts), measured._host.eqNullSafe(verdicts._host), "left")
        else:
            # Spread each host's rows, and its verdict, over salts.
            salted = measured.withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
            copies = verdicts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
            joined = salted.join(copies, salted._host.eqNullSafe(copies._host) & (salted._salt == copies._salt), "left")
        against = [F.coalesce(F.col("worst") >= BLOCKED, F.lit(False)), *[F.col(f"_{r}") & F.coalesce(F.col(f"host_{r}"), F.lit(False)) for r in SOFT]]
        bad = against[0]
        for x in against[1:]:
            bad = bad | x
        judged = joined.withColumn("_bad", bad)
    return judged.select("doc", *MEASURES, failed.alias("base_failed"), (~failed & ~F.col("_bad")).alias("kept"))


def passing(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that the rules keep, all columns."""
    return host_rules(docs, docs.columns, host).filter("kept").select("doc.*")
