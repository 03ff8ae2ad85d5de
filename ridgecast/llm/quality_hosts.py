"""Host-level quality rules, in DataFrame functions only.

Per document: counts over the whole text and the base rule (too few words, or too much repeated text). Per host: the
base failures are aggregated, the failure rate is shrunk towards the mean of all hosts by a beta prior whose two
parameters come from the hosts themselves (method of moments), and the host's verdict is joined back to its documents.

n_repeat_words needs every 8-word window that occurs twice in a text. Window hashes are built by doubling (pairs, fours,
eights), so a window costs three 64-bit hashes; only texts in which a window hash repeats sort their windows. Two
different windows of one text share a 64-bit hash with a probability under 1e-9 even in texts of 100,000 words.

Arrays that several later expressions (or lambda bodies) use go through inline(array(struct(...))), which the optimiser
does not collapse, so each is computed once per row.

Defined cases: a null text has no words and fails the base rule; a null host is a host of its own; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, documents, materialise

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
#: A host is dropped when its shrunk failure rate is over this.
MAX_HOST_RATE = 0.5


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however often later expressions use them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _pairwise(array: Column, n: Column, shift: int) -> Column:
    """Hashes of the elements shift apart: one for each of the first n - shift."""
    return F.zip_with(F.slice(array, F.lit(1), n - shift), F.slice(array, F.lit(shift + 1), n - shift), lambda a, b: F.xxhash64(a, b))


def base_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("t"))
    df = _once(
        df,
        w=F.array_remove(F.split("t", SPACE_CLASS + "+"), ""),
        lines=F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACES, "") != ""),
    )
    df = df.select(
        "doc_id",
        "host",
        F.size("w").alias("n"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h1"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    long_enough = F.col("n") >= WINDOW
    df = _once(df, h2=F.when(long_enough, _pairwise(F.col("h1"), F.col("n"), 1))).drop("h1")
    df = _once(df, h4=F.when(long_enough, _pairwise(F.col("h2"), F.col("n") - 1, 2))).drop("h2")
    df = _once(df, h8=F.when(long_enough, _pairwise(F.col("h4"), F.col("n") - 3, 4))).drop("h4")
    repeats = F.size("h8") > F.size(F.array_distinct("h8"))
    df = _once(df, s=F.when(repeats, F.sort_array(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("h8")
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    found = F.filter("s", lambda x, i: same(x, F.get("s", i - 1)) | same(x, F.get("s", i + 1)))
    df = _once(df, at=F.sort_array(F.transform(found, lambda x: x["i"]))).drop("s")
    gaps = F.zip_with("at", F.slice("at", F.lit(2), F.size("at")), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(F.when(F.size("at") > 0, gaps), F.lit(0).cast("long"), lambda acc, x: acc + x)
    df = df.select("doc_id", "host", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def host_rates(counts: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, rate: each host's failure rate under the empirical beta prior.

    Prior mean m and strength k by moments: the variance of the raw rates beyond binomial noise gives
    k = m (1 - m) / excess - 1. With no excess (or one host) k is large and every host gets the mean.
    """
    hosts = counts.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    total = hosts.agg(
        F.sum("n_failed").alias("f"), F.sum("n_docs").alias("n"), F.count(F.lit(1)).alias("h"),
        F.sum(F.col("n_docs") * raw * raw).alias("s2"),
    ).first()
    mean = total["f"] / total["n"] if total["n"] else 0.0
    noise = mean * (1 - mean)
    excess = total["s2"] / total["n"] - mean * mean - noise * total["h"] / total["n"] if total["n"] else 0.0
    strength = min(1e6, max(1.0, noise / excess - 1)) if excess > 0 and noise > 0 else 1e6
    return hosts.withColumn("rate", (F.col("n_failed") + F.lit(strength * mean)) / (F.col("n_docs") + F.lit(strength)))


def host_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """base_counts of every document, the host's shrunk rate, and kept: the base rule holds and so does the host's."""
    counts = materialise(base_counts(df, id_col, text_col, host_col), "base-counts")
    rates = host_rates(counts).select(F.col("host").alias("k"), F.col("rate").alias("host_rate"))
    return counts.join(rates, F.col("host").eqNullSafe(F.col("k"))).drop("k").withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate))


def op4(spark, sf_dir: str) -> DataFrame:
    return host_quality(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM d
), win AS (
  SELECT rid, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8
), keyed AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS k FROM win
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM keyed) WHERE c > 1
), cov AS (
  SELECT rid, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid
), lines AS (
  SELECT rid, [x FOR x IN string_split(t, chr(10)) IF regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') <> ''] AS l FROM d
), m AS (
  SELECT d.rid, doc_id, source, CAST(len(w.w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w USING (rid) JOIN lines USING (rid) LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY source
), g AS (
  SELECT sum(f) / sum(n) AS mean, count(*) AS hosts, sum(n) AS n,
         sum(n * (f / n) * (f / n)) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n))
           - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * count(*) / sum(n) AS excess
  FROM h
), p AS (
  SELECT mean, CASE WHEN excess > 0 AND mean * (1 - mean) > 0
    THEN least(1e6, greatest(1.0, mean * (1 - mean) / excess - 1)) ELSE 1e6 END AS k FROM g
), r AS (
  SELECT source, (f + k * mean) / (n + k) AS rate FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND rate <= 0.5) AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""
