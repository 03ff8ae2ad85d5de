"""Document quality by a regularised quadratic discriminant over transformed text statistics.

Each class (quality 0 and 1) is a normal distribution over the statistics of a text. A class covariance is shrunk twice: towards the
pooled covariance of both classes (LAMBDAS) and towards the pooled variances alone (GAMMAS). The score is the posterior of label 1:
the logistic function of the difference of the classes' log densities, of which each is a Mahalanobis distance and a log determinant,
both from the inverse Cholesky factor that the fitted model keeps.

Spark does the work in four passes. The statistics of every whole text are DataFrame functions and are written once as a narrow table.
The moments of all labelled training rows (no sample) are sums of whole numbers, statistics in units of 1/UNIT, so that they do not
depend on how rows are dealt out: each task reduces its rows to counts, sums and products for each class and fold, and Spark adds those
up. Since moments of folds add, the driver has every out-of-fold model from the same sums; one pass over the training rows finds the
log loss of each pair of shrinkages, and the best pair is fitted on all folds. The last pass scores all rows.

Rates are counts over sizes with a few pseudo-counts (SMOOTH), so that a text of three words isn't extreme for its one digit, and
their square roots are taken; sizes are taken as logarithms.

Defined cases: a null text counts as empty, and an empty one has all counts 0 and is scored like any other; of several labels of one
document the smallest counts; labels that are null or neither 0 nor 1, or that have no document, are not used; with labels of one kind
only, the score of every row is the share of label 1 with one pseudo-label of each kind, and 0.5 without labels; a null id is not held
out and has no label; repeated rows are scored (and, where labelled, counted) each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, documents, materialise, python_workers

#: predicted is 1 from this score on.
THRESHOLD = 0.3
#: Statistics enter the moments in units of 1/UNIT.
UNIT = 1024
FOLDS = 3
#: Shrinkage towards the pooled covariance, and then towards its diagonal.
LAMBDAS = (0.02, 0.1, 0.3)
GAMMAS = (0.01, 0.1, 0.3)
#: Added to every variance: a statistic may be constant within a class.
FLOOR = 1e-4
#: Pseudo-counts below a rate: characters, words, lines.
SMOOTH = {"chars": 100, "words": 20, "lines": 4}
#: A row's log loss counts at most this much.
MAX_LOSS = 9.0

STATISTICS = [
    "log_words", "log_line_words", "word_length", "word_length_spread", "distinct_words", "distinct_pairs", "adjacent_repeats", "repeated_lines",
    "symbols", "shouts", "capitals", "digits", "not_letters", "stops",
]


def _count(pattern: str) -> Column:
    return F.length("t") - F.length(F.regexp_replace("t", pattern, ""))


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and stats (array of double, in the order of STATISTICS) of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    words = F.array_remove(F.split("t", SPACE_CLASS + "+"), "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    # inline: an array is computed once, however often the counts use it
    rows = rows.select("*", F.inline(F.array(F.struct(words.alias("w"), lines.alias("l")))))
    following = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size(following)), following, lambda a, b: F.when(a == b, F.lit(0).cast("long")).otherwise(F.xxhash64(a, b)))
    rows = rows.select("*", F.inline(F.array(F.struct(pairs.alias("p")))))
    rows = rows.select(
        "doc_id",
        F.size("w").alias("n"),
        F.size("l").alias("n_lines"),
        F.length(F.array_join("w", "")).alias("chars"),
        F.aggregate("w", F.lit(0.0), lambda acc, x: acc + F.pow(F.length(x).cast("double"), F.lit(2.0))).alias("squares"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        F.size(F.array_distinct("p")).alias("n_pairs"),
        (F.size("p") - F.size(F.array_remove("p", F.lit(0).cast("long")))).alias("n_adjacent"),
        (F.size("l") - F.size(F.array_distinct("l"))).alias("n_repeated"),
        _count(r"[#*$%&|<>]+").alias("n_symbols"),
        _count(r"[!?]+").alias("n_shouts"),
        _count(r"\p{Lu}+").alias("n_capitals"),
        _count(r"\p{L}+").alias("n_letters"),
        _count(r"[0-9]+").alias("n_digits"),
        _count(r"[.]+").alias("n_stops"),
    )
    rate = lambda c, total, kind: F.sqrt(F.greatest(F.col(c), F.lit(0)) / (F.col(total) + F.lit(float(SMOOTH[kind]))))
    some = F.greatest(F.col("n"), F.lit(1))
    mean = F.col("chars") / some
    smooth = F.lit(float(SMOOTH["words"]))
    share = lambda c: F.log(F.col(c) + smooth) / F.log(F.col("n") + smooth)
    stats = {
        "log_words": F.log1p("n"),
        "log_line_words": F.log1p(F.col("n") / F.greatest(F.col("n_lines"), F.lit(1))),
        "word_length": F.log1p(mean),
        "word_length_spread": F.log1p(F.sqrt(F.greatest(F.col("squares") / some - mean * mean, F.lit(0.0)))),
        "distinct_words": share("n_distinct"),
        "distinct_pairs": share("n_pairs"),
        "adjacent_repeats": rate("n_adjacent", "n", "words"),
        "repeated_lines": rate("n_repeated", "n_lines", "lines"),
        "symbols": rate("n_symbols", "chars", "chars"),
        "shouts": rate("n_shouts", "chars", "chars"),
        "capitals": rate("n_capitals", "chars", "chars"),
        "digits": rate("n_digits", "chars", "chars"),
        "not_letters": F.sqrt(F.greatest(F.col("chars") - F.col("n_letters"), F.lit(0)) / (F.col("chars") + F.lit(float(SMOOTH["chars"])))),
        "stops": rate("n_stops", "chars", "chars"),
    }
    return rows.select("doc_id", F.array(*[stats[s].cast("double") for s in STATISTICS]).alias("stats"))


@dataclass
class Moments:
    """Sums over rows: their number, statistics and products of statistics, in whole units."""

    n: int
    sums: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sums + other.sums, self.products + other.products)

    @classmethod
    def none(cls, d: int) -> Moments:
        return cls(0, np.zeros(d), np.zeros((d, d)))

    def mean(self) -> np.ndarray:
        return self.sums / (self.n * UNIT)

    def covariance(self) -> np.ndarray:
        mean = self.mean()
        return self.products / (self.n * UNIT * UNIT) - np.outer(mean, mean)


@dataclass
class Discriminant:
    """Both classes' means, inverse Cholesky factors and constant terms (log prior less half the log determinant)."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    #: The score of every row where labels of one kind only are known.
    constant_score: float | None = None

    @classmethod
    def fit(cls, bad: Moments, good: Moments, lam: float, gamma: float) -> Discriminant:
        if not (bad.n and good.n):
            return cls(np.zeros((2, 0)), np.zeros((2, 0, 0)), np.zeros(2), (good.n + 1) / (bad.n + good.n + 2))
        total = bad.n + good.n
        pooled = (bad.n * bad.covariance() + good.n * good.covariance()) / total
        means, factors, constants = [], [], []
        for own in (bad, good):
            cov = (1 - lam) * own.covariance() + lam * pooled
            cov = (1 - gamma) * cov + gamma * np.diag(np.diag(pooled)) + FLOOR * np.eye(len(cov))
            lower = np.linalg.cholesky(cov)
            means.append(own.mean())
            factors.append(np.linalg.inv(lower))
            constants.append(np.log(own.n / total) - np.log(np.diag(lower)).sum())
        return cls(np.array(means), np.array(factors), np.array(constants))

    def log_odds(self, stats: np.ndarray) -> np.ndarray:
        """Log density of label 1 less that of label 0, priors included, of each row of statistics."""
        if self.constant_score is not None:
            return np.full(len(stats), np.log(self.constant_score / (1 - self.constant_score)))
        density = [c - 0.5 * (((stats - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return density[1] - density[0]

    def score(self, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(stats), -700, 700)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _moments_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows (stats, label, fold) as moments: fold, label, pos, value (pos 0: count, then sums, then products)."""
    d = len(STATISTICS)
    found: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        stats = np.rint(_matrix(batch.column("stats")) * UNIT).astype(np.int64)
        key = np.stack([batch.column(c).to_numpy() for c in ("fold", "label")], axis=1)
        for fold, label in np.unique(key, axis=0):
            rows = stats[(key[:, 0] == fold) & (key[:, 1] == label)]
            sums = found.setdefault((int(fold), int(label)), np.zeros(1 + d + d * d, np.int64))
            sums += np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()])
    for (fold, label), sums in found.items():
        n = len(sums)
        yield pa.RecordBatch.from_pydict({"fold": pa.array([fold] * n, pa.int32()), "label": pa.array([label] * n, pa.int32()), "pos": pa.array(range(n), pa.int32()), "value": pa.array(sums, pa.int64())})


def moments(rows: DataFrame) -> dict[tuple[int, int], Moments]:
    """(fold, label) -> moments of rows (stats, label, fold); as many numbers as folds, labels and pairs of statistics make."""
    d = len(STATISTICS)
    sums = rows.select("fold", "label", "stats").mapInArrow(_moments_of, "fold int, label int, pos int, value long")
    raw: dict[tuple[int, int], np.ndarray] = {}
    for r in sums.groupBy("fold", "label", "pos").agg(F.sum("value").alias("value")).collect():
        raw.setdefault((r["fold"], r["label"]), np.zeros(1 + d + d * d))[r["pos"]] = r["value"]
    return {key: Moments(int(v[0]), v[1 : d + 1], v[d + 1 :].reshape(d, d)) for key, v in raw.items()}


def _sum(found: dict[tuple[int, int], Moments], label: int, without: int | None = None) -> Moments:
    total = Moments.none(len(STATISTICS))
    for (fold, own), m in found.items():
        if own == label and fold != without:
            total = total + m
    return total


def train(rows: DataFrame) -> Discriminant:
    """The discriminant of labelled rows (stats, label 0 or 1, fold), with the shrinkages of the least out-of-fold log loss."""
    found = moments(rows)
    bad, good = _sum(found, 0), _sum(found, 1)
    grid = [(lam, gamma) for lam in LAMBDAS for gamma in GAMMAS]
    if not (bad.n and good.n):
        return Discriminant.fit(bad, good, *grid[0])
    models = {fold: [Discriminant.fit(_sum(found, 0, fold), _sum(found, 1, fold), *g) for g in grid] for fold in range(FOLDS)}

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(grid), np.int64)
        for batch in batches:
            stats, label, fold = _matrix(batch.column("stats")), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for k in np.unique(fold):
                own, sign = stats[fold == k], np.where(label[fold == k] == 1, 1, -1)
                for g, model in enumerate(models[int(k)]):
                    loss = np.minimum(np.logaddexp(0, -sign * model.log_odds(own)), MAX_LOSS)
                    total[g] += np.rint(loss * UNIT).astype(np.int64).sum()
        yield pa.RecordBatch.from_pydict({"g": pa.array(range(len(grid)), pa.int32()), "loss": pa.array(total, pa.int64())})

    summed = rows.select("fold", "label", "stats").mapInArrow(losses, "g int, loss long").groupBy("g").agg(F.sum("loss").alias("loss")).collect()
    best = min(summed, key=lambda r: (r["loss"], r["g"]))["g"]
    return Discriminant.fit(bad, good, *grid[best])


def training_rows(stats: DataFrame, labels: DataFrame, label_col: str = "quality", use: Column | None = None) -> DataFrame:
    """stats, label, fold of the rows of statistics() that have a label; use restricts the labels' doc_id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1))
    if use is not None:
        known = known.filter(use)
    known = known.groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.min(label_col).cast("int").alias("label"))
    return stats.join(known, F.col("doc_id") == F.col("k")).select("stats", "label", F.pmod(F.xxhash64("k"), F.lit(FOLDS)).cast("int").alias("fold"))


def score(stats: DataFrame, model: Discriminant, name: str = "score") -> DataFrame:
    """Rows of statistics(), with the score instead of the statistics."""
    kept = [f for f in stats.schema.fields if f.name != "stats"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"`{name}` double"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.score(_matrix(batch.column("stats"))))], names=[*[f.name for f in kept], name])

    return stats.mapInArrow(scored, schema)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text leaves 0 modulo 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op11(spark, sf_dir: str) -> DataFrame:
    python_workers(spark)
    stats = materialise(statistics(documents(spark, sf_dir)), "statistics")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = materialise(training_rows(stats, labels, use=~held_out(F.col("doc_id"))), "training")
    scored = score(stats, train(rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
