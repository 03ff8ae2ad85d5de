"""Toxicity by a classifier chain of logistic regressions over exact-vocabulary word features.

Categories are predicted one after the other; the model of a later category sees the words and the probabilities of the
earlier ones. In training those probabilities are out of fold (each row's comes from a model that has not seen its
fold), so that later models learn how far to trust them; in prediction they come from the model on all rows.

Features are the presence of words of a vocabulary learned from the training sample: for each category its even share of the words in
at least MIN_DOCS sampled documents, largest chi-square first. No hashing, so long clean documents collect no stray
collisions. The sample is a hash sample of about TRAIN_DOCS labelled rows (the documented bound); every row is scored
over its whole text. Feature counting, fitting (Spark ML) and scoring are all JVM-side.

The labels table has one toxic label and one of quality. The query's chain is low_quality, then toxic: both links learn from labels of
their own, and the second sees the words and how likely the text is junk.

Defined cases: null texts have no words and are not toxic; labels without a document or with a null are not used; of several
labels of one document the worst counts; without labels of both kinds nothing is toxic (probability 0); repeated rows are scored
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise

TRAIN_DOCS = 20_000
VOCABULARY = 512
MIN_DOCS = 4
FOLDS = 3
CATEGORIES = ["low_quality", "toxic"]
ITERATIONS = 40
#: Partitions of the training table, which is bounded by the sample.
TRAIN_PARTITIONS = 8
THRESHOLD = 0.4
REGULARISATION = 1e-4


def words_of(text: Column) -> Column:
    """Distinct lower-case letter runs."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), ""))


def telling_words(rows: DataFrame, categories: list[str], size: int, min_docs: int = MIN_DOCS) -> list[str]:
    """For each category its even share of `size` words, those with the largest chi-square (rows: words, one 0/1 column for each category)."""
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    n = totals["n"]
    each = rows.select(F.explode("words").alias("word"), *categories).groupBy("word").agg(F.count(F.lit(1)).alias("df"), *[F.sum(c).alias(c) for c in categories]).filter(F.col("df") >= min_docs)
    useful = [c for c in categories if 0 < (totals[c] or 0) < n]
    out: list[str] = []
    for c in useful:
        share = totals[c] / n
        expected = F.col("df") * F.lit(share)
        score = F.pow(F.col(c) - expected, F.lit(2)) / (expected * F.lit(1 - share) * (1 - F.col("df") / F.lit(n + 1)))
        found = each.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "word").limit(size // len(useful)).collect()
        out += [r["word"] for r in found if r["word"] not in out]
    return out


@dataclass
class Chain:
    """Fitted models in chain order; words: the vocabulary."""

    categories: list[str]
    words: list[str]
    models: list[LogisticRegressionModel]


def _vectors(df: DataFrame, words: list[str]) -> DataFrame:
    return CountVectorizerModel.from_vocabulary(words, inputCol="words", outputCol="f0", minTF=1.0).setBinary(True).transform(df)


def _inputs(df: DataFrame, k: int, categories: list[str]) -> DataFrame:
    """The features of the k-th model: words and the earlier probabilities."""
    if not k:
        return df.withColumn("x", F.col("f0"))
    return VectorAssembler(inputCols=["f0", *[f"p_{c}" for c in categories[:k]]], outputCol="x").transform(df)


def _probability(df: DataFrame, model: LogisticRegressionModel, name: str) -> DataFrame:
    return model.setFeaturesCol("x").transform(df).withColumn(name, vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def fit_chain(rows: DataFrame, categories: list[str], vocabulary: int = VOCABULARY, folds: int = FOLDS) -> Chain:
    """rows: id, words and 0/1 columns named as the categories, in chain order. Categories with one class end the chain early."""
    words = telling_words(rows, categories, vocabulary)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    usable = [c for c in categories if words and 0 < (counts[c] or 0) < counts["n"]]
    if not usable:
        return Chain([], words, [])
    data = materialise(_vectors(rows, words).select("id", "f0", F.pmod(F.xxhash64("id"), F.lit(folds)).alias("fold"), *usable).coalesce(TRAIN_PARTITIONS), "chain")
    models = []
    for k, c in enumerate(usable):
        inputs = _inputs(data, k, usable).persist()
        fit = LogisticRegression(featuresCol="x", labelCol=c, regParam=REGULARISATION, maxIter=ITERATIONS, standardization=False)
        models.append(fit.fit(inputs))
        if k + 1 < len(usable):
            parts = []
            for fold in range(folds):
                seen, unseen = inputs.filter(F.col("fold") != fold), inputs.filter(F.col("fold") == fold)
                model = fit.fit(seen) if seen.filter(F.col(c) == 1).head(1) and seen.filter(F.col(c) == 0).head(1) else models[-1]
                parts.append(_probability(unseen, model, f"p_{c}"))
            data = parts[0]
            for part in parts[1:]:
                data = data.unionByName(part)
            data = materialise(data, "chain")
        inputs.unpersist()
    return Chain(usable, words, models)


def score_chain(df: DataFrame, chain: Chain, categories: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and p_<category> of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    if chain.models:
        rows = _vectors(rows, chain.words)
        for k, (c, model) in enumerate(zip(chain.categories, chain.models, strict=True)):
            rows = _probability(_inputs(rows, k, chain.categories), model, f"p_{c}")
    return rows.select("doc_id", *[F.col(f"p_{c}") if c in chain.categories else F.lit(0.0).alias(f"p_{c}") for c in categories])


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = TRAIN_DOCS) -> DataFrame:
    """id, words, low_quality, toxic of about `size` labelled documents."""
    known = labels.filter("toxic is not null and quality is not null and doc_id is not null")
    known = known.groupBy(F.col("doc_id").alias("id")).agg((1 - F.min("quality")).cast("int").alias("low_quality"), F.max("toxic").cast("int").alias("toxic"))
    rate = min(1.0, size / max(labels.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64("id", F.lit("chain")), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30))))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", words_of(F.col("text")).alias("words"), *CATEGORIES)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = materialise(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "labelled")
    scored = score_chain(docs, fit_chain(rows, CATEGORIES), CATEGORIES)
    return scored.withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
