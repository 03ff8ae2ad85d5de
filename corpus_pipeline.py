"""A training corpus from raw documents: language ID, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents, in their order and unchanged, and whatever further columns docs has; no name of such a column can clash.

Defined cases, for every stage: an empty table gives an empty result; repeated rows and null ids are rows like any other (exact
deduplication keeps one of equal rows); very long texts are read whole; nulls in other columns stay as they are. What a null or
empty text means is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgecast.llm import exact_dedup, jaccard_join, mixing, packing, ppm_langid
from ridgecast.llm.common import documents, held_out, materialise, small, tokenizer_path, unused

#: Share of the evidence that a predicted language needs.
MIN_SCORE = 0.5
#: Near copies share this percentage of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80
TOKENIZER = "byte_bpe_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: texts that are null or have no letter, and undecided ones.

    The model learns from the labelled documents of the table. Without any there is nothing to judge by, and all documents stay.
    """
    model = ppm_langid.train(docs.filter(~held_out(F.col("doc_id"))))
    if not model.languages:
        return docs
    lang, score = unused(docs, "__lang"), unused(docs, "__score")
    found = ppm_langid.annotate(docs, model, lang=lang, score=score)
    return found.filter((F.col(lang) != ppm_langid.UNDETERMINED) & (F.col(score) >= MIN_SCORE)).select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with most code points, then the smallest id. Null and empty texts are equal.

    Where rows of different texts share an id, each text keeps its row.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links at NEAR_PERCENT of NEAR_WORDS-word shingles stays.

    Null and empty texts link with nothing, and a document without an id stays. Where rows of different texts share an id, all of
    them stay if one of them would.
    """
    found = jaccard_join.jaccard_components(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)
    gone = found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).filter("not stays")
    own = unused(docs, "__gone")
    gone = small(materialise(gone.select(F.col("doc_id").alias(own)), "dropped"))
    return docs.join(gone, F.col("doc_id") == F.col(own), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated sampling draws stay. Null and empty texts weigh nothing and share their cell's probability."""
    return mixing.keep_sampled(docs, tokenizer_path(TOKENIZER))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences. A null or empty text is one piece, its end token."""
    return packing.pack_documents(docs, tokenizer_path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages learn, rake and pack; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
