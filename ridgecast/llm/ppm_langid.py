"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes, of order three at most, with frozen counts. A byte's cost under
a language is its code length in bits: -log2 of its probability in the longest context that has seen it, plus the
escapes from the longer contexts that have not (method C: d / (n + d) for a context with n symbols, d of them
distinct; order -1 is uniform over 256 bytes). A text's code length is the sum over all of its bytes; the shortest wins, and the
score is that language's share of 2^-bits.

Byte 0 stands before a text's start as well. Frozen trees let every context be tabulated: for each order one table holds the known
strings' costs in all languages, and one the escapes from the known contexts; a string that no language has seen pays the escape
from its context and the cost of the shorter string. Scoring is a probe of a hash table, a gather and a sum over each Arrow batch.

Training reads whole texts of a hash sample of about DOCS_PER_LANGUAGE labelled, not held-out documents of each language
(the documented bound); counts are summed by Spark.

Defined cases: null texts and texts without a letter give "und" and score 0; so does everything when there is nothing
to learn from; ties go to the first language in alphabetical order; repeated rows are scored each; other columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, held_out, python_workers, text_buffer, unused

#: Expected number of sampled training documents for a language.
DOCS_PER_LANGUAGE = 1500
#: Longest context, and the bits of a byte that no context has seen.
ORDER, UNIFORM_BITS = 3, 8.0
#: Bytes scored at once.
BLOCK = 1 << 20
UNDETERMINED = "und"


def strings_of(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the four bytes that end there as one number; texts start after three bytes 0."""
    lengths = np.diff(offsets)
    at = np.arange(len(body)) + 3 * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    padded = np.zeros(len(body) + 3 * len(lengths) + 1, np.uint32)
    padded[at] = body
    code = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    return code[at - 3]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, code, n for each batch."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for lang in table["lang"].unique().to_pylist():
            texts = table.filter(pa.compute.equal(table["lang"], lang))["text"]
            code, n = np.unique(strings_of(*text_buffer(texts)), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(code), pa.string()), "code": pa.array(code, pa.int64()), "n": pa.array(n, pa.int64())})


@dataclass
class PpmModel:
    """Tabulated code lengths, by order: the known strings (sorted) with their costs, the known contexts (sorted) with their escapes."""

    languages: list[str]
    strings: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def _tail(code: np.ndarray, order: int) -> np.ndarray:
    """The last order + 1 bytes."""
    return code & np.uint32((1 << 8 * (order + 1)) - 1)


def build_model(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> PpmModel:
    """counts: language -> (four-byte strings, how often)."""
    languages = sorted(counts)
    model = PpmModel(languages, [], [], [], [])
    for order in range(ORDER + 1):
        seen = []
        for lang in languages:
            own, back = np.unique(_tail(counts[lang][0].astype(np.uint32), order), return_inverse=True)
            seen.append((own, np.bincount(back, weights=counts[lang][1], minlength=len(own))))
        strings = np.unique(np.concatenate([s for s, _ in seen])) if seen else np.zeros(0, np.uint32)
        contexts, of = np.unique(strings >> np.uint32(8), return_inverse=True)
        costs, escapes = np.zeros((len(strings), len(languages)), np.float32), np.zeros((len(contexts), len(languages)), np.float32)
        for k, (own, n) in enumerate(seen):
            at = np.searchsorted(strings, own)
            total = np.bincount(of[at], weights=n, minlength=len(contexts))
            distinct = np.bincount(of[at], minlength=len(contexts))
            known = total > 0
            escapes[known, k] = -np.log2(distinct[known] / (total + distinct)[known])
            shorter = model.costs[-1][np.searchsorted(model.strings[-1], _tail(strings, order - 1)), k] if order else UNIFORM_BITS
            costs[:, k] = escapes[of, k] + shorter
            costs[at, k] = -np.log2(n / (total + distinct)[of[at]])
        model.strings.append(strings)
        model.costs.append(costs)
        model.contexts.append(contexts)
        model.escapes.append(escapes)
    return model


class _Probe:
    """A hash table from the known four-byte strings to their rows, at most a quarter full; len(strings) for others."""

    def __init__(self, strings: np.ndarray):
        self.bits = max(4, (4 * len(strings)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint32)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        self.none = len(strings)
        left, at = np.arange(len(strings)), self._place(strings)
        while len(left):
            free = np.flatnonzero(self.rows[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.rows[at[won]] = strings[left[won]], left[won]
            stay = np.setdiff1d(np.arange(len(left)), won, assume_unique=True)
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)

    def _place(self, code: np.ndarray) -> np.ndarray:
        return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - min(self.bits, 32))).astype(np.int64)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        at = self._place(code)
        rows, same = self.rows[at], self.keys[at] == code
        out = np.where(same & (rows >= 0), rows, self.none)
        left = np.flatnonzero(~same & (rows >= 0))
        while len(left):
            step = (at[left] + 1) & ((1 << self.bits) - 1)
            at[left] = step
            rows, same = self.rows[step], self.keys[step] == code[left]
            hit = same & (rows >= 0)
            out[left[hit]] = rows[hit]
            left = left[~same & (rows >= 0)]
        return out


_PROBES: dict[str, _Probe] = {}


def _table(model: PpmModel) -> _Probe:
    """The model's hash table, built once in each worker."""
    if model.key not in _PROBES:
        _PROBES.clear()
        _PROBES[model.key] = _Probe(model.strings[ORDER])
    return _PROBES[model.key]


def code_lengths(model: PpmModel, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under each language."""
    table = _table(model)
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        a, b = offsets[first], offsets[last]
        if last == first + 1:  # one text, of any length
            for s in range(a, b, BLOCK):
                lead = min(3, s - a)
                code = strings_of(body[s - lead : min(s + BLOCK, b)], np.array([0, min(s + BLOCK, b) - s + lead]))[lead:]
                out[first] += _costs(model, table, code).sum(0, dtype=np.float64)
        elif b > a:
            cost = _costs(model, table, strings_of(body[a:b], offsets[first : last + 1] - a))
            full = np.flatnonzero(np.diff(offsets[first : last + 1]))
            out[first + full] = np.add.reduceat(cost, offsets[first + full] - a, axis=0, dtype=np.float64)
        first = last
    return out


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted numbers are in a sorted table, and which are."""
    at = np.minimum(np.searchsorted(table, wanted), max(len(table) - 1, 0))
    return at, table[at] == wanted if len(table) else np.zeros(len(wanted), bool)


def _costs(model: PpmModel, table: _Probe, code: np.ndarray) -> np.ndarray:
    rows = table(code)
    unknown = np.flatnonzero(rows == table.none)
    rows[unknown] = 0
    cost = model.costs[ORDER][rows] if table.none else np.zeros((len(code), len(model.languages)), np.float32)
    cost[unknown] = 0
    for order in range(ORDER, -1, -1):  # escape, then try the shorter string
        if not len(unknown):
            return cost
        at, known = _find(model.contexts[order], _tail(code[unknown], order) >> np.uint32(8))
        cost[unknown[known]] += model.escapes[order][at[known]]
        if order:
            at, known = _find(model.strings[order - 1], _tail(code[unknown], order - 1))
            cost[unknown[known]] += model.costs[order - 1][at[known]]
            unknown = unknown[~known]
    cost[unknown] += UNIFORM_BITS
    return cost


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE) -> PpmModel:
    """Fit on a hash sample of df's rows that have a text and a language."""
    spark = df.sparkSession
    python_workers(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return build_model({})
    rates = F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(min(1.0, docs_per_language / n)))])
    chance = F.pmod(F.xxhash64("id", F.lit("ppm")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.filter(chance < F.element_at(rates, F.col("lang"))).select("lang", "text")
    found = sample.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    parts = {lang: found.filter(pa.compute.equal(found["lang"], lang)) for lang in sizes}
    return build_model({lang: (g["code"].to_numpy(), g["n"].to_numpy().astype(np.float64)) for lang, g in parts.items() if len(g)})


def annotate(df: DataFrame, model: PpmModel, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with two more columns: the predicted language and its score (they replace columns of these names)."""
    spark = df.sparkSession
    python_workers(spark)
    shared = spark.sparkContext.broadcast(model)
    own, letters = unused(df, "__ppm_text"), unused(df, "__ppm_letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*shared.value.languages, UNDETERMINED], pa.string())
        for batch in batches:
            bits = code_lengths(shared.value, *text_buffer(batch.column(own)))
            known = batch.column(letters).to_numpy(zero_copy_only=False)
            if bits.shape[1]:
                best = np.where(known, bits.argmin(1), len(names) - 1)
                share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
            else:
                best, share = np.full(len(bits), len(names) - 1), np.zeros(len(bits))
            kept = [k for k, name in enumerate(batch.schema.names) if name not in (own, letters)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), names.take(pa.array(best)), pa.array(np.where(known, share, 0.0))], names=[*(batch.schema.names[k] for k in kept), lang, score])

    df = df.drop(lang, score)
    schema = T.StructType([*df.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select("*", text.alias(own), text.rlike(r"\p{L}").alias(letters)).mapInArrow(run, schema)


def predict(df: DataFrame, model: PpmModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("__text"))
    return annotate(rows, model, "__text").drop("__text")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, train(docs.filter(~held_out(F.col("doc_id")))))
