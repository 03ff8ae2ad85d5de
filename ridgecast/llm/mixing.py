"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells of source, language and topic, each with the tokens of its documents. Raking scales
the cells' weights to one marginal after the other until all marginals hold; a cell's ratio of raked to original weight
says how much more or less of it the mixture wants. Documents are then sampled with probability min(1, c * ratio), c
so that the expected tokens are a wanted fraction of all (FRACTION where none is named; cells that end at 1 miss their
target), by a hash of the document's id, so the choice is reproducible and needs no shuffle. fraction=None takes c as
large as it can be with no probability over 1: exactly calibrated, but one rare cell then sets how much stays.

Texts are read once for the weights: a task counts each text's tokens with the tokenizer and names its topic, and
a narrow table (id, cell, tokens) is all that goes on. Corpora that carry a topic column name it (topic_col); without one the
topic is the form of the text (table, symbols, shouting, lines or prose) from the shares of its bytes.

Targets are shares of a dimension's values, of any sum. Values without a target keep the share they have, and the given ones
divide the rest; a target of 0 is the only way to empty a value. Where no targets are given they are the corpus's own marginals
raised to a power below 1, which lifts small sources and languages and holds back dominant ones.

All cells are raked, however small. Raking runs until the marginals hold to TOLERANCE. Targets that contradict each other, or the cells there are
(a cell alone in its source, language and topic with three different goals), never hold: then it ends where a round moves no cell any more, or after
MOST_ROUNDS, and rake() raises, or warns if strict is False (mix() warns: it samples by the ratios it got). marginals() reports what
share each value has, was meant to have and gets.

Everything runs on the table of cells, in one task while they are few and as Spark jobs with a written table for each round
beyond that; the driver sees only convergence figures.

Defined cases: null source, language or topic is a value of its own ("unknown"); a null or empty text has no tokens and
takes its cell's probability (0 where no document of its cell has tokens); repeated rows share one decision, and so do rows
without an id; an empty table gives an empty result. mix() returns its own columns only and keep_sampled() the rows as they
came, so no name of an input column can clash.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, documents, materialise, python_workers, small, text_buffer, tokenizer_path, unused
from .packing import encode

DIMENSIONS = ("mix_source", "mix_lang", "topic")
POWER = 0.85
MOST_ROUNDS = 200
TOLERANCE = 1e-4
#: Part of the tokens that a mixture keeps.
FRACTION = 0.5
#: Raking also ends when a whole round moves no cell by more than this part of the tolerance: contradicting targets come round to the same weights.
STILL = 0.1
#: Counted cells (some hundred bytes each) that one task rakes; more are raked by Spark jobs.
TASK_CELLS = 100_000
UNKNOWN = "unknown"
#: Bytes whose forms are counted at once.
BLOCK = 1 << 20

#: The forms of text in order of precedence, each with the bytes that make it and the share of them that it needs.
FORMS = (("table", b"|", 1 / 50), ("symbols", b"#*$%&<>", 1 / 50), ("shouting", bytes(range(65, 91)), 1 / 4), ("lines", b"\n", 1 / 100))
PROSE = "prose"


def _form_classes() -> np.ndarray:
    out = np.full(256, len(FORMS), np.uint8)
    for k, (_, members, _) in enumerate(FORMS):
        out[list(members)] = k
    return out


FORM_CLASSES = _form_classes()


def form_topics(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index into FORMS (its length: prose) of each text, by the shares of its bytes."""
    n, width = len(offsets) - 1, len(FORMS) + 1
    counts = np.zeros((n, width), np.int64)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        a, b = offsets[first], offsets[last]
        if last == first + 1:  # one text, of any length
            for s in range(a, b, BLOCK):
                counts[first] += np.bincount(FORM_CLASSES[body[s : min(s + BLOCK, b)]], minlength=width)
        elif b > a:
            owner = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
            counts[first:last] = np.bincount(owner * width + FORM_CLASSES[body[a:b]], minlength=(last - first) * width).reshape(-1, width)
        first = last
    size = np.diff(offsets)
    out = np.full(n, len(FORMS))
    for k in range(len(FORMS) - 1, -1, -1):
        out[counts[:, k] > size * FORMS[k][2]] = k
    return out


_FORM_NAMES = pa.array([*(name for name, _, _ in FORMS), PROSE], pa.string())


def _known(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(UNKNOWN))


def features(df: DataFrame, path: str, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", text_col: str = "text", topic_col: str | None = None) -> DataFrame:
    """id, mix_source, mix_lang, topic, n_tokens of every row; path: the rank file of the tokenizer."""
    python_workers(df.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            n = pa.array([len(encode(path, t)) for t in texts.to_pylist()], pa.int64())
            topic = batch.column("topic") if topic_col else _FORM_NAMES.take(pa.array(form_topics(*text_buffer(texts))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mix_source"), batch.column("mix_lang"), topic, n], names=["id", *DIMENSIONS, "n_tokens"])

    topic = _known(F.col(topic_col)) if topic_col else F.lit("")
    rows = df.select(F.col(id_col).cast("long").alias("id"), _known(F.col(source_col)).alias("mix_source"), _known(F.col(lang_col)).alias("mix_lang"), topic.alias("topic"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(read, "id long, mix_source string, mix_lang string, topic string, n_tokens long")


def tempered(cells: DataFrame, dimension: str, power: float = POWER) -> DataFrame:
    """Target shares of a dimension: its own shares to a power (not yet normalised)."""
    return cells.groupBy(dimension).agg(F.pow(F.sum("weight"), F.lit(power)).alias("target"))


def goals_of(cells: DataFrame, dimension: str, shares: DataFrame, total: float) -> DataFrame:
    """k, goal: the weight that each value of a dimension shall have. Values without a share keep their own weight."""
    own = cells.groupBy(dimension).agg(F.sum("weight").alias("w")).join(shares.select(F.col(dimension).alias("k"), "target"), F.col(dimension) == F.col("k"), "left")
    own = materialise(own.select(F.col(dimension).alias("k"), "w", "target"), "targets")
    free = own.agg(F.sum(F.when(F.col("target").isNull(), F.col("w"))).alias("kept"), F.sum("target").alias("given")).first()
    room = total - (free["kept"] or 0.0)
    return own.select("k", F.when(F.col("target").isNull(), F.col("w")).otherwise(F.col("target") * F.lit(room / (free["given"] or 1.0))).alias("goal"))


def _rake_block(dimensions: list[str], rounds: int, tolerance: float):
    """All cells (dimensions, weight, goal_<dimension>) in one frame -> with raked and off, how far the last scales were from 1."""

    def run(table: pa.Table) -> pa.Table:
        raked = table.column("weight").to_numpy().astype(float).copy()
        codes, goals = [], []
        for d in dimensions:
            code = table.column(d).combine_chunks().dictionary_encode().indices.to_numpy()
            goal = np.zeros(code.max() + 1)
            goal[code] = table.column(f"goal_{d}").to_numpy()
            codes.append(code)
            goals.append(goal)
        worst = 0.0
        for _ in range(rounds):
            worst, before = 0.0, raked.copy()
            for code, goal in zip(codes, goals, strict=True):
                sums = np.bincount(code, weights=raked)
                scale = np.divide(goal, sums, out=np.zeros_like(goal), where=sums > 0)
                worst = max(worst, float(np.abs(scale[code] - 1)[raked > 0].max(initial=0.0)))
                raked *= scale[code]
            if worst < tolerance or (np.abs(raked - before) <= STILL * tolerance * before).all():
                break
        kept = table.select([*dimensions, "weight"])
        return kept.append_column("raked", pa.array(raked)).append_column("off", pa.array(np.full(len(raked), worst)))

    return run


def _rake_rounds(cells: DataFrame, dimensions: list[str], rounds: int, tolerance: float) -> DataFrame:
    """The same as Spark jobs, a written table for each round."""
    now = materialise(cells.withColumns({"raked": F.col("weight"), "off": F.lit(0.0)}), "cells")
    for _ in range(rounds):
        step = now.withColumns({"off": F.lit(0.0), "before": F.col("raked")})
        for d in dimensions:
            sums = step.groupBy(d).agg(F.max(f"goal_{d}").alias("goal"), F.sum("raked").alias("s")).select(F.col(d).alias("k"), F.when(F.col("s") > 0, F.col("goal") / F.col("s")).otherwise(0.0).alias("scale"))
            step = step.join(sums, F.col(d) == F.col("k"))
            step = step.withColumns({"off": F.greatest("off", F.when(F.col("raked") > 0, F.abs(F.col("scale") - 1)).otherwise(0.0)), "raked": F.col("raked") * F.col("scale")}).drop("k", "scale")
        after = materialise(step, "cells")
        discard(now)
        now = after.drop("before")
        now._ridgecast_path = after._ridgecast_path
        ended = after.agg(F.max("off").alias("off"), F.count_if(F.abs(F.col("raked") - F.col("before")) > STILL * tolerance * F.col("before")).alias("moved")).first()
        if (ended["off"] or 0.0) < tolerance or not ended["moved"]:
            break
    return now.select(*dimensions, "weight", "raked", "off")


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE, strict: bool = True) -> DataFrame:
    """cells (dimensions, weight > 0) with ratio: raked over original weight.

    targets: dimension -> (value, target), shares of any sum; values without cells are ignored, those without a target keep
    their weight. Up to TASK_CELLS counted cells are raked in one task, more by Spark jobs; the results are the same. Without
    convergence it raises ArithmeticError, or warns if not strict.
    """
    dimensions = list(targets)
    now = materialise(cells, "cells")
    total = now.agg(F.sum("weight")).first()[0] or 1.0
    n = now.count()
    joined = now
    for d, shares in targets.items():
        goal = small(materialise(goals_of(now, d, shares, total), "goals"))
        joined = joined.join(goal.select(F.col("k").alias("__k"), F.col("goal").alias(f"goal_{d}")), F.col(d) == F.col("__k")).drop("__k")
    if n <= TASK_CELLS:
        schema = ", ".join(f"{d} string" for d in dimensions) + ", weight double, raked double, off double"
        ready = materialise(joined.withColumn("__all", F.lit(0)).groupBy("__all").applyInArrow(_rake_block(dimensions, rounds, tolerance), schema), "raked")
    else:
        ready = materialise(_rake_rounds(joined, dimensions, rounds, tolerance), "raked")
    worst = ready.agg(F.max("off")).first()[0] or 0.0
    if worst >= tolerance:
        said = f"raking ended with scales up to {worst:.2g} off: the targets contradict each other or the cells"
        if strict:
            raise ArithmeticError(said)
        warnings.warn(said, stacklevel=2)
    return ready.select(*dimensions, "weight", (F.col("raked") / F.col("weight")).alias("ratio"))


def marginals(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """dimension, value, weight_share, target_share, reached_share of raked cells (dimensions, weight, ratio)."""
    out = None
    total = cells.agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("ratio")).alias("r")).first()
    for d, shares in targets.items():
        goal = goals_of(cells, d, shares, 1.0 * (total["w"] or 1.0)).select("k", (F.col("goal") / F.lit(total["w"] or 1.0)).alias("target_share"))
        own = cells.groupBy(F.col(d).alias("value")).agg((F.sum("weight") / F.lit(total["w"] or 1.0)).alias("weight_share"), (F.sum(F.col("weight") * F.col("ratio")) / F.lit(total["r"] or 1.0)).alias("reached_share"))
        part = own.join(goal, F.col("value") == F.col("k")).select(F.lit(d).alias("dimension"), "value", "weight_share", "target_share", "reached_share")
        out = part if out is None else out.unionByName(part)
    return out


def sampling_constant(cells: DataFrame, fraction: float | None = None) -> float:
    """1 over the largest ratio; with a fraction c such that sum(weight * min(1, c * ratio)) is that part of sum(weight)."""
    ends = cells.agg(F.sum("weight").alias("w"), F.min(F.when(F.col("ratio") > 0, F.col("ratio"))).alias("lo"), F.max("ratio").alias("hi")).first()
    if not ends["w"] or not ends["hi"]:
        return 0.0
    if fraction is None:
        return 1 / ends["hi"]
    low, high = fraction / ends["hi"] / 2, 1 / ends["lo"]
    for _ in range(3):
        grid = [low * (high / low) ** (k / 63) for k in range(64)]
        got = cells.agg(*[F.sum(F.col("weight") * F.least(F.lit(1.0), F.lit(c) * F.col("ratio"))) for c in grid]).first()
        above = [k for k, x in enumerate(got) if x >= fraction * ends["w"]]
        k = above[0] if above else 63
        low, high = grid[max(0, k - 1)], grid[k]
        if high / low < 1 + 1e-9:
            break
    return high


def chances(rows: DataFrame, fraction: float | None = FRACTION, power: float = POWER, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row for each cell of a table of features(): k_<dimension> and k_p, the sampling probability."""
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("weight")).filter("weight > 0")
    cells = materialise(cells, "cells")
    raked = rake(cells, {d: (targets or {}).get(d) or tempered(cells, d, power) for d in DIMENSIONS}, strict=False)
    raked = materialise(raked, "raked")
    c = sampling_constant(raked, fraction)
    return raked.select(*[F.col(d).alias(f"k_{d}") for d in DIMENSIONS], F.least(F.lit(1.0), F.lit(c) * F.col("ratio")).alias("k_p"))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def mix(df: DataFrame, path: str, fraction: float | None = FRACTION, power: float = POWER, targets: dict[str, DataFrame] | None = None, seed: str = "mix", **columns: str) -> DataFrame:
    """One row for each row of df: id, mix_source, mix_lang, topic, n_tokens, probability, sampled.

    targets: shares by dimension (mix_source, mix_lang, topic); tempered marginals where none are given. columns: as in features().
    """
    rows = materialise(features(df, path, **columns), "features")
    known = small(chances(rows, fraction, power, targets))
    out = rows.join(known, [F.col(d) == F.col(f"k_{d}") for d in DIMENSIONS], "left").withColumn("probability", F.coalesce("k_p", F.lit(0.0)))
    return out.withColumn("sampled", draw(F.col("id"), seed) < F.col("probability")).select("id", *DIMENSIONS, "n_tokens", "probability", "sampled")


def keep_sampled(df: DataFrame, path: str, fraction: float | None = FRACTION, power: float = POWER, targets: dict[str, DataFrame] | None = None, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of df that mix() samples, unchanged. The rows themselves are not shuffled: each looks its cell's probability up."""
    rows = materialise(features(df, path, id_col, source_col, lang_col, text_col), "features")
    known = chances(rows, fraction, power, targets)
    other = {c: unused(df, f"__{c}") for c in known.columns}
    known = small(known.select(*[F.col(c).alias(n) for c, n in other.items()]))
    own = [unused(df, f"__{d}") for d in DIMENSIONS]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topic = _FORM_NAMES.take(pa.array(form_topics(*text_buffer(batch.column(text_col)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, topic], names=[*batch.schema.names, own[2]])

    named = df.mapInArrow(name, T.StructType([*df.schema.fields, T.StructField(own[2], T.StringType())]))
    named = named.withColumns({own[0]: _known(F.col(source_col)), own[1]: _known(F.col(lang_col))})
    found = named.join(known, [F.col(o) == F.col(other[f"k_{d}"]) for o, d in zip(own, DIMENSIONS, strict=True)])
    return found.filter(draw(F.col(id_col).cast("long"), seed) < F.col(other["k_p"])).select(df.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    rows = mix(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"))
    return rows.select(F.col("id").alias("doc_id"), F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), "topic", "n_tokens", "probability", "sampled")
