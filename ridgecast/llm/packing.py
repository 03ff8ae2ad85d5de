"""Packing of token pieces into fixed-capacity sequences: dominance reduction, then best fit.

The number of sequences depends only on how many pieces have each length, so the plan is made on that histogram (at most
`capacity` numbers, whatever the corpus) and holds runs of equal sequences. Pieces then get their places by rank
within their length.

Reduction (after Martello and Toth): a set of pieces that contains piece j and dominates every other feasible set with j
is fixed for good and leaves the instance, until no length allows a step:
  - j alone, if not even the shortest remaining piece fits beside it;
  - j and a piece of exactly the free length (any other company of j can be swapped for that piece);
  - j and the longest piece that fits, if no two pieces fit beside j together;
  - j and the longest piece that fits, if at most two fit together and no such pair is longer than it.
Best fit, longest first, packs what is left: each piece goes to the open sequence with the least sufficient room.

Ranks come without a global sort: each task numbers its own pieces of each length while tokenising, a small table of
counts by task and length gives each task's first rank, and an equi-join adds the two. A length that a third of all
pieces share is spread over tasks like any other.

Defined cases: a null or empty text is one piece that holds the end token alone; repeated rows are packed each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, materialise, python_workers, tokenizer_path

CAPACITY = 1024
END_ID = 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE vocabulary as a tiktoken encoding; its ids equal those of the tokenizers file of the same name."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: 50256})
    return _ENCODERS[path]


#: What the vocabulary's pattern takes for white space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space from this length on are taken out of a text before the pattern, which backtracks over each, is matched.
LONG_RUN = 4096
_LONG_RUNS = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")
SPECIAL = "<|endoftext|>"


def encode(path: str, text: str | None) -> np.ndarray:
    """Ids as unsigned 32-bit numbers; the special string inside a text is its own id.

    The pattern makes one piece of a run of white space but its last character, which goes to the word behind it, and of the whole run at the end of a
    text or before the special string. Ids of pieces don't depend on each other, so long runs are encoded as the pieces that they are.
    """
    text, known = text or "", encoder(path)
    parts, at = [], 0
    for run in _LONG_RUNS.finditer(text):
        end = run.end()
        if end < len(text) and not text.startswith(SPECIAL, end):
            end -= 1
        parts += [known.encode_to_numpy(text[at : run.start()], allowed_special="all"), np.array(known._encode_single_piece(text[run.start() : end]), np.uint32)]
        at = end
    rest = known.encode_to_numpy(text[at:], allowed_special="all")
    return np.concatenate([*parts, rest]) if parts else rest


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of the pieces; only the first may be shorter than capacity."""
    first = len(ids) % capacity
    edges = [*([0] if first else []), *range(first, len(ids), capacity), len(ids)]
    return [(a, ids[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def tokenise(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every text: doc_id, piece, start, length, ids_crc32, the task (part) and the rank within part and length; on demand the ids."""
    python_workers(df.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(path, text), np.uint32(end_id)).astype("<u4")
                for k, (start, own) in enumerate(cut(ids, capacity)):
                    raw = own.tobytes()
                    rows.append((doc_id, k, start, len(own), zlib.crc32(raw), part, seen[len(own)], *((raw,) if with_ids else ())))
                    seen[len(own)] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"][: 7 + with_ids]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=False)], names=names)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(pieces, PIECES + (", ids binary" if with_ids else ""))


Run = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many) of a sequence, ...), number of such sequences


class _Lengths:
    """How many pieces of each length are left."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.int64).copy()

    def present(self, low: int, high: int) -> np.ndarray:
        return low + np.flatnonzero(self.n[low : high + 1]) if high >= low else np.zeros(0, np.int64)

    def smallest(self, k: int, without: int) -> int | None:
        """The sum of the k shortest pieces, one piece of length `without` put aside; None if there are fewer."""
        total = 0
        for size in self.present(1, len(self.n) - 1):
            take = min(k, int(self.n[size]) - (size == without))
            total, k = total + take * int(size), k - take
            if k == 0:
                return total
        return None


def reduce_dominated(counts: np.ndarray, capacity: int) -> tuple[list[Run], np.ndarray]:
    """Fixed runs and the counts that remain."""
    left, runs = _Lengths(counts), []
    changed = True
    while changed:
        changed = False
        for j in left.present(1, capacity)[::-1]:
            j = int(j)
            while left.n[j]:
                partner = _dominating(left, j, capacity)
                if partner is None:
                    break
                m = int(left.n[j]) if partner == 0 else int(left.n[j]) // 2 if partner == j else int(min(left.n[j], left.n[partner]))
                left.n[j] -= m
                if partner:
                    left.n[partner] -= m
                runs.append((((j, 1),) if partner == 0 else ((j, 2),) if partner == j else ((j, 1), (partner, 1)), m))
                changed = True
    return runs, left.n


def _dominating(left: _Lengths, j: int, capacity: int) -> int | None:
    """The one piece that with j dominates all other sets with j; 0 for j alone; None if no such set is known."""
    room = capacity - j
    least = left.smallest(1, j)
    if least is None or least > room:
        return 0
    others = left.n.copy()
    others[j] -= 1
    best = int(np.flatnonzero(others[: room + 1])[-1])
    if best == room:
        return best
    two = left.smallest(2, j)
    if two is None or two > room:
        return best
    three = left.smallest(3, j)
    if three is not None and three <= room:
        return None
    sizes = np.flatnonzero(others[: room + 1])
    for a in sizes:  # the longest pair that fits
        fits = sizes[: np.searchsorted(sizes, room - a, "right")]
        fits = fits[(fits != a) | (others[fits] > 1)]
        if len(fits) and a + fits[-1] > best:
            return None
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[Run]:
    """Best fit, longest first, on equal sequences at once."""
    open_: dict[int, list[list]] = {}  # room -> [contents, how many]
    for size in np.flatnonzero(counts)[::-1]:
        size, n = int(size), int(counts[size])
        for room in sorted(r for r in open_ if r >= size):
            each = room // size
            groups, open_[room] = open_[room], []
            for contents, m in groups:
                full = min(m, n // each)
                if full:
                    open_.setdefault(room - each * size, []).append([(*contents, (size, each)), full])
                    n, m = n - full * each, m - full
                if n and m:  # fewer than `each` are left: one more sequence takes them
                    open_.setdefault(room - n * size, []).append([(*contents, (size, n)), 1])
                    n, m = 0, m - 1
                if m:
                    open_[room].append([contents, m])
            if not open_[room]:
                del open_[room]
            if not n:
                break
        each = capacity // size
        for k, m in ((each, n // each), (n % each, 1)):
            if k and m:
                open_.setdefault(capacity - k * size, []).append([((size, k),), m])
    return [(contents, m) for groups in open_.values() for contents, m in groups]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Run]:
    """Runs of equal sequences that hold exactly counts[length] pieces of each length."""
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(runs: list[Run], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where each rank of each length goes: rows sorted by (length, first rank); sequence = first sequence + rank - first rank."""
    used, first, rows = np.zeros(capacity + 1, np.int64), 0, []
    for contents, m in runs:
        offset = 0
        for size, k in contents:
            for _ in range(k):
                rows.append((size, used[size], first, offset))
                used[size] += m
                offset += size
        first += m
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a table of tokenise(), on disk) with sequence_id and offset."""
    spark = pieces.sparkSession
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = by_part.select(F.col("part").alias("p"), F.col("length").alias("l"), (F.sum("n").over(order) - F.col("n")).alias("first"))
    places = spark.sparkContext.broadcast(slots(plan(counts, capacity), capacity))  # bounded by the capacity, not by the rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = places.value
        start = np.searchsorted(known["length"], np.arange(capacity + 2))
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(length), np.int64)
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                a, b = start[size], start[size + 1]
                at[mine] = a + np.searchsorted(known["rank"][a:b], rank[mine], "right") - 1
            sequence = known["sequence"][at] + rank - known["rank"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(known["offset"][at])], names=[*batch.schema.names, "sequence_id", "offset"])

    ranked = pieces.join(firsts, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).withColumn("rank", F.col("rank") + F.col("first")).drop("p", "l", "first", "part")
    schema = T.StructType([*ranked.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema).drop("rank")


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset; on demand the pieces' ids (little-endian 32-bit)."""
    return pack(materialise(tokenise(df, path, id_col, text_col, capacity, end_id, with_ids), "pieces"), capacity)


def op1(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"))
