"""Training-order materialisation of token ids in fixed-stride binary shards.

Texts are tokenised and, within each task, joined and cut into sequences of a fixed length. Every sequence has a global
index (the task's first index plus its place in the task); a keyed Feistel network with cycle-walking permutes
0 .. n - 1, and the image is the sequence's slot in training order. Shard k holds slots k * per_shard onwards, one
fixed-size record for each, so slot s lies at byte (s mod per_shard) * stride of shard s div per_shard: a reader
goes through files front to back and resumes anywhere by arithmetic.

A range partition holds a run of shards, sorted by slot; one task writes them one after the other, each under a temporary name that is
then renamed: a retried task writes the same bytes again. Shards are about 1 GB where there are enough sequences to keep the cores
busy with such shards, and smaller below that (a power of two of at least LEAST_SHARD sequences); a manifest beside them says how
many sequences each holds. Ids take two bytes where the vocabulary allows it, four otherwise; the last
sequence of a task is padded with the end id.

On the way (the written table of sequences and the shuffle) each sequence is compressed: ids become ranks by frequency in a
bounded sample of documents, frequent ranks take one byte, and zstd does the rest. This changes sizes only, never results.

Defined cases: a null or empty text contributes its end id; repeated rows are written each; an empty table gives no shards;
other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fresh_path, materialise, python_workers, small, tokenizer_path
from .packing import END_ID, encode

LENGTH = 1024
#: Sequences in a shard: at most (1 GB of two-byte ids), and at least.
MOST_SHARD, LEAST_SHARD = 1 << 19, 1 << 12
#: Range partitions at most; beyond that each holds several shards.
PARTITIONS = 20_000
KEY = 0x5EED
FEISTEL_ROUNDS = 6
#: Documents (about) from which the ranks come.
RANK_DOCS = 2000
#: Ranks of one byte, and first rank that needs more than two.
ONE_BYTE, TWO_BYTES = 192, 192 + 63 * 256

SEQUENCES = "part int, local long, n_tokens int, doc_ids array<long>, ids binary"
MANIFEST = "n long, length int, per_shard long, id_bytes int, key long"
WRITTEN = "slot long, shard long, byte_offset long, n_tokens int, doc_ids array<long>, ids_crc32 long, path string"


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1, applied to each index."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.array([(key + (r + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF], np.uint64) for r in range(FEISTEL_ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            f = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(29))) & mask)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while (outside := np.flatnonzero(out >= np.uint64(n))).size:  # walk the cycle back into the range
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def frequent_ids(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", docs: int = RANK_DOCS) -> np.ndarray:
    """The most frequent ids of a hash sample of documents, most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = np.unique(np.concatenate([encode(path, t) for t in batch.column("text").to_pylist()] or [np.zeros(0, np.uint32)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["id", "n"])

    python_workers(df.sparkSession)
    rate = min(1.0, docs / max(1, df.count()))
    sample = df.filter(F.pmod(F.xxhash64(id_col, F.lit("ranks")), F.lit(1 << 20)) < int(rate * (1 << 20))).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = sample.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(TWO_BYTES)
    return np.array([r["id"] for r in found.collect()], np.int64)


def ranks_of(frequent: np.ndarray, size: int = 1 << 16) -> np.ndarray:
    ranks = np.full(size, TWO_BYTES, np.int32)
    ranks[frequent] = np.arange(len(frequent))
    return ranks


def compress_ids(ids: np.ndarray, ranks: np.ndarray) -> bytes:
    """Two-byte ids: a plane of one byte each, the second bytes of middling ranks, then the rare ids themselves."""
    k = ranks[ids]
    middle, rare = (k >= ONE_BYTE) & (k < TWO_BYTES), k >= TWO_BYTES
    low = np.where(middle, ONE_BYTE + (k - ONE_BYTE) // 256, np.where(rare, 255, k)).astype(np.uint8)
    high = ((k[middle] - ONE_BYTE) % 256).astype(np.uint8)
    return zstandard.compress(low.tobytes() + high.tobytes() + ids[rare].astype("<u2").tobytes())


def expand_ids(raw: bytes, n: int, frequent: np.ndarray) -> np.ndarray:
    """The n ids that compress_ids() was given."""
    data = np.frombuffer(zstandard.decompress(raw), np.uint8)
    low = data[:n].astype(np.int64)
    middle, rare = (low >= ONE_BYTE) & (low < 255), low == 255
    second = n + int(middle.sum())
    low[middle] = ONE_BYTE + (low[middle] - ONE_BYTE) * 256 + data[n:second]
    out = np.empty(n, "<u2")
    out[~rare] = frequent[low[~rare]]
    out[rare] = data[second:].view("<u2")
    return out


def sequences(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, frequent: np.ndarray | None = None) -> DataFrame:
    """Full sequences of each task's texts: part, local, n_tokens (before padding), doc_ids, ids.

    ids are compressed by the ranks of the frequent ids; without any they are plain four-byte numbers.
    """
    python_workers(df.sparkSession)
    ranks = None if frequent is None else ranks_of(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local = TaskContext.get().partitionId(), 0
        ids, owners = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        known: list[int] = []

        def batch_of(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            nonlocal local
            padded = [np.append(i, np.full(length - len(i), end_id, np.uint32)) for i, _ in rows]
            full = [i.astype("<u4").tobytes() if ranks is None else compress_ids(i, ranks) for i in padded]
            docs = [[known[k] for k in dict.fromkeys(o.tolist())] for _, o in rows]
            local += len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int32()), pa.array(range(local - len(rows), local), pa.int64()), pa.array([len(i) for i, _ in rows], pa.int32()), pa.array(docs, pa.list_(pa.int64())), pa.array(full, pa.binary())],
                names=["part", "local", "n_tokens", "doc_ids", "ids"],
            )

        for batch in batches:
            new = [np.append(encode(path, t), np.uint32(end_id)) for t in batch.column("text").to_pylist()]
            held = [known[k] for k in dict.fromkeys(owners.tolist())]
            owners = np.searchsorted(np.unique(owners), owners)
            known = held + batch.column("doc_id").to_pylist()
            ids = np.concatenate([ids, *new])
            owners = np.concatenate([owners, np.repeat(np.arange(len(held), len(known)), [len(x) for x in new])])
            cut = len(ids) // length * length
            if cut:
                yield batch_of([(ids[a : a + length], owners[a : a + length]) for a in range(0, cut, length)])
                ids, owners = ids[cut:], owners[cut:]
        if len(ids):
            yield batch_of([(ids, owners)])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SEQUENCES)


def shard_size(n: int, cores: int) -> int:
    """Sequences for each shard: as many as leave four shards for each core, within the bounds."""
    return min(MOST_SHARD, max(LEAST_SHARD, 1 << max(0, (n // (4 * cores)).bit_length() - 1)))


def with_slots(table: DataFrame, key: int = KEY, per_shard: int | None = None) -> tuple[DataFrame, int, int]:
    """A table of sequences() on disk with slot and shard; the number of sequences; how many a shard holds."""
    spark = table.sparkSession
    counts = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each task
    n = sum(c for _, c in counts)
    size = per_shard or shard_size(n, spark.sparkContext.defaultParallelism)
    firsts = np.concatenate([[0], np.cumsum([c for _, c in counts])])
    firsts = spark.createDataFrame([(p, int(f)) for (p, _), f in zip(counts, firsts, strict=False)], "p int, first long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permute(batch.column("index").to_numpy(), n, key)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot), pa.array(slot // size)], names=[*batch.schema.names, "slot", "shard"])

    indexed = table.join(small(firsts), F.col("part") == F.col("p")).select("n_tokens", "doc_ids", "ids", (F.col("local") + F.col("first")).alias("index"))
    schema = T.StructType([*indexed.schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.LongType())])
    return indexed.mapInArrow(run, schema), n, size


def _write(out_dir: str, per_shard: int, length: int, frequent: np.ndarray | None):
    """Rows of one partition, sorted by slot, to their shard's file; one row for each written record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(out_dir)
        store.create_dir(base, recursive=True)
        now, file, temporary = None, None, ""

        def close() -> None:
            if file is not None:
                file.close()
                store.move(temporary, f"{base}/shard-{now:08d}.bin")

        for batch in batches:
            slots, shards, ids = batch.column("slot").to_numpy(), batch.column("shard").to_numpy(), batch.column("ids").to_pylist()
            ids = ids if frequent is None else [expand_ids(x, length, frequent).tobytes() for x in ids]
            for shard, raw in zip(shards, ids, strict=True):
                if shard != now:
                    close()
                    now, temporary = int(shard), f"{base}/.shard-{shard:08d}-{uuid.uuid4().hex}"
                    file = store.open_output_stream(temporary)
                file.write(raw)
            stride = len(ids[0]) if ids else 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(slots), pa.array(shards), pa.array(slots % per_shard * stride), batch.column("n_tokens"), batch.column("doc_ids"),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([f"{out_dir}/shard-{k:08d}.bin" for k in shards], pa.string()),
                ],
                names=["slot", "shard", "byte_offset", "n_tokens", "doc_ids", "ids_crc32", "path"],
            )
        close()

    return run


def materialise_order(df: DataFrame, path: str, out_dir: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, per_shard: int | None = None, key: int = KEY, wide: bool = False) -> DataFrame:
    """Write the shards under out_dir when the result is read (the manifest at once); one row for each sequence, with its place."""
    frequent = None if wide else frequent_ids(df, path, id_col, text_col)
    table, n, size = with_slots(materialise(sequences(df, path, id_col, text_col, length, frequent=frequent), "sequences"), key, per_shard)
    shards = max(1, -(-n // size))
    partitions = min(shards, PARTITIONS)
    df.sparkSession.createDataFrame([(n, length, size, 4 if wide else 2, key)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{out_dir}/manifest")
    run = F.floor(F.col("shard") * partitions / shards).cast("int")
    return table.repartitionById(partitions, run).sortWithinPartitions("slot").mapInArrow(_write(out_dir, size, length, frequent), WRITTEN)


def read_manifest(spark, out_dir: str) -> dict:
    """n, length, per_shard, id_bytes, key of a written order."""
    return spark.read.schema(MANIFEST).json(f"{out_dir}/manifest").first().asDict()


def read_order(out_dir: str, n: int, length: int, per_shard: int, id_bytes: int = 2, key: int = KEY, start: int = 0) -> Iterator[np.ndarray]:
    """The id sequences of slots start .. n - 1, one shard after the other (read_order(out_dir, **read_manifest(spark, out_dir)))."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(out_dir)
    kind = np.dtype(f"<u{id_bytes}")
    stride, slot = length * kind.itemsize, start
    while slot < n:
        with store.open_input_file(f"{base}/shard-{slot // per_shard:08d}.bin") as file:
            file.seek(slot % per_shard * stride)
            while slot < n and (raw := file.read(stride)):
                yield np.frombuffer(raw, kind)
                slot += 1


def op6(spark, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "shards")
    out = out if "://" in out else f"file://{out}"
    return materialise_order(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"), out).drop("path")
