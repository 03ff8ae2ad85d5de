"""Exact deduplication over a sharded cuckoo-filter index of content digests.

Texts are equal when they are identical after deleting ASCII white space. Each text becomes the SHA-256 of
that normal form; the index holds one stored key per live digest. A cuckoo filter in front answers "not here"
without touching the stored keys; a hit is verified against the keys of its content bucket, so a false positive
of the filter never merges two texts. When an insertion finds no free slot the filter is rebuilt at twice
the size from the stored keys. The index table holds the keys and, for each shard, the filter itself, so that updates and
look-ups start from the stored filter.

A live index also keeps its members (one row for each inserted row). A deletion removes the members that it names, and nothing if
there are none; the digests it touches elect their next representative from the members that are left, or leave the filter and
the keys with the last one.

Skew: every scan task first folds its own rows into a local index, so a digest reaches its shard at most once per
task, however many copies there are. The join back to the rows deals the rows of a digest with very many copies over several
tasks.

Defined cases: a null text counts as empty; of equal texts the row with most code points, then the smallest id (a null id comes
last), stays, and of rows that tie in both exactly one; rows repeated with the same id are counted each; an empty table gives an
empty result; other columns are ignored by exact_dedup() and kept by drop_copies().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, documents, materialise, python_workers, small, unused
from .components import HEAVY, spread_join

#: Target number of stored keys in one shard.
SHARD_KEYS = 250_000
SLOTS = 4
MAX_KICKS = 200

#: keep_row: the representative's row number in the table that brought it. A shard's filter is a row of its own, without a digest.
KEYS_SCHEMA = "shard int, digest binary, keep_id long, keep_chars long, n long, keep_row long, filter binary"
PARTIAL_SCHEMA = "digest binary, keep_id long, keep_chars long, n long, keep_row long"
_PARTIAL_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_chars", pa.int64()), ("n", pa.int64()), ("keep_row", pa.int64())])
#: What a change does to a key: add copies, put a new representative and count in its place, take it out.
INSERT, REPLACE, REMOVE = 0, 1, 2


class CuckooFilter:
    """A set of 16-bit fingerprints with two candidate buckets each; supports deletion."""

    def __init__(self, n_buckets: int = 1024):
        self.mask = n_buckets - 1
        self.table: list[list[int]] = [[] for _ in range(n_buckets)]

    def to_bytes(self) -> bytes:
        slots = np.zeros((len(self.table), SLOTS), "<u2")
        for k, bucket in enumerate(self.table):
            slots[k, : len(bucket)] = bucket
        return slots.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        slots = np.frombuffer(raw, "<u2").reshape(-1, SLOTS).tolist()
        out = cls(1)
        out.mask, out.table = len(slots) - 1, [[fp for fp in bucket if fp] for bucket in slots]
        return out

    @staticmethod
    def fingerprint(digest: bytes) -> int:
        return (digest[8] << 8 | digest[9]) or 1

    def buckets(self, digest: bytes) -> tuple[int, int, int]:
        fp = self.fingerprint(digest)
        first = int.from_bytes(digest[:8], "big") & self.mask
        return fp, first, self._other(first, fp)

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x9E3779B1)) & self.mask

    def contains(self, digest: bytes) -> bool:
        fp, a, b = self.buckets(digest)
        return fp in self.table[a] or fp in self.table[b]

    def insert(self, digest: bytes) -> bool:
        """False when no slot could be freed; the table may then have lost one fingerprint and must be rebuilt."""
        fp, a, b = self.buckets(digest)
        for bucket in (a, b):
            if len(self.table[bucket]) < SLOTS:
                self.table[bucket].append(fp)
                return True
        at = b
        for kick in range(MAX_KICKS):
            slots = self.table[at]
            k = kick % SLOTS
            slots[k], fp = fp, slots[k]
            at = self._other(at, fp)
            if len(self.table[at]) < SLOTS:
                self.table[at].append(fp)
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        fp, a, b = self.buckets(digest)
        for bucket in (a, b):
            if fp in self.table[bucket]:
                self.table[bucket].remove(fp)
                return True
        return False


class CuckooIndex:
    """Live digests of one shard: the filter, and stored keys in content buckets."""

    def __init__(self, n_buckets: int = 1024):
        self.filter = CuckooFilter(n_buckets)
        self.content: dict[int, list[list]] = {}
        self.live = 0
        self.rebuilds = 0

    @staticmethod
    def _address(digest: bytes) -> int:
        return int.from_bytes(digest[10:16], "big")

    def find(self, digest: bytes) -> list | None:
        """The stored key [digest, keep_id, keep_chars, n, keep_row], or None. The filter goes first."""
        if not self.filter.contains(digest):
            return None
        for key in self.content.get(self._address(digest), ()):
            if key[0] == digest:
                return key
        return None

    def load(self, keys: list[list], stored: bytes | None) -> None:
        """Stored keys with the filter that was stored with them (built anew without one)."""
        for key in keys:
            self.content.setdefault(self._address(key[0]), []).append(key)
        self.live = len(keys)
        if stored is not None:
            self.filter = CuckooFilter.from_bytes(stored)
        elif not all(self.filter.insert(key[0]) for key in keys):
            self._rebuild()

    def insert(self, digest: bytes, keep_id: int | None, keep_chars: int, n: int = 1, keep_row: int = 0) -> None:
        key = self.find(digest)
        if key is None:
            self.content.setdefault(self._address(digest), []).append([digest, keep_id, keep_chars, n, keep_row])
            self.live += 1
            if not self.filter.insert(digest):
                self._rebuild()
            return
        key[3] += n
        if _better((keep_chars, keep_id, keep_row), (key[2], key[1], key[4])):
            key[1], key[2], key[4] = keep_id, keep_chars, keep_row

    def replace(self, digest: bytes, keep_id: int | None, keep_chars: int, n: int, keep_row: int = 0) -> bool:
        """Another representative and count for a live digest."""
        key = self.find(digest)
        if key is None:
            return False
        key[1:] = [keep_id, keep_chars, n, keep_row]
        return True

    def delete(self, digest: bytes) -> bool:
        """Take a digest out of the stored keys and the filter."""
        key = self.find(digest)
        if key is None:
            return False
        bucket = self.content[self._address(digest)]
        bucket.remove(key)
        if not bucket:
            del self.content[self._address(digest)]
        self.filter.delete(digest)
        self.live -= 1
        return True

    def _rebuild(self) -> None:
        """Twice the buckets, filled again from the stored keys (again, until all fit)."""
        n = 2 * (self.filter.mask + 1)
        while True:
            self.rebuilds += 1
            fresh = CuckooFilter(n)
            if all(fresh.insert(key[0]) for bucket in self.content.values() for key in bucket):
                self.filter = fresh
                return
            n *= 2

    def keys(self) -> Iterator[list]:
        for bucket in self.content.values():
            yield from bucket


def _better(one: tuple, other: tuple) -> bool:
    """Whether (chars, id, row) stays before another: most code points, smallest id with null last, first row."""
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    return rank(one) < rank(other)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars (code points of the original text), digest of the text without white space, row (a number of its own)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("n_chars"),
        F.unhex(F.sha2(F.translate(text, SPACES, "").cast("binary"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )


def _emit(index: CuckooIndex, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[] for _ in _PARTIAL_ARROW]
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PARTIAL_ARROW, strict=True)], schema=_PARTIAL_ARROW)
    for key in index.keys():
        for column, value in zip(out, key, strict=True):
            column.append(value)
        if len(out[0]) >= rows:
            yield batch()
            out = [[] for _ in _PARTIAL_ARROW]
    if out[0]:
        yield batch()


def _fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's rows into a local index: doc_id, n_chars, digest, row -> stored keys."""
    index = CuckooIndex()
    for batch in batches:
        ids, chars, digest, row = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "n_chars", "digest", "row"))
        for d, c, h, r in zip(ids, chars, digest, row, strict=True):
            index.insert(h, d, c, 1, r)
    yield from _emit(index)


def _shard_of(n_shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n_shards)).cast("int")


_FIELDS = ("digest", "keep_id", "keep_chars", "n", "keep_row")


def _apply_shard(stored: pa.Table, changes: pa.Table) -> pa.Table:
    """Stored keys and filter of a shard after its changes (one for each digest and kind, of which insertions come last)."""
    index = CuckooIndex()
    shard = (stored if stored.num_rows else changes).column("shard")[0].as_py()
    rows = stored.to_pylist()
    index.load([[row[f] for f in _FIELDS] for row in rows if row["digest"] is not None], next((row["filter"] for row in rows if row["digest"] is None), None))
    for row in sorted(changes.to_pylist(), key=lambda x: -x["op"]):
        if row["op"] == REMOVE:
            index.delete(row["digest"])
        elif row["op"] == REPLACE:
            index.replace(*(row[f] for f in _FIELDS))
        else:
            index.insert(*(row[f] for f in _FIELDS))
    keys = [*index.keys(), [None] * len(_FIELDS)]
    columns = {"shard": pa.array([shard] * len(keys), pa.int32())}
    for k, (name, kind) in enumerate(zip(_FIELDS, _PARTIAL_ARROW.types, strict=True)):
        columns[name] = pa.array([key[k] for key in keys], kind)
    columns["filter"] = pa.array([None] * (len(keys) - 1) + [index.filter.to_bytes()], pa.binary())
    return pa.table(columns)


def update_index(index: DataFrame | None, n_shards: int, changes: DataFrame) -> DataFrame:
    """The index table after changes (op, digest, keep_id, keep_chars, n, keep_row). n_shards must stay the same for an index."""
    changes = changes.withColumn("shard", _shard_of(n_shards)).select("shard", "op", *_FIELDS)
    if index is None:
        index = changes.sparkSession.createDataFrame([], KEYS_SCHEMA)
    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_apply_shard, KEYS_SCHEMA)


def insertions(rows: DataFrame) -> DataFrame:
    """Changes that insert rows of digests()."""
    return rows.select("doc_id", "n_chars", "digest", "row").mapInArrow(_fold_rows, PARTIAL_SCHEMA).withColumn("op", F.lit(INSERT))


def keys_of(index: DataFrame) -> DataFrame:
    return index.filter("digest is not null").select("digest", "keep_id", "keep_chars", "n", "keep_row")


@dataclass
class LiveIndex:
    """An index that takes insertions and deletions: the index table (None: nothing yet) and its members (digest, doc_id, n_chars)."""

    n_shards: int
    table: DataFrame | None = None
    members: DataFrame | None = None

    def insert(self, rows: DataFrame) -> LiveIndex:
        """With the rows of digests() inserted."""
        python_workers(rows.sparkSession)
        rows = materialise(rows, "inserted")
        new = rows.select("digest", "doc_id", "n_chars")
        table = materialise(update_index(self.table, self.n_shards, insertions(rows)), "index")
        return LiveIndex(self.n_shards, table, materialise(new if self.members is None else self.members.union(new), "members"))

    def delete(self, rows: DataFrame) -> LiveIndex:
        """Without the members that have the digest and id of a row of digests(); rows that name no member change nothing."""
        if self.members is None:
            return self
        python_workers(rows.sparkSession)
        named = materialise(rows.select(F.col("digest").alias("d"), F.col("doc_id").alias("i")).distinct(), "deleted")
        same = (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i"))
        touched = materialise(self.members.join(named, same, "left_semi").select(F.col("digest").alias("t")).distinct(), "touched")
        left = materialise(self.members.join(named, same, "left_anti"), "members")
        best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i")))
        elected = left.join(touched, F.col("digest") == F.col("t"), "left_semi").groupBy("digest").agg(best.alias("b"), F.count(F.lit(1)).alias("n"))
        elected = elected.select(F.col("digest").alias("e"), F.col("b.i").alias("keep_id"), (-F.col("b.c")).alias("keep_chars"), "n")
        changes = touched.join(elected, F.col("t") == F.col("e"), "left").select(F.col("t").alias("digest"), "keep_id", "keep_chars", "n", F.lit(0).cast("long").alias("keep_row"), F.when(F.col("e").isNull(), REMOVE).otherwise(REPLACE).alias("op"))
        return LiveIndex(self.n_shards, materialise(update_index(self.table, self.n_shards, changes), "index"), left)

    def lookup(self, rows: DataFrame) -> DataFrame:
        """rows of digests() with keep_id and group_size of their stored key (null where the digest isn't live).

        Distinct digests go through the stored filters first; only hits meet the stored keys.
        """
        python_workers(rows.sparkSession)
        probes = rows.select("digest").distinct().withColumn("shard", _shard_of(self.n_shards))
        filters = self.table.filter("digest is null").select("shard", "filter")

        def hits(stored: pa.Table, asked: pa.Table) -> pa.Table:
            known = CuckooFilter.from_bytes(stored.column("filter")[0].as_py()) if stored.num_rows else None
            return pa.table({"hit": pa.array([d for d in asked.column("digest").to_pylist() if known and known.contains(d)], pa.binary())})

        found = filters.groupBy("shard").cogroup(probes.groupBy("shard")).applyInArrow(hits, "hit binary")
        keys = keys_of(self.table).join(found, F.col("digest") == F.col("hit")).select(F.col("digest").alias("k"), "keep_id", F.col("n").alias("group_size"))
        return rows.join(keys, F.col("digest") == F.col("k"), "left").drop("k")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars."""
    spark = df.sparkSession
    python_workers(spark)
    rows = materialise(digests(df, id_col, text_col), "digests")
    n_shards = max(1, -(-rows.count() // shard_keys), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = materialise(keys_of(update_index(None, n_shards, insertions(rows))), "keys")
    heavy = materialise(keys.filter(F.col("n") > HEAVY).select(F.col("digest").alias("hk"), F.ceil(F.col("n") / HEAVY).cast("int").alias("parts")), "heavy")
    keys = keys.select(F.col("digest").alias("k"), "keep_id", F.col("n").alias("group_size"), "keep_row")
    found = spread_join(rows, keys, {"digest": "k"}, None if heavy.isEmpty() else small(heavy))
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_chars")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that exact_dedup() keeps, unchanged.

    Ids decide wherever an id is on one row. Where rows of different texts share an id, their digests decide, and of rows that
    differ in nothing but white space and other columns one stays.
    """
    found = materialise(exact_dedup(df, id_col, text_col), "exact")
    i, stay, n, sha, chars, digest = (unused(df, f"__{c}") for c in ("i", "stay", "n", "sha", "chars", "digest"))
    by_id = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"), F.count_if("kept").alias("k")).filter("k = 0 or m > 1")
    by_id = materialise(by_id.select(F.col("doc_id").alias(i), F.col("k").alias(stay)), "ids")
    own = F.col(id_col).cast("long").eqNullSafe(F.col(i))
    some = by_id.filter(F.col(stay) > 0)
    kept = df.join(small(by_id.filter(F.col(stay) == 0)), own, "left_anti")
    if some.isEmpty():
        return kept
    plain, odd = kept.join(small(some), own, "left_anti"), kept.join(small(some), own, "left_semi")
    text = F.coalesce(F.col(text_col), F.lit(""))
    odd = odd.withColumns({n: F.length(text).cast("long"), sha: F.sha2(F.translate(text, SPACES, "").cast("binary"), 256)})
    right = materialise(found.filter("kept").select(F.col("doc_id").alias(i), F.col("n_chars").alias(chars), F.col("text_sha256").alias(digest)).distinct(), "right")
    odd = odd.join(small(right), own & (F.col(n) == F.col(chars)) & (F.col(sha) == F.col(digest)), "left_semi")
    whole = F.struct(*[F.col(c) for c in df.columns])  # columns of any type, which JSON puts in an order
    one = odd.groupBy(id_col, sha).agg(F.min_by(whole, F.sha2(F.to_json(whole).cast("binary"), 256)).alias("one")).select("one.*")
    return plain.unionByName(one)


def op10(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("n_chars")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM w
"""
