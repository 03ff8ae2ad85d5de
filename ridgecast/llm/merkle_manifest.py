"""A Merkle manifest of a table: hash trees over ordered rows, and each row's proof, by nested-interval labels.

Every row is a leaf. The leaves of a group (a language) stand in order and have ranks 0, 1, ...; a node of its tree is labelled with the
interval of leaf ranks [lo, hi] that it covers. Every two consecutive nodes of a level (the last may be alone) become one node of the
next, until one remains, the group's subroot. The subroots, in the order of their groups, are the leaves of one more tree, whose top is the root.

Labels do the work of pointers: a node is an ancestor of all whose interval its own contains, and the siblings of a node are the
interval difference between its parent and itself. Levels are taken in bands of BAND: within a band, a node's bucket is the top node of
the band that covers it, so containment joins are joins by (tree, bucket) of at most 2 ** BAND nodes of the band's lowest level with
as many above them, however large a tree is. Trees are built band by band upwards, and paths (siblings with their sides, up to the root)
handed down band by band, the band's top node bringing the path of all above it. Each leaf is shuffled a fixed number of times
and no list grows with the number of rows but a path, which grows with its logarithm.

Ranks come from a range partitioning by (group, order, digest): a row's place in its partition, less the place of the group's first row
there, plus the group's rows in earlier partitions. No task reads more of a group than a partition.

Digests are SHA-256; a node hashes its children's digests as lowercase hexadecimal text, one after the other. A leaf hashes its
fields: `-` for null, else the number of UTF-8 bytes, `:` and the value.

Defined cases: null fields are `-`; a null group is a group, the first; null orders come first; rows with the same order stand by their
digest, and rows alike in all fields are leaves each, with proofs each; a group of one row has its leaf for a subroot, and a table of one
group its subroot for the root; very long texts are hashed whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, materialise, python_workers, small

#: Levels handled together; a group of a containment join has at most 2 ** BAND nodes on its lowest level.
BAND = 10
#: Bytes of a path's entry: the sibling's side (L, R, or - for none) and its digest.
ENTRY = 33
ALONE = b"-" + bytes(ENTRY - 1)
#: The one tree over all subroots.
TOP = "top"

NODES = "tree string, level int, lo long, hi long, n long, digest binary"
_NODES = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])


def combine(*digests: bytes) -> bytes:
    """A node's digest: of its children's, as hexadecimal text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    for k in range(0, len(path), ENTRY):
        side, sibling = path[k : k + 1], path[k + 1 : k + ENTRY]
        leaf = combine(leaf) if side == b"-" else combine(sibling, leaf) if side == b"L" else combine(leaf, sibling)
    return leaf


def siblings(path: bytes) -> list[bytes]:
    """The digests of a path, from the leaf's level upwards."""
    return [path[k + 1 : k + ENTRY] for k in range(0, len(path), ENTRY) if path[k : k + 1] != b"-"]


def leaf_digest(fields: list[Column]) -> Column:
    text = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]).cast("binary"), 256))


def tree_name(group: Column) -> Column:
    """A group's tree; names sort as the groups do, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows (tree, digest, and whatever stands between them in the order) with rank (from 0 in each tree) and n (the tree's rows).

    Rows are ordered by all columns of rows, in their order; those after digest take no part.
    """
    by = rows.columns[: rows.columns.index("digest") + 1]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    placed = materialise(placed, "placed").withColumns({"part": F.shiftright("at", 33), "place": F.col("at").bitwiseAND((1 << 33) - 1)}).drop("at")
    counts = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("m"), F.min("place").alias("first"))
    tree = Window.partitionBy("tree")
    earlier = F.sum("m").over(tree.orderBy("part")) - F.col("m")
    starts = counts.select(F.col("tree").alias("t"), F.col("part").alias("p"), (earlier - F.col("first")).alias("shift"), F.sum("m").over(tree).alias("n"))
    starts = small(materialise(starts, "starts"))
    found = placed.join(starts, (F.col("tree") == F.col("t")) & (F.col("part") == F.col("p")))
    return found.withColumn("rank", F.col("place") + F.col("shift")).drop("t", "p", "part", "place", "shift")


def levels_of(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return max(n - 1, 0).bit_length()


def _build_band(base: int):
    def build(group: pa.Table) -> pa.Table:
        """Nodes of one bucket, from those of level base (lo, n leaves in the tree, digest)."""
        group = group.sort_by("lo")
        tree, n = group.column("tree")[0].as_py(), group.column("n")[0].as_py()
        lo, digests = group.column("lo").to_pylist(), group.column("digest").to_pylist()
        out: list[tuple] = []
        first = lo[0] >> base
        top = min(levels_of(n), base + BAND)
        if base == 0 and top == 0:
            out.append((tree, 0, 0, 0, n, digests[0]))
        for level in range(base + 1, top + 1):
            digests = [combine(*digests[k : k + 2]) for k in range(0, len(digests), 2)]
            first >>= 1
            out += [(tree, level, (first + k) << level, min((first + k + 1) << level, n) - 1, n, d) for k, d in enumerate(digests)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _NODES, strict=True)], schema=_NODES)

    return build


def build(leaves: DataFrame) -> tuple[list[DataFrame], int]:
    """The nodes above leaves (tree, rank, n, digest), one table for each band from the lowest, and the levels of the highest tree.

    A tree of one leaf has that leaf as its node, on level 0.
    """
    depth = levels_of(leaves.agg(F.max("n")).first()[0] or 0)
    items = leaves.select("tree", F.col("rank").alias("lo"), "n", "digest")
    bands = []
    for base in range(0, max(depth, 1), BAND):
        bucket = F.shiftright("lo", base + BAND).alias("bucket")
        nodes = materialise(items.groupBy("tree", bucket).applyInArrow(_build_band(base), NODES), "nodes")
        bands.append(nodes)
        items = nodes.filter((F.col("level") == base + BAND) & (F.col("n") > F.lit(1 << (base + BAND)))).select("tree", "lo", "n", "digest")
    return bands, depth


def tops(bands: list[DataFrame]) -> DataFrame:
    """tree, digest: every tree's top node, the one that covers all its leaves."""
    found = [b.filter((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)) for b in bands]
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    # a chain of lone nodes doesn't occur: a tree ends at its first node that covers all leaves
    return every.select("tree", "digest")


def _paths(base: int, items: tuple[list, list, list], nodes: pa.Table) -> tuple[list[bytes], list]:
    """The path to the root of each node of level base (lo, hi, digest), and its tree's subroot, from the nodes above them.

    Per level, parents are found by containment of intervals, siblings as what a parent's interval has beyond the node's own.
    """
    level = np.array(nodes.column("level").to_pylist())
    rows = list(zip(*(nodes.column(c).to_pylist() for c in ("lo", "hi", "digest", "path", "subroot")), strict=True))
    by_level: dict[int, list] = {base: [(*r, None, None) for r in zip(*items, strict=True)]}
    for k, row in zip(level, rows, strict=True):
        if k > base:
            by_level.setdefault(int(k), []).append(row)
    for k in by_level:
        by_level[k].sort(key=lambda r: r[0])
    highest = max(by_level)
    crown = by_level[highest] if highest > base else rows
    path, subroot = [r[3] or b"" for r in crown], crown[0][4]
    for k in range(highest - 1, base - 1, -1):
        own, above = by_level[k], by_level[k + 1]
        lo, hi = np.array([r[0] for r in own]), np.array([r[1] for r in own])
        above_lo, above_hi = np.array([r[0] for r in above]), np.array([r[1] for r in above])
        parent = np.searchsorted(above_lo, lo, "right") - 1
        if (above_hi[parent] < hi).any():
            raise ValueError("a node is contained in no node of the next level")
        left = np.searchsorted(lo, above_lo[parent])  # the first child of the parent
        last = np.searchsorted(hi, above_hi[parent], "right") - 1
        entries = []
        for j in range(len(own)):
            a, b = left[j], last[j]
            entries.append(ALONE if a == b else b"R" + own[b][2] if a == j else b"L" + own[a][2])
        path = [e + path[p] for e, p in zip(entries, parent, strict=True)]
    return path, subroot


def _hand_down(base: int):
    def down(items: pa.Table, nodes: pa.Table) -> pa.Table:
        """Paths of the nodes of level base of one bucket."""
        items = items.sort_by("lo")
        own = tuple(items.column(c).to_pylist() for c in ("lo", "hi", "digest"))
        path, subroot = _paths(base, own, nodes)
        n = len(path)
        return pa.table({"tree": items.column("tree"), "level": pa.array([base] * n, pa.int32()), "lo": items.column("lo"), "path": pa.array(path, pa.binary()), "subroot": pa.array([subroot] * n, pa.binary())})

    return down


PATHS = "tree string, level int, lo long, path binary, subroot binary"


def paths_above(bands: list[DataFrame], crowns: DataFrame) -> list[DataFrame]:
    """Each band's nodes with the path and subroot of its top nodes. crowns (tree, path, subroot): what every tree's top node brings."""
    out: list[DataFrame] = []
    above = None
    brought = small(crowns.select(F.col("tree").alias("t"), F.col("path").alias("p"), F.col("subroot").alias("s")))
    is_top = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)
    for k in range(len(bands) - 1, -1, -1):
        base = k * BAND
        own = bands[k].join(brought, (F.col("tree") == F.col("t")) & is_top, "left")
        own = own.select("tree", "level", "lo", "hi", "n", "digest", F.col("p").alias("path"), F.col("s").alias("subroot"))
        if above is not None:
            handed = above.select(F.col("tree").alias("t"), F.col("level").alias("v"), F.col("lo").alias("o"), F.col("path").alias("p"), F.col("subroot").alias("s"))
            own = own.join(handed, (F.col("tree") == F.col("t")) & (F.col("level") == F.col("v")) & (F.col("lo") == F.col("o")), "left")
            own = own.select("tree", "level", "lo", "hi", "n", "digest", F.coalesce("p", "path").alias("path"), F.coalesce("s", "subroot").alias("subroot"))
        own = materialise(own, "pathed")
        out.insert(0, own)
        if k:
            below = bands[k - 1].filter((F.col("level") == base) & (F.col("n") > F.lit(1 << base))).withColumn("bucket", F.shiftright("lo", base + BAND))
            own = own.withColumn("bucket", F.shiftright("lo", base + BAND))
            above = materialise(below.groupBy("tree", "bucket").cogroup(own.groupBy("tree", "bucket")).applyInArrow(_hand_down(base), PATHS), "paths")
    return out


@dataclass
class Manifest:
    """leaves: tree, order columns, digest, further columns, rank, n; bands: the nodes of the groups' trees; root: None for an empty table."""

    leaves: DataFrame
    bands: list[DataFrame]
    subroots: DataFrame
    top_bands: list[DataFrame]
    root: bytes | None


def manifest(rows: DataFrame) -> Manifest:
    """The trees of rows (tree, columns that order a tree's leaves, digest, further columns)."""
    python_workers(rows.sparkSession)
    leaves = materialise(ranked(materialise(rows, "leaves")), "ranked")
    bands, _ = build(leaves)
    subroots = tops(bands).select(F.lit(TOP).alias("tree"), F.col("tree").alias("group"), "digest")
    subroots = materialise(ranked(subroots), "subroots")
    top_bands, _ = build(subroots)
    found = tops(top_bands).first()
    return Manifest(leaves, bands, subroots, top_bands, found and bytes(found["digest"]))


def proofs(m: Manifest, claimed: str = "claimed") -> DataFrame:
    """The leaves' columns but digest, rank and n, with leaf, subroot, proof_sha256 and folded_root (from `claimed`, a digest, where that isn't null).

    All digests are hexadecimal text.
    """
    spark = m.leaves.sparkSession
    crown = spark.createDataFrame([(TOP, b"", m.root)], "tree string, path binary, subroot binary")
    top = paths_above(m.top_bands, crown)[0]
    items = m.subroots.select("tree", F.col("group"), F.col("rank").alias("lo"), F.col("rank").alias("hi"), "digest")
    bucket = F.shiftright("lo", BAND).alias("bucket")

    def crowns(own: pa.Table, nodes: pa.Table) -> pa.Table:
        own = own.sort_by("lo")
        path, _ = _paths(0, tuple(own.column(c).to_pylist() for c in ("lo", "hi", "digest")), nodes)
        return pa.table({"tree": own.column("group"), "path": pa.array(path, pa.binary()), "subroot": own.column("digest")})

    brought = items.groupBy("tree", bucket).cogroup(top.groupBy("tree", bucket)).applyInArrow(crowns, "tree string, path binary, subroot binary")
    lowest = paths_above(m.bands, materialise(brought, "crowns"))[0]

    kept = [f for f in m.leaves.schema.fields if f.name not in ("tree", "digest", "rank", "n", claimed)]
    names = ["leaf", "subroot", "proof_sha256", "folded_root"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], *[f"{n} string" for n in names]])

    def prove(own: pa.Table, nodes: pa.Table) -> pa.Table:
        own = own.sort_by("rank")
        rank, digest = own.column("rank").to_pylist(), own.column("digest").to_pylist()
        path, subroot = _paths(0, (rank, rank, digest), nodes)
        said = own.column(claimed).to_pylist()
        columns = {f.name: own.column(f.name) for f in kept}
        columns["leaf"] = pa.array([d.hex() for d in digest], pa.string())
        columns["subroot"] = pa.array([subroot.hex()] * len(digest), pa.string())
        columns["proof_sha256"] = pa.array([combine(*siblings(p)).hex() for p in path], pa.string())
        columns["folded_root"] = pa.array([fold(d if c is None else c, p).hex() for d, c, p in zip(digest, said, path, strict=True)], pa.string())
        return pa.table(columns)

    leaf_bucket = F.shiftright("rank", BAND).alias("bucket")
    return m.leaves.groupBy("tree", leaf_bucket).cogroup(lowest.groupBy("tree", bucket)).applyInArrow(prove, schema)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    rows = docs.select(
        tree_name(F.col("lang")).alias("tree"),
        F.col("doc_id"),
        leaf_digest([F.col(f) for f in FIELDS]).alias("digest"),
        F.when(tampered, leaf_digest([more.get(f, F.col(f)) for f in FIELDS])).alias("claimed"),
    )
    m = manifest(rows)
    root = F.lit(m.root.hex() if m.root else None).cast("string")
    found = proofs(m).withColumn("root", root)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", F.col("folded_root").eqNullSafe(F.col("root")).alias("verified"))


_FIELD_SQL = "coalesce(cast(strlen(cast({0} AS VARCHAR)) AS VARCHAR) || ':' || cast({0} AS VARCHAR), '-')"
_LEAF_SQL = "sha256(" + " || ".join(_FIELD_SQL.format(f) for f in FIELDS) + ")"
_TAMPERED_SQL = "sha256(" + " || ".join(_FIELD_SQL.format("n_chars + 1" if f == "n_chars" else f) for f in FIELDS) + ")"
#: crc32 of the id's decimal text: every byte, then seven zeros, each folded in and shifted out.
_CRC32_SQL = """xor(list_reduce([4294967295] || flatten([[ascii(ch), 0, 0, 0, 0, 0, 0, 0] FOR ch IN string_split(cast(doc_id AS VARCHAR), '')]),
  lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END), 4294967295)"""

OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, {_LEAF_SQL} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND {_CRC32_SQL} % 7 = 0 THEN {_TAMPERED_SQL} ELSE {_LEAF_SQL} END AS claimed
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n FROM d
), nodes AS (
  SELECT lang, 0 AS level, rank AS i, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2, n
), subroots AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM nodes WHERE n = 1
), top AS (
  SELECT 0 AS level, rank AS i, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 2, n
), forest AS (
  SELECT coalesce('=' || lang, '-') AS tree, level, i, n, digest FROM nodes UNION ALL SELECT 'top', level, i, n, digest FROM top
), walk AS (
  SELECT rid, coalesce('=' || l.lang, '-') AS tree, 0 AS level, l.rank AS i, l.n, claimed AS digest, '' AS proof, s.rank AS above, s.n AS trees
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT rid, CASE WHEN w.n > 1 THEN w.tree ELSE 'top' END, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END,
         CASE WHEN w.n > 1 THEN w.i // 2 ELSE above END, CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE trees END,
         CASE WHEN w.n = 1 THEN w.digest WHEN f.digest IS NULL THEN sha256(w.digest) WHEN f.i < w.i THEN sha256(f.digest || w.digest) ELSE sha256(w.digest || f.digest) END,
         CASE WHEN w.n = 1 THEN proof ELSE proof || coalesce(f.digest, '') END, above, trees
  FROM walk w LEFT JOIN forest f ON f.tree = w.tree AND f.level = w.level AND f.i = xor(w.i, 1) AND w.n > 1
  WHERE w.n > 1 OR w.tree <> 'top'
), root AS (
  SELECT digest FROM top WHERE n = 1
)
SELECT l.doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, w.digest AS folded_root, w.digest = r.digest AS verified
FROM walk w JOIN leaves l USING (rid) JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, root r
WHERE w.tree = 'top' AND w.n = 1
"""
