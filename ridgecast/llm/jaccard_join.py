"""Exact Jaccard self-join of shingle sets in the metric space of Jaccard distance, down to connected components.

Distances between texts are almost all 1: unrelated texts are as far from each other as from any pivot, so Voronoi
regions around pivots drawn from all texts would replicate every document into every region. Exact bounds therefore
set aside first what cannot have a neighbour within the radius r = 1 - t:

1. Equal sets are one class; only classes go on.
2. Marks. Under any one order of all shingles two neighbours share one of their first n - ceil(t n) + 1 shingles, and k of their first
   n - ceil(t n) + k. A class's marks are so many first shingles that they make MARK_PERCENT of its n. The order is: shingles that a hash
   sample of ORDER_DOCS documents doesn't show often, by hash, then the frequent ones, rarest first. (The sample sets the order
   only; every order gives the same result.) A class has no neighbour unless k of its marks (for the least set that can be
   its neighbour) are shared with others; that is tested twice, first with a bitmap of the shared marks (of bounded size; what
   it lets pass wrongly the next test finds), then exactly, again and again while classes fall out. Of the a marks that a class
   shares it then keeps the a - k + 1 that the fewest classes share: by the same argument two neighbours still share one.

Then the metric join proper:

3. The classes that share a mark choose the most central of them as pivot (most of its marks shared); all marks with one pivot
   form that pivot's region, and a class that several pivots attract is replicated into each.
4. Regions too large for one task are joined in rounds. A round draws the regions anew from their open classes alone, by marks under
   the order of exact frequency among those. In each region that is still too large it draws PIVOTS central classes and measures every
   member's distance to them. A member within r of a pivot belongs to that pivot's Voronoi cell and is linked to it (pivots
   within r of each other make one cell), so pairs inside a cell need no comparison. By the triangle inequality a class within r of
   a cell's member is within 2 r of one of its pivots: the boundary classes in that window are replicated into the cell and compared
   with its members, in tasks of bounded size. What is in no cell is open and joins recursively in the next round.
5. Inside a region that fits a task pivots are drawn again and classes go to the nearest (Voronoi cells); a class x is replicated into
   pivot p's cell too when d(x, p) <= d(x, nearest) + 2 r, which by the triangle inequality keeps every pair within r together.
   Classes within r of a pivot are linked to it directly and to each other through it; a pair is compared only if at
   least one of them isn't, and only if their distances to the pivot differ by at most r. Cells are cut again until
   small or until cutting doesn't help.

A family of near copies around one text so costs its members once or twice, however large it is. If a round puts less than a tenth of
the open classes into cells, the classes left in large regions are compared in pairs of blocks: exact, but quadratic in a region
whose members are alike without being near. The same holds for a cell with very many members and very many boundary classes.

Tasks return spanning links as stars, never pairs, so the output is linear in the classes. Shingles are 64-bit hashes, classes
128-bit hashes of their sorted shingles. The number of a document's links is no result: pairs inside a cell are never compared.

Defined cases: null and empty texts have no shingles and stay alone; texts of fewer words than a shingle have one shingle; repeated
rows are in one class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, materialise, python_workers, small
from .components import components, heavy_keys, spread_join

WORDS = 3
PERCENT = 90
#: A region of more classes or shingles than this is cut before it goes to a task.
LEAF_CLASSES = 2048
LEAF_SHINGLES = 2_000_000
#: Cells of at most this many classes are compared directly.
CELL = 48
#: Documents (about) whose shingles order the marks, how many of them make a shingle frequent, and the most frequent shingles kept.
ORDER_DOCS = 8_000
ORDER_COUNT = 3
ORDER_SHINGLES = 500_000
#: Marks as a percentage of a set (more where the radius alone asks for more).
MARK_PERCENT = 30
#: Bits of the bitmap of shared marks: for each of them, and at most (32 MB).
BITS_PER_MARK, MOST_BITS = 16, 1 << 28
#: How often the exact test of marks is repeated at most.
MARK_ROUNDS = 4
PIVOTS = 8

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C + np.uint64(salt * int(_B) & 0xFFFFFFFFFFFFFFFF)
    return (x ^ (x >> np.uint64(27))) * _A


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    flat = split.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names))
    w = hashes[flat.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)
    ends = split.offsets.to_numpy() - split.offsets[0].as_py()
    run = w.copy()
    for k in range(1, words):
        run[:-k] = _mix(run[:-k] * _A + w[k:], k) if len(w) > k else run[:-k]
    out = []
    empty = xxhash.xxh3_64_intdigest("")
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b - a == 1 and w[a] == empty:
            out.append(np.zeros(0, np.uint64))
        else:
            whole = np.array([b - a], np.uint64)
            for x in w[a:b]:
                whole = _mix(whole * _A + x, 99)
            out.append(whole[: b - a])
    return out


def marks_shared(n: int, percent: int = PERCENT) -> int:
    """How many marks two neighbours of at least n shingles share."""
    return max(1, (MARK_PERCENT - (100 - percent)) * n // 100)


def marks_needed(n: int, percent: int = PERCENT) -> int:
    """How many marks of a set of n any neighbour shares, whatever its size."""
    return marks_shared(-(percent * -n // 100), percent)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many marks a set of n has."""
    return min(n, n + percent * -n // 100 + marks_shared(n, percent)) if n else 0


def prefix_marks(sets: list[np.ndarray], frequent: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> list[np.ndarray]:
    """The first shingles of each set (sorted hashes); frequent: (sorted frequent shingles, their ranks from the rarest)."""
    known, ranks = frequent
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
    often = known[at] == flat if len(known) else np.zeros(len(flat), bool)
    out, a = [], 0
    for s in sets:
        b = a + len(s)
        wanted, mine = prefix_length(len(s), percent), often[a:b]
        first = s[~mine][:wanted]
        if len(first) < wanted:
            last = s[mine][np.argsort(ranks[at[a:b][mine]], kind="stable")]
            first = np.concatenate([first, last[: wanted - len(first)]])
        out.append(first)
        a = b
    return out


def frequent_shingles(docs: DataFrame, words: int, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, ranks) of the shingles that at least ORDER_COUNT of about ORDER_DOCS sampled documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(sets) if sets else np.zeros(0, np.uint64)).view(np.int64))], names=["s"])

    rate = min(1.0, (size or ORDER_DOCS) / max(1, docs.count()))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("order")), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))).select("text")
    each = sample.mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= ORDER_COUNT)
    found = each.orderBy(F.desc("df"), "s").limit(ORDER_SHINGLES).select("s").toArrow()  # bounded by ORDER_SHINGLES
    shingles = found["s"].to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], (len(shingles) - 1 - order).astype(np.int64)


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    raw = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
    both = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _profiles(words: int, percent: int, frequent):
    """doc_id, text -> doc_id, n_shingles, k1, k2, need, marks; a set that the task has seen brings no marks again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sets = shingle_sets(batch.column("text"), words)
            k1, k2 = _keys(sets)
            fresh = []
            for s, k in zip(sets, k1.tolist(), strict=True):
                fresh.append(s if len(s) and k not in seen else s[:0])
                seen.add(k)
            marks = prefix_marks(fresh, frequent.value, percent)
            offsets = np.concatenate([[0], np.cumsum([len(m) for m in marks])]).astype(np.int32)
            values = np.concatenate(marks).view(np.int64) if marks else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            need = pa.array([marks_needed(len(s), percent) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2), need, lists], names=["doc_id", "n_shingles", "k1", "k2", "need", "marks"])

    return run


def _sets(words: int):
    """doc_id, text -> doc_id, k1, k2, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"), words)
            k1, k2 = _keys(sets)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(k1), pa.array(k2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "k1", "k2", "shingles"])

    return run


class _Region:
    """Shingle sets of one region with local codes, so that a distance is a table look-up for each shingle."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.size = np.array([len(s) for s in sets], np.int64)
        _, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.flag = np.zeros(int(self.codes.max()) + 1, np.int32)
        self.parent = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []

    def shared(self, one: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the intersections and unions of one set with others."""
        mine = self.codes[self.start[one] : self.start[one + 1]]
        self.flag[mine] = 1
        lengths = self.size[others]
        at = np.repeat(self.start[others] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        both = np.add.reduceat(self.flag[self.codes[at]], np.concatenate([[0], np.cumsum(lengths)[:-1]])) if len(others) else np.zeros(0, np.int64)
        self.flag[mine] = 0
        return both.astype(np.int64), self.size[one] + lengths - both

    def near(self, one: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which others are within the radius of one, and their distances; those are linked."""
        both, union = self.shared(one, others)
        close = 100 * both >= self.percent * union
        for k in others[close]:
            self.link(one, int(k))
        return close, 1 - both / union

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))

    def root(self, a: int) -> int:
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def join(self, members: np.ndarray, left: np.ndarray | None = None) -> None:
        """Link all pairs within the radius (with left: pairs of a left with a right member only)."""
        stack = [members]
        slack = 2 * (1 - self.percent / 100) + 1e-9
        while stack:
            cell = stack.pop()
            if len(cell) < 2 or (left is not None and (left[cell].all() or not left[cell].any())):
                continue
            if len(cell) <= CELL:
                self._direct(cell, left)
                continue
            pivots = cell[:: max(1, len(cell) // PIVOTS)][:PIVOTS]
            rest = np.setdiff1d(cell, pivots, assume_unique=True)
            found = [self.near(int(p), cell) for p in pivots]
            distance = np.stack([d for _, d in found])[:, np.searchsorted(cell, rest)]
            close = np.stack([c for c, _ in found])[:, np.searchsorted(cell, rest)]
            nearest = distance.min(0)
            cells = [rest[row <= nearest + slack] for row in distance]
            # A cell whose members are all within the radius of its pivot is linked already.
            open_ = [c for c, ball in zip(cells, (close[k, row <= nearest + slack] for k, row in enumerate(distance)), strict=True) if len(c) > 1 and not ball.all()]
            if sum(map(len, open_)) <= 2 * len(cell) and max(map(len, open_), default=0) <= 0.7 * len(cell):
                stack += open_
            elif open_:
                self._windows(rest, distance, close, left)

    def _direct(self, cell: np.ndarray, left: np.ndarray | None) -> None:
        for k, one in enumerate(cell[:-1]):
            others = cell[k + 1 :]
            others = others[np.minimum(self.size[others], self.size[one]) * 100 >= self.percent * np.maximum(self.size[others], self.size[one])]
            if left is not None:
                others = others[left[others] != left[one]]
            if len(others):
                self.near(int(one), others)

    def _windows(self, rest: np.ndarray, distance: np.ndarray, close: np.ndarray, left: np.ndarray | None) -> None:
        """Compare what the pivots cannot tell apart: pairs whose distances to every pivot differ by the radius at most."""
        radius = 1 - self.percent / 100 + 1e-9
        for k, one in enumerate(rest[:-1]):
            later = np.arange(k + 1, len(rest))
            later = later[(np.abs(distance[:, later] - distance[:, [k]]) <= radius).all(0) & ~(close[:, later] & close[:, [k]]).any(0)]
            others = rest[later]
            others = others[np.minimum(self.size[others], self.size[one]) * 100 >= self.percent * np.maximum(self.size[others], self.size[one])]
            if left is not None:
                others = others[left[others] != left[one]]
            if len(others):
                self.near(int(one), others)


def _region_of(table: pa.Table, percent: int) -> tuple[np.ndarray, _Region]:
    ids = table.column("cid").to_numpy()
    lists = table.column("shingles").combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return ids, _Region([values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], percent)


def _leaf(percent: int):
    """One region's classes (cid, shingles, side) -> spanning links (a, b), each set's to its root. Where sides differ only pairs across count."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cid")
        ids, region = _region_of(table, percent)
        side = table.column("side").to_numpy()
        region.join(np.arange(len(ids)), side == 0 if (side != side[0]).any() else None)
        roots = np.array([region.root(k) for k in range(len(ids))])
        away = np.flatnonzero(roots != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[roots[away]], pa.int64()), "b": pa.array(ids[away], pa.int64())})

    return run


MEASURED = "region long, cid long, n long, home long, near array<long>, beside array<long>"


def _measure(percent: int):
    """One block of a region (region, cid, shingles, pivot: its rank among the pivots or null) with all of the region's pivots -> MEASURED.

    home: the cell, named by its first pivot, or null; near: the pivots within r; beside: the cells to whose members the class
    may be near though it isn't in them (each pair of cells meets in the first of the two).
    """
    radius = 1 - percent / 100

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pivot", "ascending"), ("cid", "ascending")])
        ids, region = _region_of(table, percent)
        rank = table.column("pivot").to_numpy(zero_copy_only=False)
        k = int(np.isfinite(rank.astype(float)).sum())
        everyone = np.arange(len(ids))
        close, distance = np.zeros((k, len(ids)), bool), np.ones((k, len(ids)))
        for p in range(k):
            both, union = region.shared(p, everyone)
            close[p], distance[p] = 100 * both >= percent * union, 1 - both / union
        cell = np.arange(k)
        for p in range(k):  # pivots within r of each other, step by step
            for q in np.flatnonzero(close[p, :k]):
                low, high = sorted((cell[p], cell[q]))
                cell[cell == high] = low
        member = np.flatnonzero(table.column("block_row").to_numpy(zero_copy_only=False))
        home, near, beside = [], [], []
        for x in member:
            own = np.flatnonzero(close[:, x])
            cells = set(cell[own].tolist())
            mine = min(cells) if cells else k
            home.append(int(ids[mine]) if cells else None)
            near.append(ids[own].tolist())
            window = set(cell[distance[:, x] <= 2 * radius + 1e-9].tolist()) - cells
            beside.append([int(ids[c]) for c in sorted(window) if c < mine])
        regions = table.column("region").to_numpy()[member]
        return pa.table([pa.array(regions, pa.int64()), pa.array(ids[member], pa.int64()), pa.array(region.size[member], pa.int64()), pa.array(home, pa.int64()), pa.array(near, pa.list_(pa.int64())), pa.array(beside, pa.list_(pa.int64()))], names=["region", "cid", "n", "home", "near", "beside"])

    return run


def _prefix(sets: DataFrame, percent: int) -> DataFrame:
    """s, cid, own: the shared ones among each class's rarest shingles, and the share of its shingles that nobody has."""
    each = sets.select("cid", F.explode("shingles").alias("s"))
    common = each.groupBy("s").agg(F.count(F.lit(1)).cast("int").alias("df")).filter("df > 1").withColumnRenamed("s", "s2")
    known = each.join(common, F.col("s") == F.col("s2")).groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("known"))
    known = known.join(sets.select(F.col("cid").alias("c2"), "n"), F.col("cid") == F.col("c2"))
    length = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    own = F.col("n") - F.size("known")
    return known.filter(own < length).select("cid", (own / F.col("n")).alias("own"), F.explode(F.slice("known", F.lit(1), (length - own).cast("int"))).alias("k")).select(F.col("k.s").alias("s"), "cid", "own")


def _regions(prefix: DataFrame) -> DataFrame:
    """region, cid, own: the classes of every pivot's region, the pivot among them."""
    groups = prefix.groupBy("s").agg(F.min_by("cid", F.struct("own", "cid")).alias("region"), F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("s").alias("s2"), "region")
    return prefix.join(groups, F.col("s") == F.col("s2")).groupBy("region", "cid").agg(F.min("own").alias("own"))


def _by_size(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (region, cid, own) of the regions that fit one task, and of the others with n and the region's number of blocks."""
    sized = members.join(small(sets.select(F.col("cid").alias("c3"), "n")), F.col("cid") == F.col("c3")).drop("c3")
    sizes = sized.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("volume"))
    large = sizes.filter((F.col("m") > LEAF_CLASSES) | (F.col("volume") > LEAF_SHINGLES))
    blocks = F.ceil(2 * F.greatest(F.col("m") / F.lit(LEAF_CLASSES), F.col("volume") / F.lit(LEAF_SHINGLES))).cast("int")
    large = small(materialise(large.select(F.col("region").alias("r2"), blocks.alias("blocks")), "large"))
    return members.join(large, F.col("region") == F.col("r2"), "left_anti"), sized.join(large, F.col("region") == F.col("r2")).drop("r2")


def _tasks(members: DataFrame, name: str) -> DataFrame:
    return members.select(F.concat_ws("/", F.lit(name), "region").alias("region"), F.lit(0).alias("side"), "cid")


def _block(blocks) -> Column:
    return F.pmod(F.xxhash64("cid"), blocks).cast("int")


def _measured(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """MEASURED for members (region, cid, own, n, blocks) of large regions: distances to PIVOTS central classes of the region."""
    few = large.groupBy("region", "blocks", _block(F.least(F.col("blocks") * PIVOTS, F.lit(1024))).alias("part")).agg(F.min(F.struct("own", F.xxhash64("cid"), "cid")).alias("best"))
    pivots = few.groupBy("region", "blocks").agg(F.slice(F.array_sort(F.collect_list("best")), 1, PIVOTS).alias("best"))  # one of each part
    pivots = pivots.select("region", "blocks", F.posexplode("best").alias("pivot", "b")).select("region", "blocks", "pivot", F.col("b.cid").alias("cid"))
    pivots = materialise(pivots, "pivots")
    copies = pivots.select("region", "cid", "pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    chosen = small(pivots.select(F.col("region").alias("r4"), F.col("cid").alias("c4"), F.lit(True).alias("is_pivot")))
    rows = large.join(chosen, (F.col("region") == F.col("r4")) & (F.col("cid") == F.col("c4")), "left").select("region", "cid", _block(F.col("blocks")).alias("block"), F.coalesce("is_pivot", F.lit(False)).alias("is_pivot"))
    # A pivot is in every block, and a row of its own block only once.
    others = rows.filter("not is_pivot").select("region", "cid", F.lit(None).cast("int").alias("pivot"), "block", F.lit(True).alias("block_row"))
    home = rows.filter("is_pivot").select(F.col("region").alias("r5"), F.col("cid").alias("c5"), F.col("block").alias("b5"))
    copies = copies.join(small(materialise(home, "homes")), (F.col("region") == F.col("r5")) & (F.col("cid") == F.col("c5"))).select("region", "cid", "pivot", "block", (F.col("block") == F.col("b5")).alias("block_row"))
    wanted = materialise(others.unionByName(copies), "blocks")
    shipped = sets.select(F.col("cid").alias("c6"), "shingles").join(small(wanted), F.col("cid") == F.col("c6")).drop("c6")
    return materialise(shipped.groupBy("region", "block").applyInArrow(_measure(percent), MEASURED), "measured")


def _cells(measured: DataFrame, name: str) -> DataFrame:
    """Tasks (region, side, cid) that compare every cell's members with its boundary classes, in blocks that fit a task."""
    rows = measured.filter("home is not null").select("region", F.col("home").alias("cell"), F.lit(0).alias("side"), "cid", "n")
    rows = rows.union(measured.select("region", F.explode("beside").alias("cell"), F.lit(1).alias("side"), "cid", "n"))
    part = lambda s: F.greatest(F.lit(1), F.ceil(2 * F.greatest(F.count_if(F.col("side") == s) / F.lit(LEAF_CLASSES), F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)) / F.lit(LEAF_SHINGLES)))).cast("int").alias(f"parts{s}")
    sizes = rows.groupBy("region", "cell").agg(F.bool_or(F.col("side") == 0).alias("has"), F.bool_or(F.col("side") == 1).alias("open"), part(0), part(1)).filter("has and open")
    sizes = small(materialise(sizes.select(F.col("region").alias("r7"), F.col("cell").alias("p7"), "parts0", "parts1"), "cells"))
    rows = rows.join(sizes, (F.col("region") == F.col("r7")) & (F.col("cell") == F.col("p7")))
    mine, theirs = F.when(F.col("side") == 0, F.col("parts0")).otherwise(F.col("parts1")), F.when(F.col("side") == 0, F.col("parts1")).otherwise(F.col("parts0"))
    rows = rows.select("region", "cell", "side", "cid", _block(mine).alias("x"), F.explode(F.sequence(F.lit(0), theirs - 1)).alias("y"))
    at = lambda s: F.when(F.col("side") == s, F.col("x")).otherwise(F.col("y"))
    return rows.select(F.concat_ws("/", F.lit(name), "region", "cell", at(0), at(1)).alias("region"), "side", "cid")


def _block_pairs(large: DataFrame, name: str) -> DataFrame:
    """Tasks for all pairs of blocks of the members (region, cid, blocks) of large regions."""
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.greatest(k, F.col("block")).alias("y"))))
    rows = large.withColumn("block", _block(F.col("blocks"))).select("region", "cid", "block", pairs.alias("pair"))
    return rows.select(F.concat_ws("/", F.lit(name), "region", "pair.x", "pair.y").alias("region"), F.when(F.col("pair.x") == F.col("block"), 0).otherwise(1).alias("side"), "cid")


def links_of(sets: DataFrame, shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Spanning links (a, b) of the classes in sets (cid, n, shingles) that share marks (s, cid); both are tables on disk."""
    share = shared.groupBy("cid").agg(F.count(F.lit(1)).alias("k")).join(small(sets.select("cid", "n")), "cid")
    central = shared.join(small(materialise(share.select("cid", (-F.col("k") / F.col("n")).alias("own")), "central")), "cid")
    fit, large = _by_size(materialise(_regions(central), "regions"), sets)
    tasks, direct, round_ = _tasks(fit, "mark"), None, 0
    large = materialise(large, "open")
    while not large.isEmpty():
        round_ += 1
        hard = materialise(sets.join(small(materialise(large.select("cid").distinct(), "hard")), "cid", "left_semi"), "hard-sets")
        fit, large = _by_size(materialise(_regions(_prefix(hard, percent)), "regions"), hard)
        tasks = tasks.union(_tasks(fit, f"prefix{round_}"))
        large = materialise(large, "large")
        before = large.count()
        if not before:
            break
        measured = _measured(large, hard, percent)
        links = measured.select(F.explode("near").alias("a"), F.col("cid").alias("b")).filter("a <> b")
        direct = links if direct is None else direct.union(links)
        tasks = tasks.union(_cells(measured, f"cell{round_}"))
        left = measured.filter("home is null").select(F.col("region").alias("r8"), F.col("cid").alias("c8"))
        members = materialise(large.join(left, (F.col("region") == F.col("r8")) & (F.col("cid") == F.col("c8")), "left_semi").select("region", "cid", "own"), "members")
        after = members.count()
        fit, large = _by_size(members, hard)
        tasks = tasks.union(_tasks(fit, f"rest{round_}"))
        large = materialise(large, "open")
        if 10 * (before - after) < before:
            tasks, large = tasks.union(_block_pairs(large, f"pair{round_}")), large.limit(0)
    tasks = materialise(tasks, "tasks")
    shipped = sets.select(F.col("cid").alias("c9"), "shingles").join(small(tasks), F.col("cid") == F.col("c9")).drop("c9")
    links = shipped.groupBy("region").applyInArrow(_leaf(percent), "a long, b long")
    return links if direct is None else links.union(direct)


def _bit_of(marks: np.ndarray, bits: int) -> np.ndarray:
    return (marks.view(np.uint64) * _A) >> np.uint64(64 - bits)


def _bitmap(shared: DataFrame) -> tuple[int, np.ndarray]:
    """(log2 of its bits, bitmap) of a table of marks (m2): at least BITS_PER_MARK bits each up to MOST_BITS in all."""
    bits = min(MOST_BITS, max(1 << 10, BITS_PER_MARK * shared.count())).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bit_of(batch.column("m2").to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["i", "w"])

    words = shared.mapInArrow(run, "i long, w long").groupBy("i").agg(F.bit_or("w").alias("w")).toArrow()  # bounded by MOST_BITS
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["i"].to_numpy()] = words["w"].to_numpy().view(np.uint64)
    return bits, out


def _survivors(shared):
    """k1, need, marks -> the same with the marks that the bitmap knows, for sets that have enough of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, bitmap = shared.value
        for batch in batches:
            lists = batch.column("marks")
            offsets, marks = lists.offsets.to_numpy(), lists.values.to_numpy()
            at = _bit_of(marks, bits)
            known = (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            sums = np.concatenate([[0], np.cumsum(known)])
            enough = (sums[offsets[1:]] - sums[offsets[:-1]] >= batch.column("need").to_numpy()) & (np.diff(offsets) > 0)
            chosen = [marks[a:b][known[a:b]] for a, b, ok in zip(offsets[:-1], offsets[1:], enough, strict=True) if ok]
            ends = np.concatenate([[0], np.cumsum([len(m) for m in chosen])]).astype(np.int32)
            kept = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(chosen) if chosen else marks[:0]))
            keep = pa.array(enough)
            yield pa.RecordBatch.from_arrays([batch.column("k1").filter(keep), batch.column("need").filter(keep), kept], names=["k1", "need", "marks"])

    return run


def _shared(postings: DataFrame) -> DataFrame:
    """The marks (m2) of more than one class."""
    return postings.groupBy("mark").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).filter("lo <> hi").select(F.col("mark").alias("m2"))


def open_marks(profiles: DataFrame) -> DataFrame:
    """k1, mark of the classes that share enough marks with others, and of the a marks that they share the a - needed + 1 rarest."""
    shared = materialise(_shared(profiles.select("k1", F.explode("marks").alias("mark"))), "shared-marks")
    bitmap = profiles.sparkSession.sparkContext.broadcast(_bitmap(shared))
    discard(shared)
    rows = profiles.filter(F.size("marks") > 0).select("k1", "need", "marks").mapInArrow(_survivors(bitmap), "k1 long, need long, marks array<long>")
    now = materialise(rows, "survivors")
    now = materialise(now.select("k1", "need", F.explode("marks").alias("mark")).distinct(), "open-marks")
    before = now.count()
    for _ in range(MARK_ROUNDS):
        shared = small(materialise(_shared(now), "shared-marks"))
        held = now.join(shared, F.col("mark") == F.col("m2"), "left_semi")
        enough = held.groupBy("k1").agg(F.count(F.lit(1)).alias("m"), F.max("need").alias("need")).filter("m >= need").select(F.col("k1").alias("o1"))
        after = materialise(held.join(small(materialise(enough, "enough")), F.col("k1") == F.col("o1"), "left_semi"), "open-marks")
        discard(now)
        now, n = after, after.count()
        if 10 * (before - n) < before:
            break
        before = n
    sizes = now.groupBy("mark").agg(F.count(F.lit(1)).cast("int").alias("df")).filter("df > 1").withColumnRenamed("mark", "m2")
    each = now.join(small(materialise(sizes, "mark-sizes")), F.col("mark") == F.col("m2")).groupBy("k1").agg(F.sort_array(F.collect_list(F.struct("df", "mark"))).alias("a"), F.max("need").alias("need"))
    rarest = F.slice("a", F.lit(1), (F.size("a") - F.col("need") + 1).cast("int"))
    kept = materialise(each.filter(F.size("a") >= F.col("need")).select("k1", F.explode(rarest).alias("r")).select("k1", F.col("r.mark").alias("mark")), "open-marks")
    discard(now)
    return kept


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = df.sparkSession
    python_workers(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, words))
    profiles = materialise(docs.mapInArrow(_profiles(words, percent, frequent), "doc_id long, n_shingles long, k1 long, k2 long, need long, marks array<long>"), "profiles")
    open_ = open_marks(profiles)
    classes = profiles.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.max("n_shingles").alias("n"))
    openk = open_.select(F.col("k1").alias("o1")).distinct()
    reps = materialise(classes.join(openk, F.col("k1") == F.col("o1"), "left_semi").withColumn("cid", F.monotonically_increasing_id()), "classes")
    wanted = small(reps.select(F.col("low").alias("l0")).distinct())
    sets = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("l0")), "left_semi").mapInArrow(_sets(words), "doc_id long, k1 long, k2 long, shingles array<long>")
    own = small(reps.select("cid", "n", F.col("low").alias("l2"), F.col("k1").alias("c1"), F.col("k2").alias("c2")))
    sets = sets.join(own, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & F.col("doc_id").eqNullSafe(F.col("l2"))).select("cid", "n", "shingles")
    sets = materialise(sets, "sets")
    marks = open_.join(small(reps.select("cid", F.col("k1").alias("c1"))), F.col("k1") == F.col("c1")).select(F.col("mark").alias("s"), "cid")
    marks = materialise(marks, "marks")
    discard(open_)
    found = components(links_of(sets, marks, percent))
    discard(sets, marks)
    named = materialise(reps.join(found, F.col("cid") == F.col("node")).select("k1", "k2", "low", "label"), "named")
    lows = named.groupBy("label").agg(F.min("low").alias("lowest")).withColumnRenamed("label", "l2")
    named = spread_join(named, lows, {"label": "l2"}, heavy_keys(named, "label")).select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "lowest")
    whole = classes.join(named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left").select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), F.coalesce("lowest", "low").alias("least"))
    rows = profiles.select("doc_id", "n_shingles", "k1", "k2")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = rows.filter("n_shingles > 0")
    rest = spread_join(full, whole, {"k1": "w1", "k2": "w2"}, heavy_keys(full, "k1")).select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return alone.union(rest)


def op8(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
