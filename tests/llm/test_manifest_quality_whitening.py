"""Quality discriminant, Merkle manifest and whitening against brute force, on small tables with every awkward case."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgecast.llm import merkle_manifest, quality_qda, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, path, rows, schema, **extra):
    spark.createDataFrame(rows, schema).repartition(3).withColumns({k: F.lit(v) for k, v in extra.items()}).write.parquet(path)


# 11: quality discriminant


def prose(rng, n):
    words = [f"{a}{b}" for a in ("tha", "onre", "sten", "ibla") for b in ("n", "rds", "ty", "le", "mo", "kes")]
    text = " ".join(words[i] for i in rng.integers(0, len(words), n))
    return text[:1].upper() + text[1:] + "."


@pytest.fixture(scope="module")
def judged():
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = prose(rng, int(rng.integers(15, 200)))
        if bad:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", " | "), " ".join([text.split(" ")[0]] * 60), text.replace(" ", "$$ ")][i // 4 % 4]
        docs.append((i, text, "en", "s", 1))
        if i % 3:
            labels.append((i, int(not bad)))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, prose(rng, 30), "en", "s", 1), (5, docs[5][1], "en", "s", 1), (902, prose(rng, 40_000), "en", "s", 1)]
    labels += [(None, 1), (1, None), (77777, 0), (2, 5)]
    return docs, labels


def test_discriminant_scores(spark, judged, tmp_path):
    docs, labels = judged
    table(spark, f"{tmp_path}/documents.parquet", docs, DOCS, score="clash", stats="clash", label="clash", fold="clash")
    table(spark, f"{tmp_path}/labels.parquet", labels, "doc_id long, quality int", toxic=0)
    got = quality_qda.op11(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    known = {i: q for i, q in labels if i is not None and q in (0, 1)}
    held = [(r.predicted, known[r.doc_id]) for r in got if r.held_out and r.doc_id in known]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.95

    stats = {r.doc_id: np.array(r.stats) for r in quality_qda.statistics(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    learned = [(stats[i], q) for i, q in known.items() if i in stats and zlib.crc32(str(i).encode()) % 5]
    learned += [(stats[5], known[5])]  # a repeated row counts twice
    means, covs, logs = {}, {}, {}
    for k in (0, 1):
        z = np.rint(np.array([s for s, q in learned if q == k]) * 1024) / 1024
        means[k], covs[k], logs[k] = z.mean(axis=0), np.cov(z.T, bias=True), np.log(len(z) / len(learned))
    share = np.exp(logs[1])
    pooled = share * covs[1] + (1 - share) * covs[0]

    def close(lam, gamma):
        def density(k, x):
            cov = (1 - gamma) * ((1 - lam) * covs[k] + lam * pooled) + gamma * np.diag(np.diag(pooled)) + 1e-4 * np.eye(len(pooled))
            diff = x - means[k]
            return logs[k] - 0.5 * (diff @ np.linalg.solve(cov, diff) + np.linalg.slogdet(cov)[1])

        every = [density(1, x) - density(0, x) for x in stats.values()]
        return np.allclose(model.log_odds(np.array(list(stats.values()))), every, rtol=1e-5, atol=1e-4)

    every = quality_qda.statistics(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    model = quality_qda.train(quality_qda.training_rows(every, spark.read.parquet(f"{tmp_path}/labels.parquet"), use=~quality_qda.held_out(F.col("doc_id"))))
    assert sum(close(lam, gamma) for lam in quality_qda.LAMBDAS for gamma in quality_qda.GAMMAS) == 1
    odds = dict(zip(stats, model.log_odds(np.array(list(stats.values())))))
    assert all(r.score == pytest.approx(1 / (1 + np.exp(-np.clip(odds[r.doc_id], -700, 700))), rel=1e-6) for r in got)


def test_statistics_of_odd_texts(spark):
    texts = [None, "", " \n\t", "a a a b", "x|y!\nx|y!\n", "ÀÉ 12."]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: dict(zip(quality_qda.STATISTICS, r.stats)) for r in quality_qda.statistics(got).collect()}
    assert got[0] == got[1] == got[2] and got[0]["log_words"] == 0 and not any(np.isnan(list(s.values())).any() for s in got.values())
    assert got[3]["log_words"] == pytest.approx(np.log(5)) and got[3]["adjacent_repeats"] == pytest.approx(np.sqrt(2 / 24))
    assert got[3]["distinct_words"] == pytest.approx(np.log(22) / np.log(24)) and got[3]["distinct_pairs"] == pytest.approx(np.log(22) / np.log(24))
    assert got[4]["repeated_lines"] == pytest.approx(np.sqrt(1 / 6)) and got[4]["symbols"] == pytest.approx(np.sqrt(2 / 108)) and got[4]["shouts"] == pytest.approx(np.sqrt(2 / 108))
    assert got[5]["capitals"] == got[5]["digits"] == pytest.approx(np.sqrt(2 / 105)) and got[5]["stops"] == pytest.approx(np.sqrt(1 / 105))


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(1, 1), (2, 1)], 0.75), ([(1, 0)], 1 / 3)])
def test_discriminant_with_one_kind_of_label(spark, tmp_path, labels, want):
    table(spark, f"{tmp_path}/documents.parquet", [(i, f"some words of text {i}", "en", "s", 1) for i in range(1, 4)], DOCS)
    table(spark, f"{tmp_path}/labels.parquet", labels, "doc_id long, quality int")
    assert [r.score for r in quality_qda.op11(spark, str(tmp_path)).collect()] == pytest.approx([want] * 3)


def test_smallest_label_counts_and_empty_documents(spark, tmp_path):
    stats = spark.createDataFrame([(1, [0.0] * 14), (2, [1.0] * 14)], "doc_id long, stats array<double>")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    assert sorted(r.label for r in quality_qda.training_rows(stats, labels).collect()) == [0, 1]
    table(spark, f"{tmp_path}/documents.parquet", [], DOCS)
    table(spark, f"{tmp_path}/labels.parquet", [(1, 0), (2, 1)], "doc_id long, quality int")
    assert quality_qda.op11(spark, str(tmp_path)).count() == 0


# 12: Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    fields = [doc_id, source, lang, n_chars if n_chars is None else n_chars + more, text]
    return H(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def climb(digests):
    """The root, and for each leaf its path as (siblings before, siblings after) of every level."""
    groups, paths, level = [[k] for k in range(len(digests))], [[] for _ in digests], list(digests)
    while len(level) > 1:
        for a in range(0, len(level), 2):
            run = range(a, min(a + 2, len(level)))
            for k in run:
                for member in groups[k]:
                    paths[member].append(([level[j] for j in run if j < k], [level[j] for j in run if j > k]))
        groups = [sum(groups[a : a + 2], []) for a in range(0, len(level), 2)]
        level = [H(*level[a : a + 2]) for a in range(0, len(level), 2)]
    return level[0], paths


def brute_manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for t in order:
        trees[t].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    made = {t: climb([leaf(r) for r in trees[t]]) for t in order}
    root, upper = climb([made[t][0] for t in order])
    out = []
    for t, up in zip(order, upper):
        for row, path in zip(trees[t], made[t][1]):
            whole = path + up
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None
            digest = leaf(row, int(tampered))
            for before, after in whole:
                digest = H(*before, digest, *after)
            proof = H(*[s for before, after in whole for s in before + after])
            out.append((row[0], leaf(row), made[t][0], root, proof, digest, digest == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def leaves(n, langs):
    rng = np.random.default_rng(n)
    rows = [(int(i), f"text {i} é😀", langs[int(rng.integers(0, len(langs)))], f"s{i % 3}", int(i) % 11) for i in rng.permutation(n)]
    return rows + [(3, None, None, None, None), (3, None, None, None, None), (None, "x", "lone", "s", 9), (3, "other", None, "s", 1), (7_000_000, "", "é", "", 0), (-5, "y" * 50_000, "z", "s", None)]


@pytest.mark.parametrize("n, langs", [(0, ["en"]), (9, ["en", None]), (90, ["en", "de", None, "fr"]), (60, [f"l{k}" for k in range(25)])])
@pytest.mark.parametrize("band", [2, 10])
def test_manifest_equals_brute_force(spark, tmp_path, monkeypatch, n, langs, band):
    monkeypatch.setattr(merkle_manifest, "BAND", band)
    rows = leaves(n, langs)
    table(spark, f"{tmp_path}/documents.parquet", rows, DOCS, tree="clash", digest="clash", leaf="clash", rank="clash")
    got = sorted((tuple(r) for r in merkle_manifest.op12(spark, str(tmp_path)).select(COLUMNS).collect()), key=str)
    want = brute_manifest(rows)
    assert got == want and any(not r[-1] for r in want) == any(not r[-1] for r in got)
    if band == 10:
        connection = duckdb.connect()
        connection.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert sorted(connection.sql(f"select {', '.join(COLUMNS)} from ({merkle_manifest.OP12_SQL})").fetchall(), key=str) == want


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    table(spark, f"{tmp_path}/documents.parquet", [(1, "a", "en", "s", 1)], DOCS)
    one = merkle_manifest.op12(spark, str(tmp_path)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == H() and one.verified
    table(spark, f"{tmp_path}/none/documents.parquet", [], DOCS)
    assert merkle_manifest.op12(spark, f"{tmp_path}/none").count() == 0


def test_intervals_nest(spark):
    """Every node's interval is the union of its children's, and siblings are its parent's interval without its own."""
    rows = spark.range(37).select(F.lit("t").alias("tree"), F.col("id"), F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"))
    m = merkle_manifest.manifest(rows)
    nodes = {(r.level, r.lo): r.hi for r in m.bands[0].collect()} | {(0, k): k for k in range(37)}
    for (level, lo), hi in nodes.items():
        if level:
            inside = sorted((a, nodes[level - 1, a]) for v, a in nodes if v == level - 1 and lo <= a <= hi)
            assert inside[0][0] == lo and inside[-1][1] == hi and all(b[0] == a[1] + 1 for a, b in zip(inside, inside[1:])) and len(inside) <= 2
    assert nodes[6, 0] == 36 and max(level for level, _ in nodes) == 6


# 13: whitening


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_inertia_and_pairs(n):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, n))
    v = a @ a.T
    values = np.linalg.eigvalsh(v)
    assert all(whitening.count_above(v, s) == (values > s).sum() for s in rng.uniform(values[0] - 1, values[-1] + 1, 40))
    got, vectors = whitening.leading_pairs(v, 4)
    assert got == pytest.approx(values[::-1][:4], rel=1e-12) and np.abs(v @ vectors - vectors * got).max() < 1e-12 * values[-1] * n


def test_inertia_needs_two_by_two_pivots():
    v = np.array([[0.0, 1, 0], [1, 0, 0], [0, 0, 0]])
    assert [whitening.count_above(v, s) for s in (-2, -0.5, 0.5, 2)] == [3, 2, 1, 0]


@pytest.mark.parametrize("values, want", [([5, 5, 5, 5, 5, 1, 0], [5, 5, 5, 5]), ([3, 2, 0, 0], [3, 2]), ([1] * 6, [1] * 4), ([0, 0], []), ([9, 4, 4, 4, 4, 4, 1e-3], [9, 4, 4, 4]), ([1e9, 1, 1e-2, 1e-9, 1e-9], [1e9, 1, 1e-2])])
def test_repeated_and_missing_eigenvalues(values, want):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    v = q @ np.diag(np.array(values, float)) @ q.T
    got, vectors = whitening.leading_pairs((v + v.T) / 2, 4)
    assert got == pytest.approx(want, rel=1e-6, abs=1e-14 * max(values)) and np.abs(vectors.T @ vectors - np.eye(len(want))).max(initial=0) < 1e-12


EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def brute_whitening(rows, k=4):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v in kept])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:k] > 1e-12 * values[0]).sum())
    return [i for i, _ in kept], n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whitening_equals_numpy(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.standard_normal(12) * np.arange(1, 13) / 8]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # copies count once
    rows += [(2000, None), (2001, [None] + rows[0][1][1:]), (2002, [float("nan")] + rows[0][1][1:]), (2003, rows[0][1][1:] + [float("inf")]), (None, rows[3][1]), (2004, [0.0] * 11 + [-0.0]), (2004, [0.0] * 12)]
    table(spark, f"{tmp_path}/embeddings.parquet", [(i, v, 0) for i, v in rows], EMBEDDINGS, x="clash", n="clash", component="clash")
    got = whitening.op13(spark, str(tmp_path)).collect()
    ids, n, deviation, white, explained = brute_whitening(rows)
    assert len(got) == 4 * len(ids) and {r.n for r in got} == {n}
    assert {r.component: r.explained for r in got} == pytest.approx(dict(enumerate(explained, 1)), rel=1e-9)
    sign = {}
    want = sorted((str(i), k + 1, int(d), w[k]) for i, d, w in zip(ids, deviation, white) for k in range(4))
    for r in got:
        if r.vec_id == 1:
            sign[r.component] = np.sign(r.whitened * white[ids.index(1), r.component - 1])
    have = sorted((str(r.vec_id), r.component, r.deviation, r.whitened * sign[r.component]) for r in got)
    assert [h[:3] for h in have] == [w[:3] for w in want] and np.allclose([h[3] for h in have], [w[3] for w in want], atol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("vectors, count", [([], 0), ([None], 0), ([[]], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0], [1.0, 2.0], [2.0, 2.0]], 3), ([[1.0, 2.0], [3.0, 1.0], [0.0, 5.0], [7.0]], 6), ([[3e38, 0.0], [1.0, -3e38], [2.0, 1.0]], 6)])
def test_whitening_of_few_rows(spark, tmp_path, vectors, count):
    table(spark, f"{tmp_path}/embeddings.parquet", [(i, v, 0) for i, v in enumerate(vectors)], EMBEDDINGS)
    got = whitening.op13(spark, str(tmp_path)).collect()
    assert len(got) == count and all(np.isfinite(r.whitened) for r in got)
