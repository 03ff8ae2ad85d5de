"""The training-data operators against brute force, on small tables with every awkward case."""

import gzip
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgecast.llm import common, components, exact_dedup, jaccard_join, mixing, packing, ppm_langid, quality_hosts, token_counts, token_output, toxicity_chain, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n, words):
    return " ".join(words[i] for i in rng.integers(0, len(words), n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, ties, nulls in every column, empty, blank and very long texts, repeated rows."""
    rng = np.random.default_rng(7)
    vocab = {k: [f"{p}{i % 31}{'xyz'[i % 3]}" for i in range(400)] for k, p in (("en", "the"), ("de", "ung"), ("fr", "éau"))}
    out = []
    for i in range(120):
        lang = ("en", "de", "fr")[i % 3]
        out.append((i, sentence(rng, int(rng.integers(1, 120)), vocab[lang]), lang, f"s{i % 4}", 1))
    base = sentence(rng, 200, vocab["en"]).split(" ")
    for i in range(120, 160):
        words = list(base)
        for k in rng.integers(0, 200, int(rng.integers(0, 8))):
            words[k] = f"edit{i}{k}"
        out.append((i, " ".join(words), "en", "s0", 1))
    block = sentence(rng, 12, vocab["de"])
    out += [
        (200, None, "en", "s1", None), (201, "", None, "s1", 0), (202, " \t\n\x0b\x0c\r ", "en", None, 7), (203, "one", "en", "s1", 3), (204, "one two", "en", "s1", 7), (205, "ONE\ttwo", "en", "s1", 7),
        (206, "#*$ %&| <> 123 456", "en", "s2", 5), (207, " ".join([block] * 6), "de", "s2", 9), (208, "line a b c\nline a b c\n\n\nother", "en", "s2", 9), (209, out[5][1] + "  ", "fr", "s3", 1), (210, " " + out[5][1] + " ", "fr", "s3", 1),
        (211, "a " * 30_000, "en", "s0", 60_000), (212, "q" * 40_000, "en", "s0", 40_000), (213, sentence(rng, 9_000, vocab["fr"]), "fr", "s0", 1), (214, "日本語の文章 です 😀 é é  x", "ja", "s3", 1), (215, "x <|endoftext|> y <|startoftext|>z", "en", "s3", 1),
        (None, "row without id but with some words in it", "en", "s3", 1), (7, out[7][1], out[7][2], out[7][3], 1), (201, "", None, "s1", 0),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    """The rows as a table with an extra column whose name clashes with results."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    names = ["keep_id", "component_id", "score", "lang_pred", "sequence_id", "probability", "topic", "k1", "marks", "host"]
    spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({n: F.lit("clash") for n in names}).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(df, *by):
    return sorted((tuple(r) for r in df.collect()), key=str)


# 1: packing


def test_packing_ids_and_places(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024
        cuts = ([0] if first else []) + list(range(first, len(ids), 1024)) + [len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = packing.pack_documents(docs, common.tokenizer_path("byte_bpe_50k.tiktoken")).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(used) <= -(-sum(r.length for r in got) // 1024) + 2


def fewest_bins(sizes, capacity):
    """The optimum by search over sets of open bins."""
    states = {()}
    for s in sorted(sizes, reverse=True):
        states = {tuple(sorted((*bins[:i], bins[i] + s, *bins[i + 1 :]))) for bins in states for i in range(len(bins)) if bins[i] + s <= capacity} | {tuple(sorted((*bins, s))) for bins in states}
    return min(map(len, states))


def test_reduction_keeps_an_optimum():
    """What the reduction fixes can always be completed to an optimal packing."""
    rng = np.random.default_rng(3)
    for _ in range(150):
        capacity = int(rng.integers(6, 14))
        sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 8))).tolist()
        counts = np.bincount(sizes, minlength=capacity + 1)
        runs, rest = packing.reduce_dominated(counts, capacity)
        left = [s for s in range(1, capacity + 1) for _ in range(rest[s])]
        assert sum(m for _, m in runs) + (fewest_bins(left, capacity) if left else 0) == fewest_bins(sizes, capacity)


def test_plan_places_every_piece():
    rng = np.random.default_rng(4)
    for _ in range(100):
        capacity = int(rng.integers(3, 60))
        counts = np.zeros(capacity + 1, int)
        counts[1:] = rng.integers(0, 30, capacity) * (rng.random(capacity) < 0.5)
        got = np.zeros(capacity + 1, int)
        for contents, m in packing.plan(counts, capacity):
            assert sum(s * k for s, k in contents) <= capacity and m > 0
            for s, k in contents:
                got[s] += k * m
        assert (got == counts).all()


def test_packing_empty(empty):
    assert packing.pack_documents(empty, common.tokenizer_path("byte_bpe_50k.tiktoken")).count() == 0


# 2: language


def brute_bits(texts_by_lang, text):
    """Code lengths by walking the contexts one by one."""
    pad = lambda t: [0, 0, 0, *t.encode()]
    out = {}
    for lang, texts in texts_by_lang.items():
        counts = [defaultdict(Counter) for _ in range(4)]
        for t in texts:
            s = pad(t)
            for i in range(3, len(s)):
                for order in range(4):
                    counts[order][tuple(s[i - order : i])][s[i]] += 1
        s, bits = pad(text), 0.0
        for i in range(3, len(s)):
            p = 1.0
            for order in (3, 2, 1, 0):
                seen = counts[order].get(tuple(s[i - order : i]))
                if not seen:
                    continue
                n, d = sum(seen.values()), len(seen)
                if seen[s[i]]:
                    p *= seen[s[i]] / (n + d)
                    break
                p *= d / (n + d)
            else:
                p /= 256
            bits -= np.log2(p)
        out[lang] = bits
    return out


def test_ppm_code_lengths():
    texts = {"a": ["the cat sat on the mat", "That Hat"], "b": ["der hund und die katze", "Über größe"]}
    counts = {}
    for lang, own in texts.items():
        raw = "".join(own).encode()
        code, n = np.unique(ppm_langid.strings_of(np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in own])])), return_counts=True)
        counts[lang] = (code.astype(np.int64), n.astype(float))
    model = ppm_langid.build_model(counts)
    for text in ("the hund", "xyz 123 größer", "That", "Привет мир", "κόσμε 日本", "aaaa\x00\x00zz"):
        raw = np.frombuffer(text.encode(), np.uint8)
        got = ppm_langid.code_lengths(model, raw, np.array([0, len(raw)]))[0]
        assert np.allclose(got, list(brute_bits(texts, text).values()), rtol=1e-5)


def test_ppm_scripts(spark):
    """Languages of scripts whose letters differ in their lead bytes alone are told apart."""
    rng = np.random.default_rng(21)
    alphabets = {"el": range(0x3B1, 0x3C9), "ru": range(0x430, 0x44F), "he": range(0x5D0, 0x5EA), "ar": range(0x628, 0x642), "ja": range(0x3042, 0x3090), "zh": range(0x4E00, 0x4F00)}
    word = lambda a: "".join(chr(int(x)) for x in rng.choice(list(a), int(rng.integers(2, 8))))
    rows = [(i, " ".join(word(a) for _ in range(12)), lang, "s", 1) for i, (lang, a) in enumerate(list(alphabets.items()) * 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.lang_pred for r in ppm_langid.predict(df, ppm_langid.train(df.filter("doc_id < 90"))).collect()}
    assert all(got[r[0]] == r[2] for r in rows)


def test_ppm_probe():
    rng = np.random.default_rng(22)
    keys = np.unique(rng.integers(0, 2**32, 5_000, dtype=np.uint64).astype(np.uint32))
    probe = ppm_langid._Probe(keys)
    other = rng.integers(0, 2**32, 5_000, dtype=np.uint64).astype(np.uint32)
    asked = np.concatenate([keys, other])
    known = {int(k): i for i, k in enumerate(keys)}
    assert probe(asked).tolist() == [known.get(int(k), len(keys)) for k in asked]


def test_ppm_long_text_in_blocks(monkeypatch):
    raw = np.frombuffer(("the cat sat " * 300).encode(), np.uint8)
    code, n = np.unique(ppm_langid.strings_of(raw[:100], np.array([0, 100])), return_counts=True)
    model = ppm_langid.build_model({"a": (code.astype(np.int64), n.astype(float)), "b": (code[:5].astype(np.int64), n[:5].astype(float))})
    whole = ppm_langid.code_lengths(model, raw, np.array([0, 1000, 1000, len(raw)]))
    monkeypatch.setattr(ppm_langid, "BLOCK", 97)
    assert np.allclose(whole, ppm_langid.code_lengths(model, raw, np.array([0, 1000, 1000, len(raw)])), rtol=1e-6)


def test_ppm_cases(docs, empty, rows):
    model = ppm_langid.train(docs.filter(~common.held_out(F.col("doc_id"))))
    got = ppm_langid.predict(docs, model)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = {r.doc_id: r for r in got.collect()}
    assert len(got.collect()) == len(rows)
    assert all(found[d].lang_pred == "und" and found[d].score == 0 for d in (200, 201, 202))
    assert all(0 <= r.score <= 1 for r in found.values())
    clear = [r for r in rows if r[0] is not None and r[0] < 160]
    assert np.mean([found[r[0]].lang_pred == r[2] for r in clear]) > 0.97
    assert all(found[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in found if d is not None)
    none = ppm_langid.predict(docs, ppm_langid.train(empty))
    assert {r.lang_pred for r in none.collect()} == {"und"} and ppm_langid.predict(empty, model).count() == 0


# 3: toxicity


def newton(x, y, regularisation):
    """Logistic regression with an unpenalised intercept, to convergence."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], regularisation)
    penalty[-1] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x / len(y) + np.diag(penalty), x.T @ (p - y) / len(y) + penalty * w)
    return lambda z: 1 / (1 + np.exp(-np.column_stack([z, np.ones(len(z))]) @ w))


def test_toxicity_chain_by_hand(spark, monkeypatch):
    """Vocabulary, out-of-fold probabilities and both links against the same chain in numpy."""
    monkeypatch.setattr(toxicity_chain, "ITERATIONS", 500)
    monkeypatch.setattr(toxicity_chain, "REGULARISATION", 1e-2)
    rng = np.random.default_rng(31)
    words = [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(240):
        held = sorted(set(rng.choice(words, 6).tolist()))
        junk = int(("wa" in held) ^ (rng.random() < 0.1))
        rows.append((i, held, junk, int(("wb" in held or (junk and "wc" in held)) ^ (rng.random() < 0.05))))
    df = spark.createDataFrame(rows, "id long, words array<string>, low_quality int, toxic int")
    chain = toxicity_chain.fit_chain(df, toxicity_chain.CATEGORIES, vocabulary=16)
    n, want = len(rows), []
    for k in (2, 3):
        share = sum(r[k] for r in rows) / n
        scores = []
        for w in words:
            df_, hits = sum(w in r[1] for r in rows), sum(r[k] for r in rows if w in r[1])
            scores.append((-((hits - df_ * share) ** 2) / (df_ * share * (1 - share) * (1 - df_ / (n + 1))), w))
        want += [w for _, w in sorted(scores)[:8] if w not in want]
    assert chain.words == want
    x = np.array([[w in r[1] for w in want] for r in rows], float)
    y1, y2 = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    fold = np.array([r.f for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(3)).alias("f")).orderBy("id").collect()])
    unseen = np.zeros(n)
    for f in range(3):
        unseen[fold == f] = newton(x[fold != f], y1[fold != f], 1e-2)(x[fold == f])
    first, second = newton(x, y1, 1e-2), newton(np.column_stack([x, unseen]), y2, 1e-2)
    p1 = first(x)
    p2 = second(np.column_stack([x, p1]))
    docs = spark.createDataFrame([(r[0], " ".join(r[1]), "en", "s", 1) for r in rows], SCHEMA)
    got = sorted((r.doc_id, r.p_low_quality, r.p_toxic) for r in toxicity_chain.score_chain(docs, chain, toxicity_chain.CATEGORIES).collect())
    assert np.allclose([g[1] for g in got], p1, atol=2e-3) and np.allclose([g[2] for g in got], p2, atol=2e-3)


def test_worst_label_counts(spark):
    docs = spark.createDataFrame([(i, "some words", "en", "s", 1) for i in range(3)], SCHEMA)
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 1, 0), (2, None, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted((r.id, r.low_quality, r.toxic) for r in toxicity_chain.labelled_sample(docs, labels).collect())
    assert got == [(0, 0, 1), (1, 1, 0), (2, 0, 0)]


def test_toxicity_chain(spark, empty):
    rng = np.random.default_rng(1)
    words, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)], ["badone", "badtwo", "badthree"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = sentence(rng, int(rng.integers(20, 60)), words) + (" " + " ".join(bad[: 1 + i % 3]) if toxic else "")
        rows.append((i, text, "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(900, None, None, None, None), (901, "", "en", "s", 0)], SCHEMA)
    known = spark.createDataFrame([(i, q, t) for i, q, t in labels if i < 400] + [(None, 1, 1), (5, None, None), (12345, 1, 1)], "doc_id long, quality int, toxic int")
    sample = toxicity_chain.labelled_sample(docs, known).withColumn("severe", (F.size(F.array_intersect("words", F.array(*map(F.lit, bad)))) >= 2).cast("int")).drop("low_quality")
    chain = toxicity_chain.fit_chain(sample, ["severe", "toxic"])
    assert chain.categories == ["severe", "toxic"] and chain.models[1].numFeatures == len(chain.words) + 1
    got = {r.doc_id: r.p_toxic for r in toxicity_chain.score_chain(docs, chain, ["severe", "toxic"]).collect()}
    assert len(got) == 602 and got[900] < 0.4 and got[901] < 0.4
    held = [(got[i] >= 0.4) == bool(t) for i, _, t in labels if i >= 400]
    assert np.mean(held) > 0.98
    none = toxicity_chain.fit_chain(sample.filter("toxic = 0"), ["severe", "toxic"])
    assert {r.p_toxic for r in toxicity_chain.score_chain(docs, none, ["severe", "toxic"]).collect()} == {0.0}
    assert toxicity_chain.score_chain(empty, chain, ["severe", "toxic"]).count() == 0


# 4: host rules


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_host_counts(docs, empty, rows):
    got = quality_hosts.host_quality(docs)
    want = []
    for doc_id, text, *_ in rows:
        n, chars, symbols, dup, repeat = brute_counts(text)
        want.append((doc_id, n, chars, symbols, dup, repeat, n < 20 or 100 * repeat > 30 * n))
    assert ordered(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted(want, key=str)
    assert not any(r.kept and r.base_failed for r in got.collect()) and quality_hosts.host_quality(empty).count() == 0


def test_host_verdicts(spark):
    good, poor = "w" + " w".join(map(str, range(30))), "too short"
    rows = [(i, poor if i % 10 else good, "en", "bad", 1) for i in range(100)] + [(1000 + i, good if i % 10 else poor, "en", "fine", 1) for i in range(100)] + [(2000, good, "en", None, 1)]
    got = {r.doc_id: r for r in quality_hosts.host_quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[0].kept and not got[0].base_failed and got[1001].kept and not got[1000].kept
    assert 0.1 < got[2000].host_rate < 0.9  # one document: pulled to the mean


# 5: mixing


@pytest.mark.parametrize("task_cells", [mixing.TASK_CELLS, 3])
def test_raking_matches_numpy(spark, monkeypatch, task_cells):
    monkeypatch.setattr(mixing, "TASK_CELLS", task_cells)
    rng = np.random.default_rng(5)
    cells = [(f"s{i}", f"l{j}", f"t{k}", float(rng.integers(1, 100))) for i in range(4) for j in range(3) for k in range(2) if rng.random() < 0.8]
    df = spark.createDataFrame(cells, "mix_source string, mix_lang string, topic string, weight double")
    targets = {d: mixing.tempered(df, d, 0.5) for d in mixing.DIMENSIONS}
    got = {(r.mix_source, r.mix_lang, r.topic): r.ratio for r in mixing.rake(df, targets, tolerance=1e-7).collect()}
    w = {c[:3]: c[3] for c in cells}
    now, total = dict(w), sum(w.values())
    goals = []
    for d in range(3):
        sums = Counter()
        for c, x in w.items():
            sums[c[d]] += x
        whole = sum(x**0.5 for x in sums.values())
        goals.append({v: x**0.5 / whole * total for v, x in sums.items()})
    for _ in range(60):
        for d in range(3):
            sums = Counter()
            for c, x in now.items():
                sums[c[d]] += x
            now = {c: x * goals[d][c[d]] / sums[c[d]] for c, x in now.items()}
    assert all(abs(got[c] - now[c] / w[c]) < 1e-5 * now[c] / w[c] + 1e-6 for c in w)


def brute_topic(text):
    raw = (text or "").encode()
    for name, members, share in mixing.FORMS:
        if sum(b in members for b in raw) > len(raw) * share:
            return name
    return mixing.PROSE


def spark_hash(doc_id, seed):
    """Spark's xxhash64 of (bigint, string), modulo 2^40; a null leaves the hash as it is."""
    import struct

    import xxhash

    h = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    return xxhash.xxh64_intdigest(seed.encode(), h) % (1 << 40) / (1 << 40)


def test_mixing_by_hand(docs, rows):
    """Topics, weights, raked probabilities and the draw of every row against a plain computation."""
    path = common.tokenizer_path("byte_bpe_50k.tiktoken")
    got = mixing.mix(docs, path)
    assert got.columns == ["id", "mix_source", "mix_lang", "topic", "n_tokens", "probability", "sampled"]
    cells, weight = [], Counter()
    for _, text, lang, source, _ in rows:
        cells.append((source or "unknown", lang or "unknown", brute_topic(text)))
        weight[cells[-1]] += len(packing.encode(path, text))
    total = sum(weight.values())
    heavy = {c: float(w) for c, w in weight.items() if w}
    goals = []
    for d in range(3):
        sums = Counter()
        for c, w in heavy.items():
            sums[c[d]] += w
        whole = sum(w**mixing.POWER for w in sums.values())
        goals.append({v: w**mixing.POWER / whole * sum(heavy.values()) for v, w in sums.items()})
    now = dict(heavy)
    for _ in range(2_000):
        for d in range(3):
            sums = Counter()
            for c, w in now.items():
                sums[c[d]] += w
            now = {c: w * goals[d][c[d]] / sums[c[d]] for c, w in now.items()}
    ratio = {c: now[c] / heavy[c] for c in heavy}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(weight[c] * min(1, mid * r) for c, r in ratio.items()) >= mixing.FRACTION * total else (mid, high)
    want = defaultdict(list)
    for (doc_id, text, *_), c in zip(rows, cells, strict=True):
        p = min(1, high * ratio[c]) if c in ratio else 0.0
        want[doc_id, *c, len(packing.encode(path, text))].append((p, spark_hash(doc_id, "mix")))
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        p, u = want[r.id, r.mix_source, r.mix_lang, r.topic, r.n_tokens].pop()
        assert abs(r.probability - p) < 5e-3 and (r.sampled == (u < p) or abs(u - p) < 5e-3)


def test_mixing_cases(spark, docs, empty, rows):
    path = common.tokenizer_path("byte_bpe_50k.tiktoken")
    found = mixing.mix(docs, path).collect()
    assert any(r.sampled for r in found) and {r.sampled for r in found if r.id == 7} in ({True}, {False}) and mixing.mix(empty, path).count() == 0
    clash = docs.withColumns({n: F.lit("own") for n in ("k_p", "k_mix_source", "mix_source", "mix_lang", "n_tokens", "sampled", "id", "__topic_")})
    kept = mixing.keep_sampled(clash, path)
    assert kept.columns == clash.columns and {r.topic for r in kept.collect()} == {"clash"} and {r.n_tokens for r in kept.collect()} == {"own"}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.id) for r in found if r.sampled)
    assert mixing.keep_sampled(empty, path).count() == 0
    by_topic = mixing.mix(docs.withColumn("theme", F.when(F.col("doc_id") % 2 == 0, "even")), path, topic_col="theme")
    assert {r.topic for r in by_topic.collect()} == {"even", "unknown"}


def test_partial_targets_lose_no_document(spark):
    rows = [(i, "w " * 50, "en", "st"[i % 2], 1) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    share = spark.createDataFrame([("s", 1.0), ("absent", 9.0)], "mix_source string, target double")
    got = mixing.mix(df, common.tokenizer_path("byte_bpe_50k.tiktoken"), targets={"mix_source": share}).collect()
    assert {r.probability for r in got if r.mix_source == "t"} == {r.probability for r in got if r.mix_source == "s"} and min(r.probability for r in got) > 0.4
    none = spark.createDataFrame([("s", 1.0), ("t", 0.0)], "mix_source string, target double")
    got = mixing.mix(df, common.tokenizer_path("byte_bpe_50k.tiktoken"), targets={"mix_source": none}).collect()
    assert {r.probability for r in got if r.mix_source == "t"} == {0.0} and min(r.probability for r in got if r.mix_source == "s") > 0.999


# 6: token shards


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        assert sorted(token_output.permute(np.arange(n), n).tolist()) == list(range(n))
    assert (token_output.permute(np.arange(1000), 1000, 1) != token_output.permute(np.arange(1000), 1000, 2)).any()


def test_compressed_ids_round_trip():
    rng = np.random.default_rng(2)
    frequent = rng.permutation(50_257)[: token_output.TWO_BYTES]
    for chosen in (frequent, frequent[:50], frequent[:0]):
        for n in (0, 1, 1024):
            ids = rng.integers(0, 50_257, n).astype(np.uint32)
            assert token_output.expand_ids(token_output.compress_ids(ids, token_output.ranks_of(chosen)), n, chosen).tolist() == ids.tolist()


def test_wide_ids(spark, docs, tmp_path):
    out = f"file://{tmp_path}/wide"
    path = common.tokenizer_path("byte_bpe_50k.tiktoken")
    got = sorted(token_output.materialise_order(docs, path, out, length=64, per_shard=32, wide=True).collect(), key=lambda r: r.slot)
    assert [zlib.crc32(x.tobytes()) for x in token_output.read_order(out, **token_output.read_manifest(spark, out))] == [r.ids_crc32 for r in got]


def test_shard_sizes():
    assert [token_output.shard_size(n, 8) for n in (0, 5_000, 1_000_000, 10**10)] == [4096, 4096, 16_384, 1 << 19]


def feistel(x, n, key):
    """The permutation one number at a time."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, whole = (1 << half) - 1, (1 << 64) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(token_output.FEISTEL_ROUNDS):
            f = (right + key + (r + 1) * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & whole
            f = (f ^ (f >> 31)) * 0x94D049BB133111EB & whole
            left, right = right, left ^ ((f ^ (f >> 29)) & mask)
        x = (left << half) | right
        if x < n:
            return x


def test_slot_order(spark, docs, tmp_path, monkeypatch):
    """Every slot's ids and documents against texts joined, cut and permuted one by one."""
    monkeypatch.setattr(token_output, "PARTITIONS", 3)
    path, out, length = common.tokenizer_path("byte_bpe_50k.tiktoken"), f"file://{tmp_path}/order", 64
    parts = defaultdict(list)
    for r in docs.select("doc_id", "text", F.spark_partition_id().alias("p")).collect():
        parts[r.p].append(r)
    cut = []
    for p in sorted(parts):
        flat = [(i, r.doc_id) for r in parts[p] for i in [*packing.encode(path, r.text).tolist(), packing.END_ID]]
        cut += [flat[a : a + length] for a in range(0, len(flat), length)]
    want = {feistel(k, len(cut), token_output.KEY): s for k, s in enumerate(cut)}
    assert sorted(want) == list(range(len(cut)))
    got = {r.slot: r for r in token_output.materialise_order(docs, path, out, length=length, per_shard=16).collect()}
    read = list(token_output.read_order(out, **token_output.read_manifest(spark, out)))
    assert len(got) == len(read) == len(cut)
    for slot, s in want.items():
        ids = [i for i, _ in s]
        assert read[slot].tolist() == ids + [packing.END_ID] * (length - len(ids))
        assert got[slot].n_tokens == len(ids) and got[slot].doc_ids == list(dict.fromkeys(d for _, d in s))
        assert got[slot].shard == slot // 16 and got[slot].byte_offset == slot % 16 * length * 2


def test_shards_resume(docs, spark, empty, tmp_path):
    path = common.tokenizer_path("byte_bpe_50k.tiktoken")
    out = f"file://{tmp_path}/shards"
    n = token_output.materialise_order(docs, path, out, length=64, per_shard=32).count()
    places = token_output.read_manifest(spark, out)
    read = list(token_output.read_order(out, **places))
    late = list(token_output.read_order(out, **places, start=n // 2))
    assert len(read) == n and all((a == b).all() for a, b in zip(read[n // 2 :], late, strict=True))
    assert token_output.materialise_order(empty, path, out + "-none").count() == 0


# 7: WARC


def test_warc_records(spark, tmp_path):
    page = '<!DOCTYPE html><html lang="fr"><head><title>A &amp;\n B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- no --><p>One<br>two <b>three</b></p><a href="/x">l</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a/", page), (2, None, None), (3, "http://b/", ""), (3, "http://b/", "")], "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    source = warc.responses(pages)
    records = warc.derive(source)
    rows = records.collect()
    assert len(rows) == 8
    one = {r.warc_type: r for r in rows if r.page_id == 1}
    assert one["conversion"].block == "A &\nB\nOne\ntwo three\nl"
    fields = one["metadata"].block
    assert "source-header: HTTP/1.1 200 OK\n" in fields and "title: A & B\n" in fields and "language: fr\n" in fields and "links: 1\n" in fields and one["conversion"].record_id in fields
    ids = {r.page_id: r.response_id for r in source.collect()}
    assert all(r.refers_to == ids[r.page_id] for r in rows) and {r.source_digest for r in rows if r.page_id == 1} == {r.payload_digest for r in source.collect() if r.page_id == 1}
    written = warc.write_warc(records, f"file://{tmp_path}/w").collect()
    for w in written:
        raw = open(w.path.removeprefix("file://"), "rb").read()[w.member_offset : w.member_offset + w.member_length]
        head, _, body = gzip.decompress(raw).partition(b"\r\n\r\n")
        row = next(r for r in rows if r.record_id == w.record_id)
        assert body == row.block.encode() + b"\r\n\r\n" and f"WARC-Refers-To: {row.refers_to}".encode() in head
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_captures_have_ids_of_their_own(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>one"), (1, "http://a/", "<p>two"), (1, "http://a/", "<p>two")], "page_id long, url string, html string")
    rows = warc.derive(warc.responses(pages)).collect()
    assert len({r.record_id for r in rows}) == 4 and len({r.refers_to for r in rows}) == 2
    own = pages.withColumns({"head": F.lit("HTTP/1.1 404 Gone\nX-Own: 1"), "at": F.lit("2020-02-02T02:02:02Z")})
    kept = warc.derive(warc.responses(own, "head", "at")).filter("warc_type = 'metadata'").first()
    assert "source-header: HTTP/1.1 404 Gone\nsource-header: X-Own: 1\n" in kept.block and kept.warc_date == "2020-02-02T02:02:02Z"


def test_read_responses(spark, tmp_path):
    """Captured responses keep their ids, headers, dates and digests in the records derived from them."""
    def record(kind, own, block, more=""):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{f'WARC-Record-ID: <urn:uuid:{own}>' if own else 'X: y'}\r\nWARC-Target-URI: http://x/{own}\r\nWARC-Date: 2021-03-04T05:06:07Z\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    page = b"HTTP/1.1 200 Fine\r\nContent-Type: text/html; charset=ISO-8859-1\r\nX-A: b\r\n\r\n<title>T</title><p>caf\xe9\r\n\r\nend"
    records = [record("warcinfo", "0", b"software: none"), record("response", "1", page, "WARC-Payload-Digest: sha1:ABC\r\n"), record("request", "2", b"GET / HTTP/1.1\r\n\r\n"), record("response", "", page)]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "w" / "b.warc").write_bytes(records[1])
    source = warc.read_responses(spark, f"file://{tmp_path}/w")
    rows = source.collect()
    assert len(rows) == 3 and sum(r.response_id == "<urn:uuid:1>" for r in rows) == 2 and all(r.payload.startswith("<title>T</title><p>café") for r in rows)
    made = warc.derive(source).filter("refers_to = '<urn:uuid:1>'").collect()
    meta, text = ([r for r in made if r.warc_type == k] for k in ("metadata", "conversion"))
    assert len(meta) == len(text) == 2 and text[0].block == "T\ncafé\nend" and text[0].source_digest == "sha1:ABC" and text[0].warc_date == "2021-03-04T05:06:07Z"
    assert "source-header: HTTP/1.1 200 Fine\n" in meta[0].block and "source-header: X-A: b\n" in meta[0].block and text[0].record_id in meta[0].block


def test_hostile_pages_take_linear_time(spark):
    import time

    for piece in ("<script>", "<script ", "<!--", "<style a", "<title>", "<p ", "<a ", "<html ", "<", "&#", "&amp", "<style>x</script>"):
        html = piece * (1_000_000 // len(piece))
        start = time.time()
        pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
        assert warc.derive(warc.responses(pages)).agg(F.sum("content_length")).first()[0] > 0
        assert time.time() - start < 20, piece


def test_warc_sql_decodes_alike(spark):
    """The SQL twin on pages of every named reference, awkward numbers and unclosed tags."""
    import pandas as pd
    from html import entities

    texts = [" ".join(f"&{n}" for n in entities.html5), *[f"&#{n}; &#x{n:x}z" for n in [*range(0, 300), 0xD800, 0xFDD0, 0x1FFFE, 0x10FFFF, 0x110000, 10**20]], "&#; &#x; &; & &unknown; &ampx; a&b &notit;", "<script>x", "a<!-- b", "<title>q", "<p class='a<b'>z", None, ""]
    pages = [(i, f"http://{i}/", t) for i, t in enumerate(texts)]
    connection = duckdb.connect()
    connection.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    want = connection.sql(warc.OP7_SQL).df()
    got = warc.derive(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string"))).select(*want.columns).toPandas()
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, want.values.tolist()))


# 8: Jaccard


def brute_components(rows, words=3, percent=90):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for doc_id, text in rows:
        w = WORD.findall((text or "").translate(fold))
        sets.append((doc_id, frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low.setdefault(root(i), []).append(d)
    return [(d, len(s), min((x for x in low[root(i)] if x is not None), default=None)) for i, (d, s) in enumerate(sets)]


@pytest.mark.parametrize("leaf, words, percent", [(2048, 3, 90), (8, 3, 90), (2048, 5, 80), (8, 5, 80)])
def test_jaccard_components(docs, rows, monkeypatch, leaf, words, percent):
    monkeypatch.setattr(jaccard_join, "LEAF_CLASSES", leaf)
    got = jaccard_join.jaccard_components(docs, words=words, percent=percent)
    assert ordered(got) == sorted(brute_components([r[:2] for r in rows], words, percent), key=str)


def test_jaccard_family(spark, monkeypatch):
    """A large family around the threshold, cut into regions, windows and blocks."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(260):
        words = list(base)
        for k in rng.integers(0, 80, int(rng.integers(0, 5))):
            words[k] = f"e{rng.integers(0, 6)}"
        rows.append((i, " ".join(words[: int(rng.integers(74, 81))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute_components(rows), key=str)
    assert len({r[2] for r in want}) > 3
    assert ordered(jaccard_join.jaccard_components(df)) == want
    monkeypatch.setattr(components, "HEAVY", 20)
    for leaf, pivots in ((40, 1), (12, 3)):
        monkeypatch.setattr(jaccard_join, "LEAF_CLASSES", leaf)
        monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
        assert ordered(jaccard_join.jaccard_components(df)) == want


def test_jaccard_template(spark, monkeypatch):
    """Texts that are alike without being near: the marks overlap, the pivots' cells stay small and the rest is joined by blocks."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(150):
        words = [f"t{k}" for k in range(60)]
        for k in rng.choice(60, 5, replace=False):
            words[k] = f"v{rng.integers(0, 3)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(jaccard_join, "LEAF_CLASSES", 16)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=1, percent=95)
    assert ordered(got) == sorted(brute_components(rows, 1, 95), key=str)


def test_marks_lose_no_pair():
    rng = np.random.default_rng(13)
    for percent in (80, 90):
        for _ in range(300):
            a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 120))).astype(np.uint64))
            keep = a[rng.random(len(a)) < rng.uniform(0.85, 1)]
            b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            often = np.unique(rng.choice(a, len(a) // 3, replace=False)) if len(a) > 2 else a[:0]
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = jaccard_join.prefix_marks([a, b], (often, rng.permutation(len(often))), percent)
                assert len(set(x.tolist()) & set(y.tolist())) >= max(jaccard_join.marks_needed(len(a), percent), jaccard_join.marks_needed(len(b), percent))


def test_jaccard_empty(empty):
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, 5), (5, 3), (9, 9), (7, 8), (8, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {1: 1, 5: 1, 3: 1, 7: 7, 8: 7}


# 9: token counts


def test_token_counts(docs, empty, rows):
    from tokenizers import Tokenizer

    path = common.tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = [(d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t, *_ in rows]
    assert ordered(token_counts.count_tokens(docs, path)) == sorted(want, key=str)
    assert ordered(token_counts.count_tokens(docs, path, chunk=300, overlap=8)) == sorted(want, key=str)
    assert token_counts.count_tokens(empty, path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_resynchronisation(rows, name):
    tok = token_counts.tokenizer(common.tokenizer_path(name))
    rng = np.random.default_rng(9)
    odd = [(0, "".join(rng.choice(list("ab1'!<|>s.é\u0301 \n日"), 900).tolist())) for _ in range(20)]
    for _, text, *_ in [*rows, *odd]:
        for chunk, overlap in ((40, 3), (500, 20), (100_000, 50)):
            text = (text or "")[:4000]
            got = np.concatenate([*token_counts.resync_ids(tok, text, chunk, overlap)])
            assert got.tolist() == tok.encode(text, add_special_tokens=False).ids


def test_huge_texts_without_white_space():
    """Megabytes without white space take time in proportion, with and without splice points."""
    import time

    tok = token_counts.tokenizer(common.tokenizer_path("word_bpe_49k.json"))
    mixed = "".join(f"ab{i % 977}Cd+{i % 31}/" for i in range(90_000))
    plain = "".join(chr(0x4E00 + (i * 7919) % 20_000) for i in range(300_000))
    for text in (mixed, plain, "é" * 200_001, "don't<|endoftext|>" * 4_000):
        start = time.time()
        whole = len(tok.encode(text, add_special_tokens=False).ids)
        middle = time.time()
        assert token_counts.resync_count(tok, text) == whole
        assert time.time() - middle < 8 * (middle - start) + 2
    start = time.time()
    assert token_counts.resync_count(tok, mixed * 5) > 0 and time.time() - start < 60


# 10: exact dedup


def test_exact_dedup(spark, docs, empty, rows):
    import hashlib

    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    want = []
    for key, members in groups.items():
        first, *others = sorted(members)
        sha = hashlib.sha256(key.encode()).hexdigest()
        want += [(first[2], first[2], len(members), True, sha, -first[0])] + [(d, first[2], len(members), False, sha, -n) for n, _, d in others]
    got = exact_dedup.exact_dedup(docs)
    assert ordered(got) == sorted(want, key=str) and exact_dedup.exact_dedup(empty).count() == 0


def test_one_row_of_repeated_ids_stays(spark):
    """Ids on rows of different texts, null ids, rows that tie in everything: one row of each text stays and no text is lost."""
    rows = [(1, "a b", "x"), (1, "a  b", "x"), (1, "c", "x"), (2, "c ", "x"), (3, "d", "x"), (3, "d", "x"), (3, "d", "y"), (4, "e f", "x"), (4, "e\tf", "x"), (None, "g", "x"), (None, "g", "x"), (5, "h", "x"), (None, "h i", "x"), (6, None, "x"), (7, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kept", F.lit("clash"))
    found = exact_dedup.exact_dedup(df)
    assert found.filter("kept").count() == found.select("text_sha256").distinct().count() == 8
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns
    got = sorted(((r.doc_id or 0, r.text) for r in left.collect()))
    assert got == [(0, "g"), (0, "h i"), (1, "a  b"), (2, "c "), (3, "d"), (4, "e\tf"), (5, "h"), (7, " ")]


def test_heavy_digests_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY", 10)
    rows = [(i, "same text" + " " * (i % 7), "s") for i in range(95)] + [(100, "other", "s")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 96 and [r.doc_id for r in got if r.kept and r.group_size > 1] == [6] and {r.keep_id for r in got} == {6, 100}


def test_cuckoo_index_grows_and_deletes():
    import hashlib

    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(20_000)]
    index = exact_dedup.CuckooIndex(4)
    for i, k in enumerate(keys):
        index.insert(k, i, 1)
        index.insert(k, i + 1, 2) if i % 2 else None
    assert index.rebuilds > 5 and index.live == len(keys) and all(index.find(k)[3] == 1 + i % 2 for i, k in enumerate(keys))
    assert index.find(keys[1])[1] == 2
    again = exact_dedup.CuckooIndex()
    again.load([list(k) for k in index.keys()], index.filter.to_bytes())
    assert again.filter.table == index.filter.table and all(again.find(k) for k in keys)
    for k in keys[:5_000]:
        assert again.delete(k)
    assert again.find(keys[0]) is None and not again.delete(keys[0]) and again.live == 15_000
    assert all(again.find(k) for k in keys[5_000:]) and again.replace(keys[6_000], 9, 9, 9) and again.find(keys[6_000])[1:4] == [9, 9, 9]
    missing = [hashlib.sha256(f"x{i}".encode()).digest() for i in range(5_000)]
    assert not any(again.find(k) for k in missing)


def test_live_index(spark):
    """Deletions elect the next representative, ignore rows that were never inserted and empty a digest with its last member."""
    table = lambda rows: exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    rows = table([(1, "a b"), (2, "ab"), (5, "a  b"), (3, "c"), (None, "c")])
    keys = lambda index: sorted((str(r.keep_id), r.keep_chars, r.n) for r in exact_dedup.keys_of(index.table).collect())
    first = exact_dedup.LiveIndex(4).insert(rows)
    assert keys(first) == [("3", 1, 2), ("5", 4, 3)]
    second = first.delete(table([(5, "ab"), (9, "ab"), (1, "c"), (7, "nowhere")]))
    assert keys(second) == [("1", 3, 2), ("3", 1, 2)]
    third = second.delete(table([(3, "c"), (1, "ab")])).insert(table([(4, "a b  c")]))
    assert keys(third) == [("2", 2, 1), ("4", 6, 1), ("None", 1, 1)]
    last = third.delete(table([(None, "c"), (2, "ab")]))
    assert keys(last) == [("4", 6, 1)]
    found = {(r.doc_id, r.keep_id, r.group_size) for r in last.lookup(table([(1, "ab"), (8, "abc"), (9, "zz")])).collect()}
    assert found == {(1, None, None), (8, 4, 1), (9, None, None)}
    assert exact_dedup.LiveIndex(4).delete(rows).table is None


# SQL twins and the pipeline


@pytest.mark.parametrize("module", [quality_hosts, exact_dedup])
def test_sql_twins(docs, rows, module):
    import pandas as pd

    unique = list({r[0]: r for r in rows if r[0] is not None}.values())
    connection = duckdb.connect()
    connection.register("documents", pd.DataFrame(unique, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "int64"}))
    name, function = ("OP4_SQL", quality_hosts.host_quality) if module is quality_hosts else ("OP10_SQL", exact_dedup.exact_dedup)
    want = connection.sql(getattr(module, name)).df()
    got = function(docs.sparkSession.createDataFrame(unique, SCHEMA)).select(*want.columns).toPandas()
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, want.values.tolist()))


def test_pipeline_by_stage(spark, docs, rows, tmp_path):
    """Every stage against brute force on what its predecessor kept, over a table with clashing extra columns."""
    import corpus_pipeline

    table = docs.filter("doc_id is not null")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before, table = table, common.materialise(stage(spark, table, str(tmp_path)), name)
        steps[name] = (before, table)
        if name != "packing":
            assert table.columns == before.columns
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    text_of = {r[0]: r[1] for r in rows}
    before, after = steps["language_id"]
    assert not {200, 201, 202} & set(ids(after)) and set(range(160)) <= set(ids(after))
    before, after = steps["exact_dedup"]
    groups = defaultdict(list)
    for d in set(ids(before)):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text_of[d])].append((-len(text_of[d]), d))
    assert ids(after) == sorted(min(g)[1] for g in groups.values())
    before, after = steps["jaccard_join"]
    near = brute_components([(d, text_of[d]) for d in ids(before)], corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    assert ids(after) == sorted({c for _, _, c in near}) and len(ids(after)) < len(near)
    before, after = steps["mixing"]
    assert ids(after) == sorted(r.id for r in mixing.mix(before, common.tokenizer_path("byte_bpe_50k.tiktoken")).filter("sampled").collect())
    before, after = steps["packing"]
    assert sorted({r.doc_id for r in after.collect()}) == ids(before)


def test_pipeline_without_labels_or_rows(spark, docs, empty, tmp_path):
    import corpus_pipeline

    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identify_language(spark, unlabelled, str(tmp_path)).count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_near_copies_on_five_words(spark, tmp_path):
    """Pairs at 80 % of their five-word shingles go, though they are under 90 % of three words; looser pairs stay."""
    import corpus_pipeline

    base = [[f"d{d}w{i}" for i in range(200)] for d in range(4)]
    edits = ((40, 80, 120, 160), (20, 60, 100, 140, 180), (100,), ())
    edited = [["edit" if i in k else x for i, x in enumerate(w)] for w, k in zip(base, edits)]
    texts = [(10 * d, " ".join(w)) for d, w in enumerate(base)] + [(10 * d + 1, " ".join(w)) for d, w in enumerate(edited)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], SCHEMA)
    want = {c for _, _, c in brute_components(texts, 5, 80)}
    assert want == {0, 10, 11, 20, 30} and 1 in {c for _, _, c in brute_components(texts)}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, str(tmp_path)).collect()} == want


def test_stray_rows_leave_the_share(spark, recwarn):
    """One document of a new source, language and topic changes neither what stays nor whether raking converges."""
    rng = np.random.default_rng(17)
    size = lambda i: int(rng.integers(150, 250)) * (1 + 9 * (i % 3 == 0))
    rows = [(i, "w " * size(i), ("en", "de", "fr")[int(rng.integers(0, 3))], f"s{i % 4}", 1) for i in range(2_000)]
    stray = [(9_000, "# " * 50, "xx", "new", 1)]
    kept = []
    for table in (rows, rows + stray):
        got = mixing.mix(spark.createDataFrame(table, SCHEMA), common.tokenizer_path("byte_bpe_50k.tiktoken"))
        kept.append(got.agg(F.sum(F.col("n_tokens") * F.col("probability")) / F.sum("n_tokens")).first()[0])
    assert abs(kept[0] - mixing.FRACTION) < 0.01 and abs(kept[1] - kept[0]) < 0.01
    assert not [w for w in recwarn if "raking" in str(w.message)]


def test_raking_reports_missing_convergence(spark):
    cells = spark.createDataFrame([("a", "x", "t", 90.0), ("a", "y", "t", 900.0), ("b", "z", "u", 9.0)], "mix_source string, mix_lang string, topic string, weight double")
    targets = {d: mixing.tempered(cells, d, 0.5) for d in mixing.DIMENSIONS}
    with pytest.warns(UserWarning, match="raking ended"):
        mixing.rake(cells, targets, rounds=3, strict=False)
    with pytest.raises(ArithmeticError, match="raking ended"):
        mixing.rake(cells, targets, rounds=3)


def test_references_are_decoded(spark):
    """Whole pages against html.unescape, with every named reference and awkward numeric ones."""
    import html
    from html import entities

    odd = ["&copy;", "&copy2", "&notit;", "&notin;", "&amp;lt;", "&amp;amp;", "&#169;", "&#xA9", "&#X1F600;", "&#0;", "&#x80;", "&#129;", "&#x1;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#0000065;", "&#xFFFF;", "&#;", "&#x;", "&;", "&", "& x", "&unknown;", "&ampx;", "a&b", "&#39;&middot;"]
    texts = [" ".join(f"&{n}" for n in entities.html5), *odd, *[f"&#{n};" for n in [*range(0, 300), 0xFDD0, 0x1FFFE]]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", warc.decode_references(F.col("t")).alias("t")).collect()
    nbsp = lambda t: html.unescape(t.replace("&nbsp", "&#160")).replace("\xa0", " ")
    assert [(r.i, r.t) for r in sorted(rows)] == [(i, nbsp(t)) for i, t in enumerate(texts)]
    pages = spark.createDataFrame([(1, "http://a/", "<p>A &amp;lt; B&nbsp;C</p><footer>&copy; 2024 &middot; x &#8212; y</footer>")], "page_id long, url string, html string")
    blocks = [r.block for r in warc.derive(warc.responses(pages)).collect() if r.warc_type == "conversion"]
    assert blocks == ["A &lt; B C\n© 2024 · x — y"]
