"""Periodic runs, whitening and toxicity against plain versions, odd rows and the registered queries."""

import hashlib
import random
import zlib
from fractions import Fraction

import brute_texts as brute
import numpy as np
import pytest

from reelgrid.llm import loops, queries, toxicity, whitening

SF = "/root/testdata/sf0.001"


def crc(key) -> int:
    return zlib.crc32(str(key).encode())


# Periodic runs


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # periods rise, so the smallest stays
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words):
    gone = {i for s, n, q in brute_runs(words) for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def loop_texts():
    rng = random.Random(8)
    texts = []
    for _ in range(400):
        words = [rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 70))]
        if words and rng.random() < 0.6:
            a = rng.randrange(len(words))
            p = 1 + rng.randrange(max(1, (len(words) - a) // 3))
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
        texts.append(rng.choice([" ", "\n", "\t \x0b"]).join(words))
    return [*brute.ODD_TEXTS, *texts, "a b a b a b a b a b b b b b b b"]


def test_loops_equal_brute_force(spark):
    texts = loop_texts()
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, texts[-1], None, None), (3, texts[3], "x", "y")]
    clips = spark.createDataFrame(rows, "clip_id bigint, description string, runs string, n_words string").repartition(3)
    found = loops.find_loops(clips).collect()
    assert len(found) == len(rows)
    want = {i: t for i, t in enumerate(texts)} | {None: texts[-1]}
    total = 0
    for r in found:
        words = brute.WORD.findall(want[r.clip_id] or "")
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(words), brute_runs(words), brute_collapsed(words))
        total += len(r.runs)
    assert total > 150  # the case has runs to find
    assert loops.find_loops(clips.limit(0)).count() == 0


def test_very_long_loops(spark):
    rng = random.Random(3)
    period = [f"w{rng.randrange(9)}" for _ in range(20_000)]
    texts = ["again " * 200_000, " ".join(period * 5), " ".join(f"w{rng.randrange(40)}" for _ in range(200_000))]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = {r.clip_id: r for r in loops.find_loops(spark.createDataFrame(rows, "clip_id bigint, description string")).collect()}
    assert [tuple(x) for x in found[0].runs] == [(0, 200_000, 1)] and found[0].collapsed == "again"
    assert (0, 100_000, 20_000) in [tuple(x) for x in found[1].runs]
    assert len(brute.WORD.findall(found[1].collapsed)) <= 20_000
    assert found[2].n_words == 200_000


def test_periodic_runs_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in queries.periodic_runs(spark, SF).collect()}
    assert len(found) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    with_runs = 0
    for doc in docs:
        words = brute.WORD.findall(doc.text or "")
        n, h = len(words), crc(doc.doc_id)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = found[doc.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == sha(brute_collapsed(words))
        with_runs += bool(runs)
    assert with_runs > 5


# Whitening


def integer_rows(rows):
    out = []
    for key, v in rows:
        if v and all(x is not None and np.isfinite(x) and abs(np.floor(256 * x)) < 2**63 for x in v):
            out.append((key, [int(np.floor(256 * x)) for x in v]))
    return out


def check_whitening(found, rows, components=4):
    """Compare with exact fractions and with numpy's eigenvectors."""
    usable = integer_rows(rows)
    fit = sorted({tuple(x) for _, x in usable})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    exact = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3) for j in range(dims)] for i in range(dims)]
    cov = np.array([[float(c) for c in row] for row in exact])
    values, vectors = np.linalg.eigh(cov)
    k = min(components, int((values > 1e-9 * values.max()).sum()))
    assert len(found) == len(usable) * k
    assert {(r.frame_id, r.component) for r in found} == {(key, c + 1) for key, _ in usable for c in range(k)}
    by_key = {}
    for key, x in usable:
        by_key.setdefault(key, x)
    deviation = {key: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for key, x in by_key.items()}
    for r in found:
        assert (r.n, int(r.deviation)) == (n, deviation[r.frame_id])
        assert r.explained == pytest.approx(values[-r.component] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
    return values[::-1][:k], vectors[:, ::-1][:, :k].T, {key: np.array(x) - np.array(sums) / n for key, x in by_key.items()}


def vectors_of(spark, rows):
    data = [(k, v, "x", 1) for k, v in rows]
    return spark.createDataFrame(data, "frame_id bigint, features array<double>, n string, component int").repartition(3)


def test_whitening_equals_exact_fractions(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6)) * [3, 2, 1, 0.7, 0.2, 0.1]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + i, rows[0][1]) for i in range(200)] + [(5, rows[5][1])]  # repetitions count once
    odd = [(400, None), (401, []), (402, [1.0] * 5), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (404, [float("nan")] * 6),
           (405, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (406, [1e300] * 6), (407, [1.0] * 7)]
    found = whitening.whiten_vectors(vectors_of(spark, rows + odd)).collect()
    values, vectors, centred = check_whitening(found, rows)
    for c in range(4):
        want = {k: float(x @ vectors[c]) / values[c] ** 0.5 for k, x in centred.items()}
        mine = {r.frame_id: r.whitened for r in found if r.component == c + 1}
        sign = np.sign(sum(want[k] * mine[k] for k in want))
        assert all(abs(sign * want[k] - mine[k]) < 1e-8 for k in want)


def test_whitening_of_equal_eigenvalues_and_few_dimensions(spark):
    ends = [(2 * d + s, [(1.0 if s else -1.0) if i == d else 0.0 for i in range(5)]) for d in range(5) for s in (0, 1)]
    found = whitening.whiten_vectors(vectors_of(spark, ends)).collect()
    assert len(found) == 40 and {r.explained for r in found} == {0.2}
    w = np.array([[r.whitened for r in sorted(found, key=lambda r: r.frame_id) if r.component == c] for c in range(1, 5)])
    assert np.abs(w @ w.T / 10 - np.eye(4)).max() < 1e-9
    line = [(i, [i / 16, i / 8, 1.0]) for i in range(30)]
    assert {r.component for r in whitening.whiten_vectors(vectors_of(spark, line)).collect()} == {1}
    equal = [(i, [1.0, 2.0]) for i in range(4)]
    assert whitening.whiten_vectors(vectors_of(spark, equal)).count() == 0
    assert whitening.whiten_vectors(vectors_of(spark, equal).limit(0)).count() == 0
    with pytest.raises(ValueError, match="result column"):
        whitening.whiten_vectors(vectors_of(spark, equal), key="n")


def test_whitening_of_great_entries(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(40, 3)) * [1e12, 1e6, 1.0] + [1e13, 0, 0])]
    small = [r for r in whitening.fit_whitening(vectors_of(spark, rows)).eigenvalues]
    x = np.floor(np.array([v for _, v in rows]) * 256)
    assert small[:2] == pytest.approx(np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:2], rel=1e-6)


def test_characteristic_polynomial_and_roots(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(-9, 9, (7, 7))
    matrix = (a @ a.T).tolist()
    found = whitening.characteristic_polynomial(spark, matrix)
    assert found == pytest.approx(np.poly(np.array(matrix, float)), rel=1e-6)
    assert whitening.polynomials_mod([[2, 0], [0, 3]], [101, 103]).tolist() == [[1, 96, 6], [1, 98, 6]]
    bits, roots = whitening.largest_roots([1, -7, 16, -12], 3)  # (x - 2)^2 (x - 3)
    assert [round(r / 2**bits, 12) for r in roots] == [3, 2, 2]


def test_frame_vectors(spark):
    names = ["dx", "dy", "div", "rot", "px", "py", "fit", "coherence", "mag_var", "sharpness", "brightness", "overexposed"]
    rows = [("v", i, i * 0.2, *[float(i * k % 7) for k in range(1, 13)]) for i in range(20)]
    schema = "video_id string, i bigint, t double, " + ", ".join(f"{n} double" for n in names)
    vectors = whitening.frame_vectors(spark.createDataFrame(rows, schema))
    assert {r.frame_id: r.features for r in vectors.collect()} == {f"v:{r[1]}": list(r[3:]) for r in rows}
    assert whitening.whiten_vectors(vectors).count() == 80


def test_whitening_of_the_given_embeddings(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = queries.embedding_whitening(spark, SF).withColumnRenamed("vec_id", "frame_id")
    assert dict(found.dtypes)["deviation"] == "bigint"
    check_whitening(found.collect(), rows)


# Toxicity


def brute_features(text):
    words = brute.re.findall(r"[^\W_]+", (text or "").lower())
    return {(w,) for w in words} | {("n", *p) for p in zip(words, words[1:], strict=False)} | {
        ("s", *p) for p in zip(words, words[2:], strict=False)
    }


def toxic_case(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(5, 60))
        toxic = rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["Rotten,", "vile***", "(foul)"])
        elif rng.random() < 0.5:
            words[:3] = ["not", "really", "hot"]
        if rng.random() < 0.3 and len(words) > 6:  # only the pair tells
            words[3:5] = ["plain", "wrong"] if toxic else ["wrong", "plain"]
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_features_are_those_of_plain_sets():
    import pyarrow as pa

    texts = [None, "", "a b c a b", "A, b. C", *brute.some_texts(5, 20)]
    of, feature = toxicity._features(pa.array(texts))
    counts = np.bincount(of, minlength=len(texts)).tolist()
    assert counts == [len(brute_features(t)) for t in texts]  # no collision among so few
    assert set(feature[of == 3].tolist()) < set(feature[of == 2].tolist()) | set(feature[of == 3].tolist())
    used = np.zeros(1 << toxicity.BITS, bool)
    used[feature[::3]] = True
    some_of, some = toxicity._features(pa.array(texts), used)
    assert list(zip(some_of, some, strict=True)) == [p for p in zip(of, feature, strict=True) if used[p[1]]]


def test_toxicity_learns_and_ignores_other_columns(spark):
    rows = toxic_case(1, 1500)
    texts = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "clip_id bigint, description string, score string")
    labels = [(i, y, 0.5) for i, _, y in rows if i % 5] + [(None, 1, 0.0), (7, None, 0.0), (99_999, 1, 0.0)]
    labels = spark.createDataFrame(labels + [(11, rows[11][2], 0.1)], "clip_id bigint, toxic int, score double")
    weights = toxicity.fit_weights(texts, labels)
    assert weights.texts == 1200 and 0 < len(weights.features) < 500
    again = toxicity.fit_weights(texts.repartition(7), labels.repartition(5))
    assert np.array_equal(weights.features, again.features) and np.allclose(weights.values, again.values)
    odd = spark.createDataFrame([(None, "vile"), (3, None), (3, ""), (5, "vile " * 100_000)], "clip_id bigint, description string")
    found = toxicity.score_toxicity(texts.select("clip_id", "description").unionByName(odd), weights).collect()
    assert len(found) == 1504 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    truth = {i: y for i, _, y in rows}
    held = [(r.score, truth[r.clip_id]) for r in found if r.clip_id is not None and r.clip_id % 5 == 0]
    right = sum((s >= 0.5) == bool(y) for s, y in held) / len(held)
    assert right > 0.95
    assert toxicity.score_toxicity(texts.limit(0), weights).count() == 0


def test_toxicity_sample_and_learners(spark, monkeypatch):
    rows = toxic_case(2, 900)
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows], "clip_id bigint, description string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "clip_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "LEARNER_TEXTS", 150)
    weights = toxicity.fit_weights(texts, labels, sample_texts=450)
    assert 380 < weights.texts < 520
    none = toxicity.fit_weights(texts, labels.limit(0))
    assert none.texts == 0 and {r.score for r in toxicity.score_toxicity(texts, none).collect()} == {0.5}


def test_toxicity_query_tells_held_out_documents_apart(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = queries.toxicity_scores(spark, sf).collect()
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) for r in found)
    held = [(r.score, labels[r.doc_id]) for r in found if r.held_out and labels.get(r.doc_id) is not None]
    pairs = [(a > b) + (a == b) / 2 for a, y in held if y for b, z in held if not z]
    assert sum(pairs) / len(pairs) > 0.9
