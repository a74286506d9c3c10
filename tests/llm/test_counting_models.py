"""The backoff automaton, centroids and importance resampling against brute force."""

import hashlib
import math
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import backoff_lm as B
from gridloom.llm import centroids as C
from gridloom.llm import resampling as R
from gridloom.llm.packed import binaries, pack, raw, unpack


def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def test_packed_numbers():
    for values in ([], [0], [254, 255], [256, 1, 255], [1 << 40, 3], [(1 << 62) + 1]):
        assert unpack(pack(np.array(values, np.int64))).tolist() == values
    data, bounds = raw(binaries(np.arange(6, dtype=np.uint8), np.array([0, 2, 2, 6])))
    assert data.tolist() == [0, 1, 2, 3, 4, 5] and bounds.tolist() == [0, 2, 2, 6]


# -- language model ---------------------------------------------------------------
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def brute_scores(rows, order):
    """By dictionaries of tuples and the recursive definition."""
    texts = [(i, [" s", *WORD.findall((t or "").translate(LOWER)), " e"]) for i, t in rows]
    count = Counter()
    for i, w in texts:
        if not held(i):
            for k in range(1, order + 1):
                count.update(tuple(w[j - k + 1 : j + 1]) for j in range(k - 1, len(w)))
    words = {g: n for g, n in count.items() if len(g) == 1 and g != (" s",)}
    total = sum(words.values())
    of = lambda n: n.bit_length()
    single, places = Counter(), Counter()
    for g, n in count.items():
        if len(g) > 1:
            key = len(g), of(count[g[:-1]])
            single[key] += n == 1
            places[key] += n
    rate = lambda k, n: (single[k, of(n)] + 0.5) / (places[k, of(n)] + 1)

    def p(h, w):
        if not h:
            return (words.get((w,), 0) + 0.5) / (total + 0.5 * (len(words) + 1))
        n = count[h]
        if not n:
            return p(h[1:], w)
        r = rate(len(h) + 1, n)
        return (1 - r) * count[(*h, w)] / n + r * p(h[1:], w)

    out = []
    for i, w in texts:
        real = range(1, len(w))
        base = sum(math.log10(p((), w[j])) for j in real)
        score = sum(math.log10(p(tuple(w[max(0, j - order + 1) : j]), w[j])) for j in real)
        out.append((i, held(i), len(real), sum((w[j],) in words for j in real), total, base, score))
    return out, p, words, count


def lm_rows(seed=5, n=160):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Straße", "ÄB", "x y", "q" * 300]
    rows = [(i, " ".join(rnd.choice(words[: rnd.randint(3, 44)]) for _ in range(rnd.randint(0, 60)))) for i in range(n)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (None, "w1 w2 w3"), (1003, "W1 w2"), (1003, "W1 w2"), (1004, "new words only here"), (1006, "w1 w2 " * 700), (1007, "w3\n" * 900)]
    return rows


def close(got, want):
    key = lambda r: tuple(str(x) for x in r[:5]) + (round(r[5], 4), round(r[6], 4))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("order,block,lane", [(1, 1 << 20, 256), (2, 1 << 20, 256), (2, 300, 7), (3, 500, 16)])
def test_scores_equal_the_recursive_definition(spark, tmp_path, monkeypatch, order, block, lane):
    monkeypatch.setattr(B.Automaton.walk, "__defaults__", (lane,))
    rows = lm_rows()
    want = brute_scores(rows, order)[0]
    df = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, block string, size int").repartition(5 if block < 1000 else 2)
    close([tuple(r) for r in B.score_texts(df, folder(tmp_path), order=order).collect()], want)


def test_probabilities_after_a_history_sum_to_one(spark, tmp_path):
    """Of every word that was learnt and one that wasn't, after several histories: by scores of texts that differ in it."""
    rows = lm_rows(seed=6, n=60)
    _, p, words, _ = brute_scores(rows, 2)
    for h in ((), ("w1",), (" s",), ("new",), ("nowhere",)):
        assert abs(sum(p(h, w) for (w,) in words) + p(h, "unseen!") - 1) < 1e-9
    first = [w for (w,) in sorted(words) if w != " e" and w != "q" * 300]
    asked = [(5 * 10**6 + k, w) for k, w in enumerate([*first, "unseen!"])]
    asked = [(next(i * 10 for i in range(k, k + 10**6) if held(i * 10)) if not held(k) else k, w) for k, w in asked]
    got = {r.doc_id: r.score for r in B.score_texts(spark.createDataFrame([*rows, *asked], "doc_id long, text string"), folder(tmp_path)).collect()}
    for k, w in asked:
        if sum(k == x for x, _ in asked) == 1:
            assert abs(got[k] - math.log10(p((" s",), w)) - math.log10(p((w,), " e"))) < 1e-9


def test_model_edges(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert B.score_texts(empty, folder(tmp_path)).count() == 0
    out = i = next(i for i in range(100) if held(i))
    out = B.score_texts(spark.createDataFrame([(i, "a b")], "doc_id long, text string"), folder(tmp_path)).first()
    assert tuple(out) == (i, True, 3, 0, 0, 0.0, 0.0)


def test_lanes_end_in_the_same_state():
    """A long text walked in one lane and in many."""
    rng = np.random.default_rng(1)
    tokens = np.concatenate([[0], 2 + rng.integers(0, 30, 5000), [1]])
    vocabulary = np.sort(B.mix(np.arange(40, dtype=np.uint64)) & ~B.TAG)
    g = B.Grams(np.array([len(tokens)]), np.array([True]), vocabulary, tokens, 3)
    rates = np.full((5, B.CLASSES), 0.3)
    automaton = B.Automaton(g, g.own, 5001, 31, rates)
    whole = automaton.walk(tokens, np.array([0]), np.array([len(tokens)]), 10**6)
    for lane in (1, 2, 3, 100):
        assert np.allclose(automaton.walk(tokens, np.array([0]), np.array([len(tokens)]), lane), whole)


# -- centroids --------------------------------------------------------------------
def brute_clusters(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]

    def packed_bytes(v):
        for width in (2, 4, 8):
            if all(-(1 << 8 * width - 1) <= x < 1 << 8 * width - 1 for x in v):
                return bytes([width]) + b"".join(x.to_bytes(width, "little", signed=True) for x in v)
        return b"\0" + ",".join(map(str, v)).encode()

    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), packed_bytes(r[1])))
    cents = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        new = []
        for j, c in enumerate(cents):
            mine = [v for (_, v), a in zip(kept, of) if a == j]
            new.append([sum(x) // len(mine) for x in zip(*mine)] if mine else c)
        cents = new
    last = [near(v) for _, v in kept]
    inertia = Counter()
    for d, j in last:
        inertia[j] += d
    fits = lambda x: x if x < 1 << 63 else None
    return [(i, j, fits(d), fits(inertia[j]), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last)]


def vectors(scale, n=300, seed=2, dims=64):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=dims) * scale + (i % 3) * scale)]) for i in range(n)]
    hot = rows[7][1]
    rows += [(1000 + i, hot) for i in range(n // 2)]  # a third of all rows
    rows += [(2000, None), (2001, [1.0] * 63), (2002, [float("nan")] * 64), (2003, [None] + [0.0] * 63), (2004, [float("inf")] * 64), (None, rows[3][1]), (5, rows[9][1]), (5, rows[9][1]), (2005, [0.0] * 64), (2006, [-0.0] * 64)]
    return rows


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e9, 1e30])
def test_clusters_equal_brute_force(spark, tmp_path, scale):
    rows = vectors(scale, 300 if scale < 1e6 else 60)
    df = spark.createDataFrame([(v, i, 1, "c") for i, v in rows], "embedding array<float>, vec_id long, n int, cluster string").repartition(3)
    got = [tuple(r) for r in C.cluster_vectors(df, folder(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(brute_clusters(rows), key=str)


def test_few_or_no_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 64), (3, [2.0] * 64)], "vec_id long, embedding array<float>")
    got = C.cluster_vectors(df, folder(tmp_path)).collect()
    assert sorted(r.vec_id for r in got) == [1, 2, 3] and {r.inertia for r in got} == {0}
    assert C.cluster_vectors(df.where("false"), folder(tmp_path)).count() == 0


def test_limbs_are_exact():
    for x in (0, 1, -1, (1 << 40) - 1, 1 << 40, -(1 << 40), 12345678901234567890123, -12345678901234567890123, 1 << 200):
        assert sum(v << 40 * p for p, v in C.limbs(x)) == x and all(abs(v) <= 1 << 40 for _, v in C.limbs(x))


def test_distances_on_both_sides_of_exact_doubles():
    for top in (1000, 1 << 22, 1 << 40):
        rng = np.random.default_rng(top % 97)
        points = rng.integers(-top, top, (20, 5))
        cents = [[int(x) for x in rng.integers(-top, top, 5)] for _ in range(4)]
        best, distance = C.nearest(points, cents)
        want = [min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(cents)) for p in points.tolist()]
        assert [(int(d), int(j)) for d, j in zip(distance, best)] == want


# -- resampling -------------------------------------------------------------------
FEATURE = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_draw(rows, target, buckets=10_000, runs=1, least=20, percent=10):
    def features(t):
        w = FEATURE.findall((t or "").translate(LOWER))
        return len(w), [" ".join(w[j : j + k]) for k in range(1, runs + 1) for j in range(len(w) - k + 1)]

    of = lambda f: zlib.crc32(f.encode()) % buckets
    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(of(f) for _, _, fs in docs for f in fs), Counter(of(f) for x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, n, fs in docs:
        w = sum(gain(of(f)) for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return [tuple(r) for r in out]


@pytest.mark.parametrize("buckets,runs,percent", [(10_000, 1, 10), (64, 1, 50), (65_536, 3, 100)])
def test_draw_equals_brute_force(spark, tmp_path, buckets, runs, percent):
    rnd = random.Random(8)
    words = [f"Wort{i}" for i in range(300)] + ["naïve", "日本", "z" * 100, "a1B2"]
    rows = [(i, rnd.choice([" ", ", ", "\n--"]).join(rnd.choice(words) for _ in range(rnd.randint(0, 80)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "..."), (None, " ".join(words[:30])), (903, " ".join(words) * 60), (904, "x" * 5000)]
    target = [" ".join(words[:40]), None, "", "Wort7 Wort8"]
    df = spark.createDataFrame([(t, i, "c", 2) for i, t in rows], "text string, doc_id long, rank string, place int").repartition(4)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = [tuple(r) for r in R.resample(df, wanted, folder(tmp_path), buckets=buckets, runs=runs, percent=percent).collect()]
    assert sorted(got, key=str) == sorted(brute_draw(rows, target, buckets, runs, percent=percent), key=str)


def test_repeated_rows_and_empty_tables_are_drawn_as_defined(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c " * 9)] * 40 + [(None, "a b c " * 9)] * 3, "doc_id long, text string").repartition(3)
    none = spark.createDataFrame([], "text string")
    got = R.resample(df, none, folder(tmp_path), percent=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 44))
    assert R.resample(df.where("false"), none, folder(tmp_path)).count() == 0
    with pytest.raises(ValueError, match="16 bits"):
        R.resample(df, none, folder(tmp_path), buckets=1 << 17)


def test_crc_of_many_ranges():
    body = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    rng = np.random.default_rng(4)
    start = rng.integers(0, 700, 200)
    end = np.minimum(start + rng.integers(0, 120, 200), 768)
    assert R.crc32s(body, start, end).tolist() == [zlib.crc32(body[a:b]) for a, b in zip(start, end)]
    words, features, stream = R.bucket_stream(pa.array([None, "", "a b"]), 100, 2)
    assert words.tolist() == [0, 0, 2] and features.tolist() == [0, 0, 3]
    assert stream.tolist() == [zlib.crc32(x) % 100 for x in (b"a", b"b", b"a b")]
