"""Repeated passages and strings against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import suffix_dedup as SD
from gridloom.llm.fingerprint_index import FingerprintIndex
from gridloom.llm.repeats import RUN, merged, repeated
from gridloom.llm.substring_dedup import ingest, remove_repeated_passages
from gridloom.llm.suffix_dedup import remove_repeated_strings
from gridloom.llm.textcore import sliding


def corpus(seed, n=60, words=40):
    rnd = random.Random(seed)
    shared = [[rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(30)] for _ in range(3)]
    out = []
    for i in range(n):
        w = [f"w{rnd.randint(0, 50)}" for _ in range(rnd.randint(0, words))]
        if rnd.random() < 0.5:
            k, p = rnd.randint(0, len(w)), rnd.choice(shared)
            a = rnd.randint(0, 10)
            w[k:k] = p[a : a + rnd.randint(5, 20)]
        out.append((i, rnd.choice([" ", "\n", " \t"]).join(w)))
    return out + [(n, None), (n + 1, ""), (n + 2, "a " * 60), (n + 3, out[0][1]), (n + 3, out[0][1]), (None, out[1][1]), (n + 4, "é " * 30 + "日本 " * 20)]


def brute_gone(docs, width, history=()):
    """The places of each document's words that go."""
    words = [(t or "").encode().split() for _, t in docs]
    seen = Counter(tuple(w[k : k + width]) for w in [*words, *[(t or "").encode().split() for _, t in history]] for k in range(len(w) - width + 1))
    return [{j for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for j in range(k, k + width)} for w in words]


def brute_words(docs, width, history=()):
    words = [(t or "").encode().split() for _, t in docs]
    return [(len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()) for w, gone in zip(words, brute_gone(docs, width, history))]


@pytest.mark.parametrize("width,gram", [(5, 3), (8, 4), (8, 8), (35, 16)])
def test_passages(spark, width, gram):
    docs = corpus(width)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeated_passages(df, width=width, gram=gram).collect())
    assert got == Counter((d[0], *b) for d, b in zip(docs, brute_words(docs, width)))


@pytest.mark.parametrize("width,gram", [(7, 4), (20, 12)])
def test_strings(spark, width, gram):
    docs = corpus(100 + width, 40, 20)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    seen = Counter(b[k : k + width] for b in ((t or "").encode() for _, t in docs) for k in range(len(b) - width + 1))
    want = Counter()
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in remove_repeated_strings(df, width=width, gram=gram).collect())
    assert got == want


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, "x"), (2, "z a b c d e", 8, "y")], "doc_id long, text string, n_words int, block string")
    rows = remove_repeated_passages(df, width=5, gram=2).orderBy("doc_id").collect()
    assert [(r.kept_text, r.block, r.n_words) for r in rows] == [("f", "x", 6), ("z", "y", 6)]
    assert remove_repeated_passages(df.where("false")).count() == 0
    assert remove_repeated_strings(df.where("false")).count() == 0


def test_suffix_order_is_right():
    rnd = random.Random(4)
    body = "".join(rnd.choice("ab") for _ in range(120)) * 3 + "".join(rnd.choice("abc") for _ in range(200))
    import pyarrow as pa

    from gridloom.llm.suffix_dedup import ByteWindows, byte_symbols, suffix_run

    w = ByteWindows("text", 40, 20, byte_symbols, suffix_run, repeated)
    s = w.state(pa.table({"text": [body]}))
    at = np.arange(len(body) - 40 + 1)
    order, same = SD.suffix_order(s, at, 40)
    keys = [body[k : k + 40] for k in order]
    assert keys == sorted(keys)
    assert same.tolist() == [False, *[a == b for a, b in zip(keys, keys[1:])]]
    for x, y in [(0, 120), (3, 7), (0, 240)]:
        n = next((i for i in range(40) if body[x + i] != body[y + i]), 40)
        assert SD.common_extension(s["hash"], np.array([x]), np.array([y]), 40)[0] == n


def test_sliding_extremes():
    x = np.random.default_rng(0).integers(0, 100, 57)
    for w in (1, 2, 7, 57):
        want = [x[i : i + w].min() for i in range(len(x) - w + 1)]
        assert sliding(np.minimum, x, w, 1000)[: len(want)].tolist() == want


def run_of(*values):
    x = np.zeros(len(values), RUN)
    x["value"] = np.array(sorted(values), np.uint64) << np.uint64(1)
    return x


def test_runs_are_compacted_and_joined():
    runs = [run_of(1, 5, 9), run_of(2, 5), run_of(7), run_of(9, 11)]
    assert [h.tolist() for h in repeated(runs)] == [[False, True, True], [False, True], [False], [True, False]]
    whole = merged(runs)
    assert (whole["value"] >> np.uint64(1)).tolist() == [1, 2, 5, 7, 9, 11]
    assert (whole["value"] & np.uint64(1)).tolist() == [0, 0, 1, 0, 1, 0]


@pytest.mark.parametrize("width,gram", [(8, 4), (35, 16)])
def test_batches_against_their_history(spark, tmp_path, width, gram):
    """Each batch is judged against all before it; runs are compacted and found again by a later session's index."""
    path = f"file://{tmp_path}/index"
    rnd = random.Random(width)
    common = [f"p{rnd.randint(0, 9)}" for _ in range(3 * width)]
    history = []
    for batch in range(5):
        docs = []
        for i in range(25):
            w = [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 2 * width))]
            a = rnd.randint(0, len(common) - 1)
            k = rnd.randint(0, len(w))
            w[k:k] = common[a : a + rnd.randint(0, 2 * width)] if rnd.random() < 0.6 else []
            docs.append((i, " ".join(w)))
        docs += [(100, None), (101, history[3][1] if history else "")]
        index = FingerprintIndex(spark, path, fanout=2)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeated_passages(df, width=width, gram=gram, index=index).collect())
        want = brute_words(docs, width, history)
        assert got == Counter((d[0], *b) for d, b in zip(docs, want))
        ingest(df, index, width=width, gram=gram)
        history += docs
    assert sorted(level for level, _ in index.runs) == [0, 2]
    assert FingerprintIndex(spark, path).runs == sorted(index.runs)
    with pytest.raises(ValueError, match="path"):
        ingest(df, FingerprintIndex(spark), width=width, gram=gram)


def test_strings_at_the_true_width(spark, monkeypatch):
    """400 bytes, over several slices and blocks, a long text and letters of several bytes included."""
    from gridloom.llm import repeats, textcore

    monkeypatch.setattr(repeats, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(textcore.slices, "__defaults__", (1 << 12,))
    rnd = random.Random(9)
    passages = ["".join(rnd.choice("abcdefgh é") for _ in range(900)) for _ in range(4)]
    docs = []
    for i in range(120):
        t = "".join(rnd.choice("abcdefghij ") for _ in range(rnd.randint(0, 700)))
        if i % 3 == 0:
            p, a = rnd.choice(passages), rnd.randint(0, 300)
            t += p[a : a + rnd.randint(300, 600)] + "z" * rnd.randint(0, 3)
        docs.append((i, t))
    docs += [(200, "ab" * 1500), (201, docs[0][1]), (None, docs[3][1]), (202, "é" * 500), (203, "x" * 399), (203, "x" * 399), (204, "".join(rnd.choice("qrst") for _ in range(20_000)) + passages[0])]
    body = [(t or "").encode() for _, t in docs]
    seen = Counter(b[k : k + 400] for b in body for k in range(len(b) - 399))
    want = Counter()
    for (i, _), b in zip(docs, body):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        want[i, int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])] += 1
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_bytes int").repartition(5)
    got = Counter((r.doc_id, r.n_removed, bytes(r.kept)) for r in remove_repeated_strings(df).collect())
    assert got == want and sum(n > 0 for _, n, _ in got) > 20


def test_long_texts_and_equal_rows(spark):
    long = " ".join(f"w{k}" for k in range(150_000))
    df = spark.createDataFrame([(1, long), (2, "a " + long), (None, "x y z " * 20), (None, "x y z " * 20), (3, "q " + " ".join(f"u{k}" for k in range(34)))], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, len(r.kept_text)) for r in remove_repeated_passages(df).collect())
    assert got == [(0, 60, 60, 0), (0, 60, 60, 0), (1, 150_000, 150_000, 0), (2, 150_001, 150_000, 1), (3, 35, 0, 127)]


def test_what_is_kept_keeps_its_layout(spark):
    """Lines, paragraphs, tabs and indentation of kept words stay."""
    passage = " ".join(f"boiler{j}" for j in range(12))
    code = "def f():\n    return 1\n\n\tif x:\n\t\ty\n\n"
    prose = "  A first paragraph.\n\nA second one.  \n"
    rows = [(1, code + passage + "\n\n" + prose), (2, prose.upper() + "\n" + passage.replace(" ", "\n")), (3, passage), (4, "\n a\tb \n"), (5, None), (6, ""), (7, f"x {passage}\n  y"), (8, f"  {passage}  z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.kept_text, r.n_removed) for r in remove_repeated_passages(df, width=6, gram=3, layout=True).collect()}
    assert got == {1: (code + prose, 12), 2: (prose.upper() + "\n", 12), 3: ("", 12), 4: ("\n a\tb \n", 0), 5: ("", 0), 6: ("", 0), 7: ("x \n  y", 12), 8: ("  z", 12)}


def test_words_taken_out_of_a_text():
    from gridloom.llm.substring_dedup import without

    raw = b" a\tb  c\n\n  d e "
    assert without(raw, [(0, 0)]) == b" b  c\n\n  d e " and without(raw, [(1, 2)]) == b" a\t\n\n  d e " and without(raw, [(0, 2)]) == b"  d e "
    assert without(raw, [(4, 4)]) == b" a\tb  c\n\n  d " and without(raw, [(0, 1), (3, 3)]) == b" c\n\n  e " and without(raw, [(3, 4)]) == b" a\tb  c\n\n  " and without(raw, [(0, 4)]) == b" "
    assert without(b"x\n  y\n    z\n", [(1, 1)]) == b"x\n    z\n" and without(b"y\n", [(0, 0)]) == b""
