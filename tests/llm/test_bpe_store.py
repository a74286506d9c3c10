"""Encoding, lexicon and store against the library and brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from gridloom.llm import bpe  # noqa: E402
from gridloom.llm import token_store as ts  # noqa: E402
from gridloom.llm.lexicon import Lexicon, compile_words  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def texts(n, seed=1):
    rnd = random.Random(seed)
    parts = list("ab cd  \n\n\t.,'s!?09éß—中　\x1c\x85\u0558") + ["the ", " hello", "'ll", "<|endoftext|>", " <|endoftext|>", "  ", "\n ", "aaaaaaaa"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(n)] + ["", " ", "a ", " a", "\n \n", "x" * 5000 + "é" * 300, "   lead", "trail   "]


def test_encoder_equals_library(library):
    encoder = bpe.Encoder(PATH, None)
    batch = texts(3000)
    ids, bounds = encoder.encode(pa.array([*batch, None]).slice(0))
    got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert got.pop() == []
    assert encoder.encode(pa.array([], pa.string()))[1].tolist() == [0]
    want = [library.encode(t, add_special_tokens=False).ids for t in batch]
    assert got == want
    decoded = encoder.decode(ids, bounds)
    assert decoded.pop() == ""
    assert decoded == [library.decode(x, skip_special_tokens=False) for x in want]


def test_rare_words_are_merged_side_by_side(library, monkeypatch):
    """Equal to the library's, and a word of ordinary length isn't merged on its own where many are learnt."""
    rnd = random.Random(7)
    letters = list("aeinrstTé09.,'-\n\t\x85")
    words = [" " + rnd.choice("abcxyz(7ß") + "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(6000)]
    odd = [" ", "x", " \nb", " a b", " a<|endoftext|>b", " 日本", " " + "z" * 400, " a\n", " 's"]
    vocabulary, alone = bpe.Vocabulary(PATH), []
    merge = bpe.Vocabulary.merge
    monkeypatch.setattr(bpe.Vocabulary, "merge", lambda self, token: alone.append(token) or merge(self, token))
    got = vocabulary.encode_words([*words, *odd])
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == [library.encode(w, add_special_tokens=False).ids for w in [*words, *odd]]
    assert len(alone) < 300
    assert vocabulary.encode_words([]) == [] and vocabulary.encode_words(["x"]) == [np.array(vocabulary.encode_word("x"), "<i4").tobytes()]


def test_generations_bound_the_cache():
    learnt = []
    cache = bpe.WordCache(lambda words: learnt.extend(words) or [w.encode() for w in words], size=3)
    for _ in range(3):
        assert cache.ids_of(["a", "b", "c"]) == [b" a", b" b", b" c"]
    assert learnt == [" a", " b", " c"]
    for k in range(20):
        assert cache.ids_of([f"w{k}", "y" * 100]) == [b" w%d" % k, b" " + b"y" * 100]
    assert len(cache.young) + len(cache.old) <= 8 and "y" * 100 not in cache.young


def test_workers_forget_words_after_a_task(spark, library):
    """What a worker has met isn't held while it works on later stages; within a task it is bounded."""
    rnd = random.Random(5)
    batch = [" ".join(f"{rnd.getrandbits(40):x}" for _ in range(3000)) for _ in range(4)]
    coded = bpe.encode_decode(spark.createDataFrame([(t,) for t in batch], "text string").coalesce(1), PATH)
    assert [r.ids for r in coded.collect()] == [library.encode(t, add_special_tokens=False).ids for t in batch]

    def held(batches):
        for _ in batches:
            pass
        made = bpe.Encoder._made.values()
        yield pa.RecordBatch.from_pydict({"made": [len(made)], "words": [sum(len(e.words.young) + len(e.words.old) + len(e.vocabulary.known) for e in made)]})

    rows = spark.range(8).repartition(8).mapInArrow(held, "made long, words long").collect()
    assert max(r.made for r in rows) == 1 and max(r.words for r in rows) == 0
    assert bpe.Encoder(PATH, None).words.size == bpe.ENCODER_WORDS


def test_store_encoder_equals_library(library):
    """Over several slices, with words that come again, beside one another and alone."""
    encoder = ts.LibraryEncoder(PATH)
    encoder.table.size = 200
    batch = [*texts(2500, 4), None, *texts(500, 4), "an é ü  日本 word\u00a0", "one two one two " * 400]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in batch]
    for k in range(0, len(batch), 700):
        ids, bounds = encoder.encode(pa.array(batch[k : k + 700], pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want[k : k + 700]
        assert len(encoder.table.young.words) <= 200
    assert encoder.encode(pa.array([], pa.string()))[1].tolist() == [0]
    assert encoder.encode(pa.array(["", None], pa.large_string()))[1].tolist() == [0, 0, 0]


def test_word_table_keeps_what_is_met_again():
    asked = []

    def ask(words):
        asked.extend(words.to_pylist())
        sizes = [len(w) for w in words.to_pylist()]
        return ts.Coded(words, np.repeat(np.arange(len(words)), sizes).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))

    table = ts.WordTable(size=3)
    for _ in range(3):
        got = table.ids_of(pa.array(["a", "bb", ""]), ask)
        assert got.words.to_pylist() == ["a", "bb", ""] and np.diff(got.bounds).tolist() == [1, 2, 0]
    assert asked == ["a", "bb", ""]
    for k in range(20):
        got = table.ids_of(pa.array([f"w{k}", "bb", "y" * 100]), ask)
        assert got.words.to_pylist() == [f"w{k}", "bb", "y" * 100] and np.diff(got.bounds).tolist() == [len(f"w{k}"), 2, 100]
    assert asked.count("bb") == 1 and asked.count("y" * 100) == 20 and len(table.young.words) + len(table.old.words) <= 8


def test_lexicon_is_minimal_and_exact():
    rnd = random.Random(2)
    words = sorted({bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 6))) for _ in range(300)})
    lexicon = Lexicon.mapped(compile_words([(w, [i, i + 1]) for i, w in enumerate(words)]))
    assert lexicon.ranks(words).tolist() == list(range(len(words)))
    assert [lexicon.ids_of(i) for i in range(3)] == [[0, 1], [1, 2], [2, 3]]
    assert lexicon.ranks([b"zzz", b"", b"abcabcabc"]).tolist() == [-1, -1, -1]
    # minimal: as many states as there are different sets of endings
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert len(lexicon.final) == len(endings)
    assert len(Lexicon(compile_words([]))) == 0


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 59, t) for i, t in enumerate(texts(50, 3))] + [(100, None), (101, "word " * 3000), (102, "word " * 3000), (102, "word " * 3000), (None, "no id")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_query_shape(spark, docs, library):
    rows, df = docs
    lexicon = bpe.build_lexicon(df, PATH)
    out = bpe.encode_decode(df.withColumnRenamed("doc_id", "ids"), PATH, lexicon).select("ids", "decoded_text").collect()
    want = sorted(library.encode(t or "", add_special_tokens=False).ids for _, t in rows)
    assert sorted(list(r.ids) for r in out) == want
    assert sorted(r.decoded_text for r in out) == sorted(library.decode(x, skip_special_tokens=False) for x in want)
    assert bpe.encode_decode(df.where("false"), PATH, b"").count() == 0


def test_chunks_follow_content():
    rnd = np.random.default_rng(5)
    a, b = rnd.integers(0, 50000, 6000, dtype=np.uint32), rnd.integers(0, 50000, 37, dtype=np.uint32)
    names = lambda ids: {ts.name_of(x.tobytes()) for x in np.split(ids, ts.chunk_ends(ids, np.array([0, len(ids)]))[:-1])}
    assert len(names(a) & names(np.concatenate([b, a]))) >= len(names(a)) - 2
    ends = ts.chunk_ends(np.zeros(3 * ts.LONGEST, np.uint32), np.array([0, 3 * ts.LONGEST]))
    assert np.diff(np.concatenate([[0], ends])).max() <= ts.LONGEST and ends[-1] == 3 * ts.LONGEST


def test_checksums_add_up():
    rnd = np.random.default_rng(6)
    parts = [rnd.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (5, 0, 1, 4096, 77)]
    size = [len(p) for p in parts]
    tail = np.array([sum(size[i + 1 :]) for i in range(len(size))])
    terms = ts.shifted(np.array([zlib.crc32(p) for p in parts]), tail)
    assert int(np.bitwise_xor.reduce(terms)) == zlib.crc32(b"".join(parts))


def test_store_round_trip(spark, docs, library, tmp_path):
    rows, df = docs
    path = f"file://{tmp_path}/store"
    ts.write_store(df, path, PATH)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.start, r.n_tokens, r.crc) for r in ts.document_sums(spark, path).collect())
    want, start = [], 0
    coded = [((i if i is not None else -1), library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows]
    for i, ids in sorted(coded, key=lambda x: (x[0], 0)):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(want) == got
    # equal documents are stored once
    stored = sum(r.n for r in ts.read_chunks(spark, path).collect())
    assert stored < start - 5000
    with pytest.raises(ValueError):
        list(ts.unpack(b"TIDX" + bytes(8)))
    import pathlib

    manifest = next(pathlib.Path(f"{tmp_path}/store/manifest").glob("part-*.parquet"))
    import pyarrow.parquet as pq

    t = pq.read_table(manifest)
    pq.write_table(t.set_column(t.schema.get_field_index("leaf"), "leaf", pa.array(["0" * 64] * t.num_rows)), manifest)
    for crc in manifest.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="root|manifest"):
        ts.read_recipes(spark, path)


def test_empty_store(spark, tmp_path):
    path = f"file://{tmp_path}/empty"
    ts.write_store(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert ts.document_sums(spark, path).count() == 0


def test_documents_are_put_together_again(spark, docs, library, tmp_path):
    rows, df = docs
    path = f"file://{tmp_path}/again"
    ts.write_store(df.selectExpr("doc_id", "text", "1 as n_tokens", "'x' as names", "2 as kind"), path, PATH)
    got = sorted((r.doc_id if r.doc_id is not None else -1, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in ts.read_documents(spark, path).collect())
    assert got == sorted((i if i is not None else -1, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows)
    # a store whose chunks are gone says so
    import pathlib
    import shutil

    shutil.rmtree(next(pathlib.Path(f"{tmp_path}/again/content").glob("kind=0")))
    with pytest.raises(Exception, match="isn't there"):
        ts.document_sums(spark, path).collect()


def test_long_texts_null_ids_and_clashing_columns(spark, library, tmp_path):
    long = "word and another one, " * 20_000
    df = spark.createDataFrame([(None, long, [1], "d"), (1, long, [2], "d"), (1, long, None, None)], "doc_id long, text string, ids array<int>, decoded_text string")
    want = library.encode(long, add_special_tokens=False).ids
    out = bpe.encode_decode(df, PATH, bpe.build_lexicon(df, PATH)).collect()
    assert len(out) == 3 and all(list(r.ids) == want and r.decoded_text == long for r in out)
    path = f"file://{tmp_path}/long"
    ts.write_store(df, path, PATH)
    sums = sorted(((r.doc_id or 0), r.start, r.n_tokens, r.crc) for r in ts.document_sums(spark, path).collect())
    n, crc = len(want) + 1, zlib.crc32(np.array([*want, 0], "<u4").tobytes())
    assert sums == [(0, 0, n, crc), (1, n, n, crc), (1, 2 * n, n, crc)]
