"""The pipeline's stages, one after the other, against what each must do."""

import os

import pytest

pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline as C

    root = f"file://{tmp_path_factory.mktemp('stages')}"
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        out.append(docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_order_and_columns(stages):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["toxicity", "near duplicates", "substring dedup", "decontamination", "BPE"]
    for df in stages[1:5]:
        assert df.columns == stages[0].columns
    for a, b in zip(stages, stages[1:]):
        assert ids(b) <= ids(a)


def test_near_stage_keeps_one_of_each_group(stages):
    from test_search_and_filters import brute_components

    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want, _ = brute_components(rows)
    assert ids(stages[2]) == set(want.values())


def test_repeated_rows_and_null_ids_come_through_once(spark):
    import corpus_pipeline as C

    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    near = text(2).replace("w2x59", "other")
    rows = [(7, text(1)), (7, text(1)), (None, text(2)), (9, near), (8, text(2)), (None, text(3)), (None, text(3)), (5, text(4)), (5, text(5)), (4, ""), (4, None), (None, ""), (None, ""), (3, "")]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(3)
    kept = C.drop_near_copies(spark, df, DATA)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text or "") for r in C.cut_repeated_passages(spark, kept, DATA).collect()), key=str)
    assert got == sorted([(7, text(1)), (8, text(2)), (None, text(3)), (5, text(4)), (5, text(5)), (4, ""), (None, ""), (None, ""), (3, "")], key=str)
    assert C.drop_near_copies(spark, df.where("false"), DATA).count() == 0


def test_passages_are_cut(stages):
    """The words that stay, by brute force; texts from which nothing goes are as they were."""
    from test_repeats import brute_words

    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = {d[0]: (b[1], d[1], b[2]) for d, b in zip(rows, brute_words(rows, 35))}
    got = {r.doc_id: (r.text, r.n_chars) for r in stages[3].collect()}
    assert set(got) == set(want) and any(n for n, _, _ in want.values())
    for k, (n, text, words) in want.items():
        assert got[k][0] == text if not n else b" ".join(got[k][0].encode().split()).decode() == words
    assert all(n == len(t) for t, n in got.values() if t)


def test_contaminated_documents_go_and_ids_decode(spark, stages):
    import hashlib

    from gridloom.llm.decontaminate import find_overlaps

    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert find_overlaps(stages[4], bench).count() == 0
    assert ids(stages[3]) - ids(stages[4]) == ids(find_overlaps(stages[3], bench))
    text = {r.doc_id: r.text for r in stages[4].collect()}
    for r in stages[5].collect():
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest()


def test_run_gives_the_same_rows(spark, stages):
    import corpus_pipeline as C

    key = lambda df: sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in df.collect())
    assert key(C.run(spark, DATA)) == key(stages[5])


def test_nulls_empties_repeats_and_clashing_columns(spark, tmp_path):
    """All five stages over rows of every odd kind, whose columns have the names of results."""
    import corpus_pipeline as C

    folder = f"file://{tmp_path}"
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rude = lambda k: " ".join(f"v{k}x{j} scumword blargword" for j in range(20))
    bench = " ".join(f"b{j}" for j in range(30))
    rows = [(k, text(k)) for k in range(40)] + [(100 + k, rude(k)) for k in range(40)]
    rows += [(1, text(1)), (None, text(50)), (None, text(50)), (201, ""), (202, None), (None, None), (203, "short"), (204, f"before {bench} after"), (205, " ".join(f"l{j}" for j in range(60_000))), (None, rude(60))]
    extra = "score double, passages string, ids int, decoded_text string, kept boolean, kept_text string, n_words int, spans int, shingles int, block int, n_chars int"
    df = spark.createDataFrame([(*r, "en", "s", 0.5, "p", 1, "d", False, "k", 2, 3, 4, 5, len(r[1] or "")) for r in rows], f"doc_id long, text string, lang string, source string, {extra}")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(100 + k, 1, 1) for k in range(40)] + [(None, None, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = df
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema] and out.columns == docs.columns
        docs = out
    got = C.run(spark, folder).collect()
    known = sorted(r.doc_id for r in got if r.doc_id is not None)
    assert known == [*range(40), 201, 202, 203, 205] and sum(r.doc_id is None for r in got) == 2
    assert {r.doc_id: r.n_tokens for r in got}[201] == 0 and all(r.lang == "en" for r in got)
    df.where("false").write.parquet(f"{folder}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{folder}/none/{name}.parquet")
    assert C.run(spark, f"{folder}/none").count() == 0
