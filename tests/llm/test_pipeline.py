import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from readprep.llm.sentencepiece import decode_ids  # noqa: E402


def write(spark, rows, folder):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")


def test_stages_take_effect(spark, tmp_path):
    base = [f"word{i}" for i in range(120)]
    near = base[:]
    near[5] = "changed"
    rows = [(1, " ".join(base), "en", "a"), (2, " ".join(base).upper(), "en", "b"), (3, " ".join(near), "en", "c"), (4, "12 34 --", "en", "a"), (5, None, None, None), (6, "plain other text", "en", "b")]
    rows += [(10 + i, f"quite different text number {i} with words like alpha{i} beta{i * 7} gamma{i * 3} for the mix", "en" if i % 2 else "de", "abc"[i % 3]) for i in range(60)]
    write(spark, [(*r, len(r[1] or "")) for r in rows], tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = sorted(r.doc_id for r in docs.collect())
    every = {r[0] for r in rows}
    assert set(seen["language_id"]) == every - {4, 5}
    assert set(seen["exact_dedup"]) == every - {4, 5, 2}
    assert set(seen["near_dedup"]) == every - {4, 5, 2, 3}
    assert set(seen["mixing"]) <= set(seen["near_dedup"])
    assert all(seen["mixing"].count(i) <= 3 for i in every)
    out = corpus_pipeline.run(spark, str(tmp_path))
    texts = {r[0]: r[1] for r in rows}
    back = decode_ids(out).collect()
    assert sorted(r.doc_id for r in back) == seen["mixing"]
    assert all(r.text == texts[r.doc_id] for r in back)


def test_nulls_repeats_and_empty_table(spark, tmp_path):
    write(spark, [(None, "some text here", None, None, None), (1, "some other words", "en", "a", 3), (1, "some other words", "en", "a", 3), (2, "", "en", "a", 0)], tmp_path / "x")
    got = corpus_pipeline.run(spark, str(tmp_path / "x")).collect()
    assert {r.doc_id for r in got} <= {None, 1}
    write(spark, [], tmp_path / "empty")
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_stages_with_clashing_columns_repeated_ids_and_long_texts(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words), "en", "a"), (1, "quite another text that only shares its id with the first one", "en", None), (2, " ".join([*words, "more"]), "en", "a"), (None, "a text of no id at all", None, "b"), (3, "long words " * 60_000, "en", "b"), (4, "…—", "en", "a")]
    df = spark.createDataFrame([(*r, 0, "k", 1, "x", True, 2.0, 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, __key string, n int, lang_pred string, kept boolean, score double, copies int")
    want = {"language_id": {0, 1, 2, 3, 4}, "exact_dedup": {0, 1, 2, 3, 4}}
    texts = [r[1] for r in rows]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        if name == "sentencepiece":
            assert out.count() == df.count()
            break
        assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        got = {texts.index(r.text) for r in df.collect()}
        if name in want:
            assert got == want[name]
        elif name == "near_dedup":  # of the near copies, rows 0 and 2, one stays
            assert got in ({0, 1, 3, 4}, {1, 2, 3, 4})
        assert all(r.n == 1 and r.copies == 5 and r.lang_pred == "x" for r in df.collect())
