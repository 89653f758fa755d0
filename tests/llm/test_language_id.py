import random

import numpy as np
import pyarrow as pa
import pytest

from readprep.llm import bytetext
from readprep.llm import language_id as L


def sentence(r, lang, n):
    words = {"en": "the and of that with from this have".split(), "de": "der und die nicht über für schön straße".split(), "ru": "и в не на что мир слово".split(), "el": "και το να που είναι λόγος".split()}
    return " ".join(r.choice(words[lang]) + r.choice(["", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    rows = [(i, sentence(r, lang, 30), lang) for i, lang in enumerate(["en", "de", "ru", "el"] * 40)]
    return L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_labels_spans_and_odd_texts(spark, model):
    r = random.Random(2)
    mixed = f"{sentence(r, 'en', 20)} {sentence(r, 'ru', 12)} {sentence(r, 'de', 30)}"
    texts = [sentence(r, "de", 8), sentence(r, "ru", 5), mixed, None, "", "12 -- 34 …", "日本", "ok " * 20_000, sentence(r, "el", 3)]
    df = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string")
    got = {x.doc_id: x for x in L.identify(df, model, spans=True).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 4, 5, 8)] == ["de", "ru", "de", "und", "und", "und", "el"]
    assert got[6].lang_pred in model.languages and got[7].lang_pred in model.languages
    assert [s.lang for s in got[2].spans] == ["en", "ru", "de"]
    assert [(s.from_word, s.to_word) for s in got[2].spans] == [(0, 20), (20, 32), (32, 62)]
    assert all(0 <= x.score <= 1 for x in got.values()) and got[3].score == 0 and got[3].spans == []


def test_scripts_narrow_candidates(model):
    x = L.letters(*bytetext.string_buffers(pa.array(["слово λόγος word"])))
    assert [L.NAMES[s] for s in x.script] == ["Cyrillic", "Greek", "Latin"]
    allowed = [[lang for lang, ok in zip(model.languages, model.candidates[s], strict=True) if ok] for s in x.script]
    assert allowed == [["ru"], ["el"], ["de", "en"]]


def test_viterbi_matches_brute_force():
    rng = np.random.default_rng(5)
    lengths = [0, 1, 4, 6, 2]
    first = np.concatenate([[0], np.cumsum(lengths)])
    score, prior = rng.normal(0, 4, (first[-1], 3)), rng.normal(0, 1, 3)
    label = L.viterbi(score, first, prior, 2.5)
    for a, b in zip(first[:-1], first[1:], strict=True):
        best = None
        for code in range(3 ** (b - a)):
            path = [code // 3**i % 3 for i in range(b - a)]
            value = sum(score[a + i, s] for i, s in enumerate(path)) + (prior[path[0]] if path else 0) - 2.5 * sum(x != y for x, y in zip(path, path[1:], strict=False))
            if best is None or value > best[0]:
                best = (value, path)
        assert label[a:b].tolist() == best[1]


def test_held_out_accuracy_and_folds(spark):
    r = random.Random(7)
    rows = [(i, sentence(r, lang, r.randrange(3, 40)), lang) for i, lang in enumerate(["en", "de", "ru"] * 60)] + [(None, "the and of", None), (3, "the and", "en"), (3, "the and", "en")]
    got = L.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    want = {d: lang for d, _, lang in rows}
    held = [x for x in got if x.held_out and x.doc_id is not None]
    assert held and np.mean([x.lang_pred == want[x.doc_id] for x in held]) >= 0.95


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [x.lang_pred for x in L.languages(df).collect()] == ["und"]
    assert L.languages(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_every_language_is_learned(spark):
    rows = [(i * 3 + j, f"{'abcdefghijkl'[i % 12]}{'qxyz'[i // 12 % 4]}{'mnop'[i // 48 % 4]}o " * 12, f"l{i:03d}") for i in range(150) for j in range(3)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 150
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {d: lang for d, _, lang in rows}


def test_a_rare_language_is_learned_beside_a_large_one(spark):
    r = random.Random(3)
    rows = [(i, sentence(r, "en", 6), "en") for i in range(400)] + [(1000, sentence(r, "ru", 20), "ru")]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=40)
    assert model.languages == ["en", "ru"]


def test_pieces_of_a_long_text_give_the_same_labels(model):
    r = random.Random(9)
    text = " ".join(sentence(r, lang, r.randrange(5, 40)) for lang in r.choices(["en", "de", "ru", "el"], k=60))
    column = pa.array([text])
    whole, _, sizes = L._words_of(column, model, L.SWITCH, 1 << 20)
    cut, first, cut_sizes = L._words_of(column, model, L.SWITCH, 300)
    assert whole.tolist() == cut.tolist() and sizes.tolist() == cut_sizes.tolist() and first.tolist() == [0, len(whole)]
    run = np.frombuffer(("日" * 50_000).encode(), np.uint8)
    assert [b for _, b in L.text_pieces(run, 1000)][-1] == len(run) and all(a % 3 == 0 for a, _ in L.text_pieces(run, 1000))


def test_signs_beyond_ascii_are_no_words():
    x = L.letters(*bytetext.string_buffers(pa.array(["“the — 😀 end”", "हिन्दी"])))
    assert np.diff(x.first).tolist() == [2, 1]


def test_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(1, "the and of", "en", 5.0), (1, "12", "en", 6.0), (None, None, None, None)], "doc_id long, text string, lang string, LANG_PRED double")
    none = L.Model([], np.zeros((L.BUCKETS, 0), np.float32), np.zeros((L.OTHER + 1, 0), bool), np.zeros(0))
    for model in (L.fit(df), none):
        got = L.keep_identified(df, model)
        assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, "the and of", "en", 5.0)]
