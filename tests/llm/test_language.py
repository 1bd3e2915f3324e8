"""Language identification: paths against a plain Viterbi, spans of mixed texts, held-out accuracy, odd rows."""

from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import language as L


def plain_path(scores, switch):
    best, back = scores[0].copy(), []
    for s in scores[1:]:
        top = int(best.argmax())
        moves = [i if best[i] >= best[top] - switch else top for i in range(len(s))]
        back.append(moves)
        best = np.array([best[m] - (switch if m != i else 0) for i, m in enumerate(moves)]) + s
    state = int(best.argmax())
    out = [state]
    for moves in reversed(back):
        state = moves[state]
        out.append(state)
    return out[::-1], float(best.max())


def worth(scores, states, switch):
    return sum(s[i] for s, i in zip(scores, states)) - switch * sum(a != b for a, b in zip(states, states[1:]))


def test_path_as_plain_viterbi():
    rng = np.random.default_rng(4)
    count = np.array([1, 40, 0, 7, 300, 2, 40])
    first = np.cumsum(count) - count
    scores = rng.normal(size=(count.sum(), 5)) * 4
    got = L.path(scores, first, count, 6.0)
    for a, n in zip(first, count):
        if n:
            want, value = plain_path(scores[a : a + n], 6.0)
            assert worth(scores[a : a + n], got[a : a + n], 6.0) == pytest.approx(value)
            assert got[a : a + n].tolist() == want
    assert L.path(np.zeros((0, 3)), np.zeros(2, int), np.zeros(2, int)).tolist() == []


def test_words_are_runs_of_letters_of_one_script():
    w = L.Words(["L'état, été 2x", "", "слово日本ご", "\u0301 9"])
    found = [(int(t), int(a), int(b), L.NAMES[s], int(n)) for t, a, b, s, n in zip(w.text, w.start, w.end, w.script, w.letters)]
    assert found == [
        (0, 0, 1, "latin", 1), (0, 2, 6, "latin", 4), (0, 8, 13, "latin", 3), (0, 15, 16, "latin", 1),
        (2, 0, 5, "cyrillic", 5), (2, 5, 7, "han", 2), (2, 7, 8, "kana", 1),
    ]
    assert L.Words([]).text.tolist() == []


EN = "the cat and the dog went to the house with their friends and they were talking about the weather"
DE = "die Katze und der Hund gingen mit ihren Freunden zum Haus und sprachen dort über das Wetter"
RU = "кошка и собака пошли в дом со своими друзьями и говорили там о погоде"
UK = "кішка і собака пішли до хати зі своїми друзями і розмовляли там про погоду"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t, lang) for _ in range(40) for t, lang in ((EN, "en"), (DE, "de"), (RU, "ru"), (UK, "uk"))]
    rows = [(i, *r) for i, r in enumerate(rows)] + [(-1, None, "xx"), (None, EN, "yy"), (-2, EN, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return L.train(docs, docs_a_language=30)


def test_model_learns_known_labels_only(model):
    assert model["languages"] == ["de", "en", "ru", "uk"]
    assert model["scripts"][L.NAMES.index("latin")].tolist() == [True, True, False, False]
    assert model["scripts"][L.NAMES.index("cyrillic")].tolist() == [False, False, True, True]
    assert model["scripts"][L.NAMES.index("han")].all()


def test_spans_of_mixed_texts(model):
    text = f"{EN}. {DE}; {UK}!"
    spans = L.label_spans([text, "1 + 2", RU], model)
    assert [(text[a:b], lang) for a, b, lang, _ in spans[0]] == [(EN, "en"), (DE, "de"), (UK, "uk")]
    assert spans[1] == [] and [s[2] for s in spans[2]] == ["ru"]
    # one foreign word isn't worth two changes, unless its script leaves no choice
    assert [s[2] for s in L.label_spans([f"{EN} und {EN}"], model)[0]] == ["en"]
    assert [s[2] for s in L.label_spans([f"{EN} дом {EN}"], model)[0]] in (["en", "ru", "en"], ["en", "uk", "en"])


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (None, DE), (3, "123 ..."), (4, EN), (4, EN), (5, f"{EN} " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("a clashing name"), "lang": F.lit("de")})
    got = sorted((tuple(r)[:4] for r in L.identify(df, model).collect()), key=repr)
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in got}
    assert by_id[1][2:] == by_id[2][2:] == by_id[3][2:] == ("und", 0.0)
    assert by_id[4][2:] == by_id[5][2:] == ("en", 1.0) and by_id[None] == (None, False, "de", 1.0)
    assert all(r[1] == (crc32(str(r[0]).encode()) % 5 == 0) for r in got if r[0] is not None)
    empty = df.limit(0)
    assert L.identify(empty, model).collect() == []
    nothing = L.train(empty)
    assert [tuple(r)[2:4] for r in L.identify(df.filter("doc_id = 4"), nothing).collect()] == [("und", 0.0)] * 2


def test_held_out_accuracy(spark):
    from tidewater.llm.registry import queries

    sf_dir = "/root/testdata/sf0.01"
    want = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries()["op12_language_id"](spark, sf_dir).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(want) and len(held) > 100
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert sum(want[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)
