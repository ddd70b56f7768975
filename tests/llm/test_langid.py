import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm.langid import Model, best_paths, fit, held_out, identify, script_of


def plain_path(s, penalty):
    value, back = s[0].astype(float), []
    for row in s[1:]:
        move = value.max() - penalty
        back.append([k if value[k] >= move else int(value.argmax()) for k in range(len(value))])
        value = np.maximum(value, move) + row
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1], value.max()


def worth(s, path, penalty):
    return sum(s[i, k] for i, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("seed", range(6))
def test_paths_are_best(seed):
    rng = np.random.default_rng(seed)
    texts = []
    for n in rng.integers(1, 60, 25):
        s = rng.normal(0, 2, (n, 3))
        a = rng.integers(0, n)
        s[a : a + rng.integers(0, 20), rng.integers(0, 3)] += 3
        texts.append(s - s.max(axis=1, keepdims=True))
    got = best_paths(np.concatenate(texts), [len(t) for t in texts], 4.0)
    at = 0
    for s in texts:
        mine = got[at : at + len(s)].tolist()
        at += len(s)
        assert abs(worth(s, mine, 4.0) - plain_path(s, 4.0)[1]) < 1e-9


def test_scripts():
    assert [script_of(w) for w in ("abc", "été", "ж", "漢字", "かな", "한글", "שלום")] == ["Latin", "Latin", "Cyrillic", "Han", "Kana", "Hangul", "Hebrew"]


@pytest.fixture(scope="module")
def trained(spark):
    en, de = "the cat and the dog went through that house with thirty others ", "der Hund und die Katze gingen durch das Haus mit dreißig anderen "
    ru = "кошка и собака прошли через этот дом с тридцатью другими "
    rows = [(i, t * 3, lang) for i in range(20) for t, lang in ((en, "en"), (de, "de"), (ru, "ru"))] + [(99, None, "en"), (98, "x", None)]
    return fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")), en, de, ru


def test_spans_of_mixed_text(spark, trained):
    model, en, de, ru = trained
    text = en * 2 + de * 2 + ru
    row = identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, spans=True).first()
    assert [s.lang for s in row.spans] == ["en", "de", "ru"] and row.lang_pred in ("en", "de")
    assert text[row.spans[1].start : row.spans[1].end].startswith("der Hund") and 0 < row.score < 1


def test_odd_rows(spark, trained):
    model = trained[0]
    rows = [(1, None, "a"), (2, "", "a"), (3, "123 -- ! ²", "a"), (4, "the cat", "a"), (4, "the cat", "a"), (5, "the cat went " * 30_000, "a"), (6, "漢字", "a")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == got[5][0] == "en" and got[6][0] in model.langs
    assert identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_more_languages_than_a_byte_counts(spark):
    word = lambda k: "".join(chr(97 + (k // 26**i) % 26) * 2 for i in range(3))
    rows = [(k * 2 + i, " ".join([word(k), word(k) + "q", word(k)]), f"l{k:03d}") for k in range(300) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(docs, fit(docs), spans=True).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 590 and {r.lang_pred for r in got} >= {"l299", "l256", "l001"}
    mixed = identify(spark.createDataFrame([(1, (word(299) + " ") * 30 + (word(3) + " ") * 20)], "doc_id long, text string"), fit(docs), spans=True).first()
    assert [s.lang for s in mixed.spans] == ["l299", "l003"]


def test_nothing_to_learn_from(spark):
    none = fit(spark.createDataFrame([], "text string, lang string"))
    assert none.langs == [] and identify(spark.createDataFrame([("a b",)], "text string"), none).first().lang_pred == "und"
    assert isinstance(none, Model)


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs.where(~held_out()))
    test = identify(docs.where(held_out()), model).where(F.col("lang").isNotNull())
    right, n = test.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 100 and right / n >= 0.98


def test_few_texts_are_walked_without_arrays(monkeypatch):
    """The last texts of a walk go by lists: the paths are those of arrays."""
    import numpy as np

    from thicket.llm import langid

    rng = np.random.default_rng(3)
    lengths = [700, 3, 1, 400, 399, 50]
    blocks = np.repeat(rng.integers(0, 4, sum(lengths) // 20 + 1), 20)[: sum(lengths)]
    scores = rng.normal(0, 2, (sum(lengths), 4)).astype(np.float32)
    scores[np.arange(len(scores)), blocks] += 3
    scores -= scores.max(axis=1, keepdims=True)
    paths = []
    for few in (4, 12, 1000):
        monkeypatch.setattr(langid, "FEW", few)
        paths.append(langid.best_paths(scores, lengths).tolist())
    assert paths[0] == paths[1] == paths[2] and len(set(paths[0])) == 4
