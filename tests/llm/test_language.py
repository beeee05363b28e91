"""Labels, segments, and accuracy on rows the model has not seen."""

from __future__ import annotations

import pytest

from contextframe.llm import language as L


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return L.fit(L.sample(docs, "text", "lang", "doc_id"))


EN = "We noticed that the release branch reorders the search filter before every release, although the change was already fixed."
DE = "Wir haben bemerkt, dass die Sperrdatei nach jedem Neustart die Aufgabe überspringt, denn die Reihenfolge ist nicht fest."
FR = "Nous avons remarqué que le module ralentit le répertoire pendant la nuit, parce que le journal ne contient plus rien."


def languages(model, text):
    return [s[0] for s in L.Tagger(model).segments([text])[0]]


@pytest.mark.parametrize(("label", "code"), [("EN", "en"), ("en-US", "en"), ("pt_BR", "pt"), ("zho", "zh"), (" Deutsch ", "de"), ("", None), (None, None), ("und", None), ("it", "it")])
def test_labels(label, code):
    assert L.named(label) == code


def test_segments(model):
    assert languages(model, EN) == ["en"]
    assert languages(model, EN + "\n\n" + DE + " " + EN) == ["en", "de", "en"]
    assert languages(model, (EN + " " + FR).upper()) == ["en", "fr"]
    assert languages(model, DE + "\n\n`Name: файл не найден`\n\n" + DE) == ["de"]
    assert languages(model, EN + " файл не найден. " + EN) == ["en"]
    assert languages(model, FR + "\n```\ndef run(x):\n    return the_value of x and that is all we have for now\n```\n" + FR) == ["fr"]


@pytest.mark.parametrize("text", ["", " \n", "====", "😀😀", "a1b2c3d4e5", "é" * 9, "2025-01-01T00:00:00Z INFO x[1] a=1 b=c", "def f(a):\n    if a > 3:\n        return None\n    return a", "src/a/b.rs:12", "12345"])
def test_no_prose(model, text):
    assert languages(model, text) == []


def test_held_out_accuracy(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 7 = 3").select("text", "lang").collect()
    texts = [(r.text, L.named(r.lang)) for r in rows if r.text and L.named(r.lang) in L.LANGUAGES]
    found = L.Tagger(model).segments([t for t, _ in texts])
    single = [(s[0][0], label) for s, (_, label) in zip(found, texts, strict=True) if len(s) == 1]
    assert len(single) > 800
    assert sum(a == b for a, b in single) / len(single) > 0.9  # the labels themselves are wrong for some


def test_confidence_and_words(model):
    (_, begin, end, words, confidence), = L.Tagger(model).segments([EN])[0]
    assert 15 <= words <= 20 and 0.9 < confidence <= 1 and L.passage(EN, begin, end) == EN


def test_table(spark, model):
    rows = [(1, EN, "en"), (2, EN, "de"), (3, EN, None), (4, EN + "\n\n" + DE, "en"), (5, None, None), (6, "", "en"), (7, "the " * 100_000, "en"), (1, EN, "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'x' AS label", "1 AS words")
    segments = L.find_segments(df, model)
    assert sorted((r.doc_id, r.seg_no, r.lang) for r in segments.where(L.is_case()).collect()) == [(2, 1, "en"), (3, 1, "en"), (4, 1, "en"), (4, 2, "de")]
    assert segments.where("doc_id = 1").count() == 2
    assert L.find_segments(df.limit(0), model).count() == 0


def test_no_labels(spark):
    df = spark.createDataFrame([(1, EN, "und")], "doc_id bigint, text string, lang string")
    assert L.find_segments(df, L.fit(L.sample(df, "text", "lang", "doc_id"))).count() >= 0


def _joined(*runs):
    """(language, words, confidence) of segments; runs are (language, words) or (language, words, confidence)."""
    ends = [sum(run[1] for run in runs[: k + 1]) for k in range(len(runs))]
    full = [[lang, end - n, end, n, n * (of[0] if of else 1.0), n] for (lang, n, *of), end in zip(runs, ends, strict=True)]
    return [(run[0], run[3], round(run[4] / run[5], 3)) for run in L.joined(full)]


def test_short_runs_are_absorbed_before_the_limit():
    assert _joined(("en", 30), ("de", 5), ("en", 3), ("de", 6)) == [("en", 30, 1.0), ("de", 11, 1.0)]
    assert _joined(("en", 30), ("de", 5), ("fr", 2), ("en", 3), ("de", 6), ("en", 9)) == [("en", 30, 1.0), ("de", 11, 1.0), ("en", 9, 1.0)]
    assert _joined(("en", 4), ("de", 3), ("en", 3), ("de", 2), ("en", 2)) == [("en", 9, 1.0)]
    assert _joined(("en", 30), ("de", 7), ("en", 30)) == [("en", 60, 1.0)]
    assert _joined(("en", 30), ("de", 8), ("en", 30)) == [("en", 30, 1.0), ("de", 8, 1.0), ("en", 30, 1.0)]
    assert _joined(("de", 3), ("en", 2)) == [] and _joined(("de", 3), ("en", 5)) == [("en", 5, 1.0)]


def test_unsure_segments_come_with_their_confidence():
    assert _joined(("es", 40), ("pt", 12, 0.7), ("es", 40)) == [("es", 40, 1.0), ("pt", 12, 0.7), ("es", 40, 1.0)]


def test_fitting_is_not_cut_short():
    import inspect

    assert inspect.signature(L.fit).parameters["steps"].default >= 160


def test_a_kept_model(spark, tmp_path):
    rows = [(k, text, lang) for k, (text, lang) in enumerate([("the cat sits on the mat and looks at us.", "en"), ("die Katze sitzt auf der Matte und sieht uns an.", "de")] * 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    file = tmp_path / "model.npz"
    made = L.fitted(df, "text", "lang", "doc_id", file)
    again = L.fitted(df.limit(0), "text", "lang", "doc_id", file)
    words = ["katze", "mat", "und", "the"]
    assert again.index == made.index and (again.emissions(words) == made.emissions(words)).all() and (again.transitions == made.transitions).all()
