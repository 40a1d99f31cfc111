import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundweave.llm import langid, toxicity
from groundweave.llm.toxicity import score_toxicity


def texts(seed, n, special=()):
    rng = random.Random(seed)
    return " ".join(rng.choice(special) if special and rng.random() < 0.12 else "".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


INSULTS = ("blockhead", "nitwitted", "fiendish")


@pytest.fixture(scope="module")
def labelled():
    return [(i, texts(i, 60, INSULTS if i % 4 == 0 else ()), int(i % 4 == 0)) for i in range(300)]


def test_toxicity_on_held_out_rows(spark, docs_of, labelled):
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in labelled if i < 200], "doc_id LONG, quality INT, toxic INT")
    got = {r["doc_id"]: r for r in score_toxicity(docs_of([(i, t) for i, t, _ in labelled]), labels, F.lit(True)).collect()}
    right = [got[i]["predicted"] == y for i, _, y in labelled if i >= 200]
    assert np.mean(right) > 0.95 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_toxicity_odd_rows(spark, clashing):
    labels = spark.createDataFrame([(7, 1, 1), (7, 1, 0), (10, 1, 0), (6, None, None), (None, 1, 1)], "doc_id LONG, quality INT, toxic INT")
    got = score_toxicity(clashing, labels, F.lit(True)).collect()
    assert len(got) == 14 and len({r["score"] for r in got if not toxicity.tokens(r["text"])}) == 1
    none = score_toxicity(clashing, labels.limit(0), F.lit(True)).collect()
    assert {r["score"] for r in none} == {0.0}


def test_toxicity_of_no_rows(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    assert score_toxicity(docs_of([]), labels, F.lit(True)).collect() == []


def test_windows_hold_every_word():
    for n in range(0, 20):
        words = [f"w{i}" for i in range(n)]
        assert {w for x in toxicity.windows(words) for w in x.decode().split()} == set(words)


LANGUAGES = {"xa": "kolu mira sente", "xb": "thwex grindle shock", "xc": "äöß ünd çelik"}


def sentences(lang, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(LANGUAGES[lang].split()) + rng.choice("aeiou") for _ in range(25))


def test_language_of_held_out_rows(docs_of):
    rows = [(i, sentences(lang, i), lang) for i, lang in enumerate(list(LANGUAGES) * 40)]
    model = langid.fit(docs_of(rows[:90]).select("doc_id", "text", "lang"))
    got = {r["doc_id"]: r for r in langid.identify(docs_of(rows), model).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows[90:]]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert (model.weights == 0).mean() > 0.9  # the penalty keeps the weights sparse


def test_language_odd_rows(docs_of, clashing):
    rows = [(i, sentences(lang, i), lang) for i, lang in enumerate(list(LANGUAGES) * 10)] + [(100, "no label", None), (101, None, "xa"), (None, "no id", "xa")]
    model = langid.fit(docs_of(rows).select("doc_id", "text", "lang"))
    got = langid.identify(clashing, model).collect()
    assert len(got) == 14 and all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in got)
    assert {r["lang_pred"] for r in langid.identify(clashing, langid.fit(docs_of([]).select("doc_id", "text", "lang"))).collect()} == {"und"}
    assert langid.identify(docs_of([]), model).collect() == []


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    target = rng.integers(0, 3, 500)
    scores = 9 * (np.eye(3)[target] + rng.normal(0, 1.0, (500, 3)))
    model = langid.Model(["a", "b", "c"], np.ones(4))
    model.calibrate(scores, target)
    assert model.temperature > 2
