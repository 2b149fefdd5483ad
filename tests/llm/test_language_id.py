import random

import numpy as np
from pyspark.sql import functions as F

from tidegauge.llm import language_id, queries

SOUNDS = {"xx": ["ka", "ri", "mo", "tu"], "yy": ["sch", "ung", "eit", "pf"], "zz": ["eau", "oi", "qu", "ent"]}


def _text(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_ngram_vectors_bind_rotated_letters():
    e = language_id.Encoder(dim=64)
    out = e.bundle(["ab"])[0]
    a, b, gap = (e.rotated[2][e.code_of[ord(c)] if c else 0].astype(int) for c in ("a", "b", ""))
    # " ab" and "ab "
    want = np.roll(gap, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * gap
    assert (out == want).all()


def test_pieces_of_long_texts_add_up(monkeypatch):
    text = _text("xx", 500, 1)
    whole = language_id.Encoder().bundle([text])[0]
    monkeypatch.setattr(language_id, "STEP_LETTERS", 101)
    cut = language_id.Encoder().bundle([text])[0]
    assert np.dot(whole, cut) / np.linalg.norm(whole) / np.linalg.norm(cut) > 0.999


def test_held_out_accuracy(spark, stored):
    rows = [(i, _text(lang, 40, i), lang, "s", 1) for i, lang in enumerate(list(SOUNDS) * 60)]
    rows += [(1000, None, "xx", "s", 0), (1001, "123 !?", "xx", "s", 0), (1002, _text("yy", 30_000, 9), None, "s", 0)]
    folder = stored(documents=spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    out = {r.doc_id: r for r in queries.op1_language_id(spark, folder).collect()}
    assert len(out) == len(rows)
    assert all(out[i].lang_pred == lang for i, _, lang, *_ in rows[:180])
    assert out[1000].lang_pred == out[1001].lang_pred == "und" and out[1002].lang_pred == "yy"
    assert all(0 <= r.score <= 1 for r in out.values())


def test_odd_and_empty(odd_docs, no_docs):
    profiles = language_id.prototypes(odd_docs)
    assert set(profiles) == {"de", "en"}
    assert language_id.identify(odd_docs, profiles).count() == odd_docs.count()
    assert language_id.prototypes(no_docs) == {}
    assert {r.lang_pred for r in language_id.identify(odd_docs, {}).collect()} == {"und"}
    assert language_id.identify(no_docs, profiles).count() == 0


def test_clashing_names_and_ties(spark, odd_docs):
    profiles = language_id.prototypes(odd_docs)
    more = odd_docs.withColumnsRenamed({"source": "_text", "n_chars": "score"}).withColumns({"lang_pred": F.lit("x"), "held_out": F.lit(True)})
    plain = sorted(map(repr, language_id.identify(odd_docs, profiles).collect()))
    assert sorted(map(repr, language_id.identify(more, profiles).collect())) == plain
    one = profiles["en"]
    tied = language_id.identify(odd_docs.where("doc_id = 1"), {"aa": one, "mm": one, "zz": one}).first()
    assert tied.lang_pred == "aa"
