import random

import pytest

from talentloom.llm import langid as L

STEMS = {"en": ["the", "with", "king", "thought", "and", "ship"], "de": ["der", "schön", "und", "zeit", "über", "nicht"], "fr": ["le", "où", "été", "garçon", "que", "eaux"]}


@pytest.fixture()
def labelled(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        lang = list(STEMS)[i % 3]
        rows.append((i, " ".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(4, 60))), lang if i % 7 else None))
    rows += [(900, None, "en"), (901, "12 -- 34", "de"), (902, "", None), (None, "the king and the ship", "en"), (1, "the thought", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return df, str(tmp_path), {r[0]: r for r in rows if r[0] not in (None, 1)}


def test_held_out_accuracy(spark, labelled):
    _, folder, rows = labelled
    got = {r["doc_id"]: r for r in L.op3_langid(spark, folder).collect() if r["doc_id"] in rows}
    assert all(got[i]["lang_pred"] == "und" and not got[i]["accepted"] and got[i]["score"] == 0 for i in (900, 901, 902))
    held = [i for i in got if got[i]["held_out"] and i < 900]
    right = sum(got[i]["lang_pred"] == list(STEMS)[i % 3] for i in held)
    assert len(held) > 30 and right / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_prediction_sees_only_the_text(labelled):
    df, _, _ = labelled
    model = L.train(df)
    texts = [L.letters(x) for x in ("der schön und", "le garçon", "with the king")]
    alone = [model.predict([t]) for t in texts]
    together = model.predict(texts)
    assert [int(a[0][0]) for a in alone] == together[0].tolist()
    assert [float(a[1][0]) for a in alone] == pytest.approx(together[1].tolist())
    assert [model.languages[int(a[0][0])] for a in alone] == ["de", "fr", "en"]


def test_no_labels_and_empty(spark, labelled):
    df, _, _ = labelled
    model = L.train(df.where("lang is null"))
    assert {r["lang_pred"] for r in L.predict(df, model).collect()} == {"und"}
    assert L.predict(df.limit(0), L.train(df.limit(0))).collect() == []


def test_clashing_columns(labelled):
    df, _, _ = labelled
    out = L.predict(df.withColumnRenamed("lang", "score"), L.train(df))
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "accepted"]


def test_signs_that_are_no_letters():
    assert [L.letters(x) for x in ("½ ²³ Ⅷ", "\u0301", "12_3", "ª½", "Æ1")] == ["", "", "", "ª½", "æ"]


def test_foreign_text_is_rejected_and_known_text_kept(spark, labelled):
    df, _, _ = labelled
    model = L.train(df)
    rng = random.Random(5)
    words = ["привет", "мир", "καλημέρα", "κόσμε", "zzyzx", "qwlth", "ommw"]
    strange = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(60)]
    known = [(100 + i, " ".join(rng.choice(STEMS[x]) for _ in range(20))) for i, x in enumerate(list(STEMS) * 40)]
    out = {r["doc_id"]: r["accepted"] for r in L.predict(spark.createDataFrame(strange + known, "doc_id long, text string"), model).collect()}
    assert sum(out[i] for i, _ in strange) <= 6 and sum(out[i] for i, _ in known) >= 118


def test_threshold_by_hand():
    import numpy as np

    logits = np.array([[4.0, 0.0], [3.0, 0.0], [0.0, 5.0], [0.2, 0.0]])
    scale, low = L.calibrate(logits, np.array([0, 0, 1, 0]), np.array([]))
    right = L.softmax(logits * scale).max(axis=1)
    assert low == min(0.5, right.min())  # nothing to refuse
    _, mid = L.calibrate(logits, np.array([0, 0, 1, 1]), np.array([0.6, 0.7, 0.9999999]))
    assert 0.7 < mid < 0.9999999  # above what can be refused, below the right answers
    assert L.calibrate(np.zeros((0, 2)), np.zeros(0, int), np.zeros(0)) == (1.0, 0.5)


def plain_features(text):
    """Bucket ids of one text by plain arithmetic."""
    raw = b" " + text.encode() + b" \0\0\0"
    out = []
    for i in range(len(raw) - 3):
        three = raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16
        four = three | raw[i + 3] << 24
        m = 2**32
        out.append((((three * 0x9E3779B1 % m) ^ (three >> 15)) * 0x85EBCA77 % m) >> (32 - L.BUCKET_BITS))
        out.append((((four * 0xC2B2AE3D % m) ^ (four >> 13)) * 0x27D4EB2F % m) >> (32 - L.BUCKET_BITS))
    return out


def test_predictions_match_a_plain_model(spark, labelled):
    import math

    df, _, rows = labelled
    model = L.train(df)
    got = {r["doc_id"]: r for r in L.predict(df, model).collect()}
    for i, (_, text, _) in list(rows.items())[:60]:
        if not (t := L.letters(text)):
            continue
        f = plain_features(t)
        logits = [sum(float(model.table[b, k]) for b in f) / len(f) for k in range(len(model.languages))]
        p = [math.exp(x - max(logits)) for x in logits]
        best = max(range(len(p)), key=lambda k: p[k])
        assert got[i]["lang_pred"] == model.languages[best] and abs(got[i]["score"] - p[best] / sum(p)) < 1e-4
