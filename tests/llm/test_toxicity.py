"""Toxicity: features by hand, shares without a text's own part, held-out accuracy."""

import math
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import toxicity
from tessella.llm.common import Scratch, table

NONE = toxicity.Lexicon({}, 0, 0)


def named(text, lexicon=NONE, label=None):
    return dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon.weigher(label), lexicon.weigher(None)), strict=True))


def test_features_by_hand():
    f = named("You are a stupid IDIOT!! Really, my dear friends of the house say so: you")
    assert f["insults"] == pytest.approx(200 / 15) and f["learned"] == pytest.approx(200 / 15) and f["second_person"] == pytest.approx(200 / 15)
    assert f["near_second_person"] == 1 and f["shouted"] == pytest.approx(1 / 15) and f["bangs"] == pytest.approx(200 / 15) and f["marks"] == pytest.approx(100 / 15)
    far = named("idiot one two three four five six you")
    assert far["near_second_person"] == 0
    for hidden in ("1d1ot x", "an id10t", "a l0ser", "looooser", "pathetiiiic", "stu*pid"):
        assert named(hidden)["hidden_insults"] > 0, hidden
    assert named("cooooool 3rd b2b")["hidden_insults"] == 0 and named("no signs here")["drawn_out"] == 0
    assert named("") == named("?! 12 _") == dict.fromkeys(toxicity.FEATURES, 0.0)

    lexicon = toxicity.Lexicon({"foulest$": (8, 0)}, 10, 90)
    assert named("f0ulest of them", lexicon, 0)["hidden_insults"] > 0  # it has no part in a word that it hides


def test_weights_leave_a_texts_own_part_out():
    lexicon = toxicity.Lexicon({"foul$": (8, 0), "fou": (9, 30), "rare$": (3, 0)}, 10, 90)
    ratio = lambda a, b: math.log((a + 0.5) / 11) - math.log((b + 0.5) / 91)
    assert lexicon.weigher(None)("foul") == pytest.approx(ratio(8, 0)) and lexicon.weigher(1)("foul") == pytest.approx(ratio(7, 0))
    assert lexicon.weigher(0)("foundry") == pytest.approx(ratio(9, 29)) and lexicon.weigher(None)("foundry") == pytest.approx(ratio(9, 30))
    assert lexicon.weigher(None)("rare") > 0 and lexicon.weigher(1)("rare") == 0 and lexicon.weigher(None)("fine") == 0


def test_weights_are_those_of_all_units():
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))
    counts = {u: (rng.randrange(3, 9), rng.randrange(3)) for _ in range(60) for u in list(toxicity.units({word()}))[:2]}
    lexicon = toxicity.Lexicon(counts, 10, 90)
    weigh = lexicon.weigher(None)
    for w in {word() for _ in range(2000)}:
        assert weigh(w) == max((lexicon.weight(*counts[u]) for u in toxicity.units({w}) if u in counts), default=0.0)


def test_units_are_counted_once_a_text(spark):
    rows = spark.createDataFrame([(1, 1, "Foulest foulest foul"), (2, 0, "foul"), (3, 0, None), (4, 1, "fo")], "id long, y int, text string")
    got = {r.unit: (r.toxic, r.other) for r in toxicity.counted_units(rows).collect()}
    assert got == {"": (2, 2), "foul$": (1, 1), "fou": (1, 1), "foulest$": (1, 0), "foul": (1, 0), "foule": (1, 0), "foules": (1, 0), "fo$": (1, 0)}
    scratch = Scratch(spark)
    lexicon = toxicity.learn_lexicon(rows, scratch, units=2, least=1)
    assert sorted(lexicon.counts) == ["fo$", "foul"] and (lexicon.n_toxic, lexicon.n_other) == (2, 2)
    scratch.drop()


def test_held_out_accuracy_and_calibration(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs.withColumn("text", F.when(F.col("doc_id") == 4, F.lit(None)).otherwise(F.col("text"))), model)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(r.toxic, rows[r.doc_id].predicted) for r in labels.collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert sum(b for a, b in held if a) >= 0.7 * sum(a for a, _ in held)
    curve = model.calibration.predictions
    assert all(a <= b for a, b in zip(curve, curve[1:], strict=False))


def test_messy_rows(spark, messy, empty):
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, None), (None, 1), (8, 1), (9, 1)], "doc_id long, toxic int")
    assert toxicity.fit(messy, labels) == 1.0 and toxicity.fit(messy, labels.limit(0)) == 0.5 and toxicity.fit(empty, labels) == 0.5
    both = labels.unionAll(spark.createDataFrame([(i, 0) for i in (1, 2, 3, 4, 6)], labels.schema)).withColumn("text", F.lit("x"))
    for model in (1.0, toxicity.fit(messy, both)):
        rows = toxicity.score(messy.withColumn("x", F.lit(1)).withColumn("p", F.lit("y")), model).collect()
        assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.score(empty, model).count() == 0
    assert {tuple(r.features) for r in rows if r.doc_id in (1, 2, 3)} == {(0.0,) * len(toxicity.FEATURES)}
