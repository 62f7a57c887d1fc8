"""Classifiers: held-out accuracy, what they may learn from, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from batchloom.llm import common, language_id, toxicity

from . import brute

SYLLABLES = {"aa": "ka lo mi te ru ne so", "bb": "sch ung ein lich ver ach tz", "cc": "eau oi que ent ai ou re"}
EDGE = [(9001, None, "aa"), (9002, "", "bb"), (9003, "123 !?", "cc"), (9004, "kalo mite " * 30_000, None)]


def text(rng, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in ("part", "held_out", "score", "__id", "source", "toxic", "lang_pred")])


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(k, text(rng, lang, rng.randrange(3, 40)), lang) for k, lang in enumerate(rng.choices("aa bb cc".split(), k=600))]
    # Rows of the held-out fold carry a wrong language: nothing may be learned from them.
    rows = [(k, t, "wrong" if brute.held_out(k) else lang) for k, t, lang in rows]
    truth = {k: next(v for v, s in SYLLABLES.items() if t.split()[0].startswith(tuple(s.split()))) for k, t, _ in rows}
    df = clashing(spark.createDataFrame(rows + EDGE + rows[:2], "doc_id long, text string, lang string"))
    got = language_id.identify(df).collect()
    assert len(got) == 606
    by = {r["doc_id"]: r for r in got}
    assert {r["lang_pred"] for r in got} == {"aa", "bb", "cc", "und"}
    assert all(r["held_out"] == brute.held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    assert [by[k]["lang_pred"] for k in (9001, 9002, 9003, 9004)] == ["und", "und", "und", "aa"]
    held = [k for k in truth if brute.held_out(k)]
    assert sum(by[k]["lang_pred"] == truth[k] for k in held) > 0.97 * len(held)
    # Names, sources and other columns don't matter: the same texts get the same answers.
    moved = clashing(spark.createDataFrame([(k, t, lang) for k, t, lang in rows], "doc_id long, text string, lang string")).withColumn("source", F.lit("other"))
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(moved).collect()} == {k: by[k]["lang_pred"] for k in truth}


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None), (None, "abc", None)], "doc_id long, text string, lang string")
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(df).collect()} == {(1, "und", 0.0), (None, "und", 0.0)}
    assert language_id.identify(df.limit(0)).count() == 0


def test_temperature_calibrates():
    import numpy as np

    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 4000)
    logits = np.zeros((4000, 2))
    right = rng.random(4000) < 0.8
    logits[np.arange(4000), np.where(right, y, 1 - y)] = 10 * np.log(4)  # ten times too sure
    assert abs(language_id.temperature(logits, y) - 10) < 1


def toxic_table(spark, seed=3, n=700):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = text(rng, rng.choice(["aa", "bb", "cc"]), rng.randrange(5, 120)).split()
        bad = k % 7 == 0
        for _ in range(rng.randrange(1, 4) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["IDIOT", "worthless!", "pathetic", "Zzuml" + rng.choice(["ing", "er", "s"])])
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_table(spark)
    truth = dict(labels)
    # Labels of the held-out fold are turned round: nothing may be learned from them.
    given = [(k, 1 - v if brute.held_out(k) else v) for k, v in labels] + [(9001, None)]
    df = clashing(spark.createDataFrame(rows + [(d, t) for d, t, _ in EDGE] + rows[:2], "doc_id long, text string"))
    lab = spark.createDataFrame(given, "doc_id long, toxic int")
    got = toxicity.score(df, lab).collect()
    assert len(got) == len(rows) + 6
    by = {r["doc_id"]: r for r in got}
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 and r["held_out"] == brute.held_out(r["doc_id"]) for r in got)
    assert all(by[k]["predicted"] == 0 for k in (9001, 9002, 9003, 9004))
    held = [k for k in truth if brute.held_out(k)]
    assert sum(by[k]["predicted"] == truth[k] for k in held) > 0.97 * len(held)
    assert [by[k]["predicted"] for k in held if truth[k]].count(1) > 0.9 * sum(truth[k] for k in held)
    kept = toxicity.reject(df, lab)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in by.items() if not r["predicted"]}


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r["score"], r["predicted"]) for r in toxicity.score(df, none).collect()] == [(0.0, 0)] * 2
    assert toxicity.reject(df, none).count() == 2
    assert toxicity.score(df.limit(0), none).count() == 0


def test_dictionaries_part_the_classes():
    toxic = [toxicity.normal(f"lorem{i} ipsum{i} some idiot dolor{i}") for i in range(50)]
    plain = [toxicity.normal(f"lorem{i} ipsum{i} some other dolor{i}") for i in range(200)]
    contents = toxicity.dictionaries(toxic, plain)
    assert len(contents[0]) == len(contents[1])
    assert sum(toxicity.distances(toxicity.normal("what an idiot that is"), contents)[1:]) == 1
    assert sum(toxicity.distances(toxicity.normal("what other thing that is"), contents)[1:]) == 0
    raw = toxicity.normal("Ein längerer Text, " * 40)
    assert sum(map(len, toxicity.windows(raw))) == len(raw)


def test_fits_are_bounded_by_bytes(spark):
    df = spark.createDataFrame([(1, "a" * 10, None), (2, "b" * 10, "x"), (3, "c" * 40, "x"), (4, None, None), (5, "d" * 11, None)], "k int, a string, b string")
    keys = lambda most: sorted(r["k"] for r in common.collect_within(df, "test", most, "a", "b"))
    assert keys(200) == [1, 2, 3, 4, 5] and keys(72) == [1, 2, 4, 5]
    assert keys(31) == [1, 4]  # rows of one size go together
    assert keys(0) == [4] and common.collect_within(df.limit(0), "test", 9, "a") == []


def test_nothing_learned_rejects_nothing(spark):
    """Labels that no window tells apart: the classes' numbers alone call no text toxic, and a text without a distance never is."""
    rows = [(k, f"some quite ordinary words of text number {k % 7}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (2, 3, 10):
        labels = spark.createDataFrame([(k, int(k % share == 0)) for k in range(60)], "doc_id long, toxic int")
        assert {r["predicted"] for r in toxicity.score(df, labels).collect()} == {0}
        assert toxicity.reject(df, labels).count() == 60
    assert toxicity.log_odds([10, *[0] * toxicity.STEPS[-1]], [5.0] * (1 + 2 * len(toxicity.STEPS))) < 0


@pytest.mark.parametrize("sf, found, wrong", [("0.001", 0.0, 0.0), ("0.01", 0.6, 0.05)])
def test_toxicity_of_small_tables(spark, sf, found, wrong):
    """Few labels may teach nothing, but then nothing is called toxic."""
    sf = f"/root/testdata/sf{sf}"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    toxic = [d for d in known if known[d] == 1]
    assert sum(got[d] for d in toxic) >= found * len(toxic)
    assert sum(got[d] for d in known if known[d] == 0) <= wrong * len(known)
