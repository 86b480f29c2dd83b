"""Language models against brute force, held-out accuracy, and odd rows."""

import collections
import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.llm import langid

SCHEMA = "doc_id long, text string, lang string, g string, n string, bits string, doc string"


def symbols(text):
    """Blank-padded symbols of a text, one character each (no character beyond 16 bits here)."""
    out = "   "
    for c in text or "":
        c = c.lower() if unicodedata.category(c)[0] in "LM" and len(c.lower()) == 1 else c
        c = c if unicodedata.category(c)[0] in "LM" else " "
        if c != " " or out[-1] != " ":
            out += c
    return out if out[-1] == " " else out + " "


def probability(counts, seen, gram):
    """Interpolated Kneser-Ney of a gram's last symbol by plain dictionaries of each order."""
    p = 1 / seen
    for k in range(1, 5):
        table, own = counts[k], gram[-k:]
        ones, twos = sum(n == 1 for n in table.values()), sum(n == 2 for n in table.values())
        d = min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5
        same = {g: n for g, n in table.items() if g[:-1] == own[:-1]}
        if same:
            p = max(table.get(own, 0) - d, 0) / sum(same.values()) + d * len(same) / sum(same.values()) * p
    return p


def make(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_models_against_brute_force():
    rng = random.Random(1)
    texts = [make(rng, "abcdé", 30) + "." for _ in range(5)]
    fours = collections.Counter(s[i - 3 : i + 1] for s in map(symbols, texts) for i in range(3, len(s)))
    counts = {4: fours}
    for k in (3, 2, 1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    seen = len({g[-1] for g in fours}) + 1
    key = lambda g: sum(ord(c) << 16 * (3 - j) for j, c in enumerate(g))
    model = langid.Model(np.array([key(g) for g in fours], np.uint64), np.array([*fours.values()]), seen)
    raw = [t.encode() for t in ["ab c", "dé  zx,a", ""]]
    got, owner = langid.grams(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    want = [(k, s[i - 3 : i + 1]) for k, s in enumerate(map(symbols, (r.decode() for r in raw))) for i in range(3, len(s))]
    assert [(k, key(g)) for k, g in want] == list(zip(owner.tolist(), got.tolist(), strict=True))
    assert model.bits(got) == pytest.approx([-math.log2(probability(counts, seen, g)) for _, g in want], rel=1e-5)
    every = sum(probability(counts, seen, "abc" + c) for c in {g[-1] for g in fours})
    assert every < 1 and 1 - every == pytest.approx(probability(counts, seen, "abc?"))


def test_predictions(spark):
    rng = random.Random(2)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    rows = [(k, make(rng, letters[lang], rng.choice([5, 20, 60])), lang, "x", "y", "z", "d") for k in range(300) for lang in [("aa", "aa", "bb", "cc")[k % 4]]]
    rows += [(1000, None, "aa", *"xyzd"), (1001, "", "aa", *"xyzd"), (1002, "12 34 !?", "bb", *"xyzd"), (1003, "ABAB CDCD GAGA", None, *"xyzd")]
    rows += [(None, "ijk lmn opo", "cc", *"xyzd"), (1004, make(rng, "abcdefgh", 30000), "aa", *"xyzd"), (1005, "q" * 6000, "cc", *"xyzd"), (1006, "😀 漢字 ǅ", "cc", *"xyzd")]
    rows += [(1007, make(rng, "stuvwxyz", 40), None, *"xyzd"), (1008, "жд ща", "only-here", *"xyzd")] + rows[:2]
    got = langid.predict(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    right = [by[k].lang_pred == lang for k, _, lang, *_ in rows[:300] if by[k].held_out]
    assert len(right) > 50 and sum(right) >= 0.98 * len(right)
    assert all((by[k].lang_pred, by[k].score, by[k].bits, by[k].accepted) == ("und", 0.0, None, False) for k in (1000, 1001, 1002))
    assert by[1003].lang_pred == "aa" and by[1004].lang_pred == "aa" and by[None].lang_pred == "cc"
    assert all(0 <= r.score <= 1 and r.lang_pred in ("und", "aa", "bb", "cc", "only-here") for r in got)
    assert not by[1007].accepted and sum(r.accepted for r in got) > 280


def test_layout_does_not_matter_and_held_out_rows_teach_nothing(spark):
    rng = random.Random(3)
    rows = [(k, make(rng, "abcdefgh" if k % 2 else "fghijklm", 12), "ab"[k % 2], *"xyzd") for k in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = {r.doc_id: r for r in langid.predict(df.repartition(5)).collect()}
    held = langid.fold(F.col("doc_id")) == 2
    other = df.withColumn("lang", F.when(held, F.lit("never")).otherwise(F.col("lang"))).coalesce(1)
    two = {r.doc_id: r for r in langid.predict(other).collect()}
    assert {k: (r.lang_pred, round(r.bits, 9)) for k, r in one.items()} == {k: (r.lang_pred, round(r.bits, 9)) for k, r in two.items()}


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None, *"xyzd"), (2, None, "a", *"xyzd")], SCHEMA)
    assert {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(df).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert langid.predict(df.limit(0)).count() == 0
    same = spark.createDataFrame([(k, "abc abd", "a", *"xyzd") for k in range(20)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in langid.predict(same).collect()} == {("a", 1.0)}


def test_a_small_sample_still_learns(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGE_CHARS", 4000)
    rng = random.Random(4)
    rows = [(k, make(rng, "abcdefgh" if k % 2 else "fghijklm", 12), "ab"[k % 2], *"xyzd") for k in range(400)]
    got = langid.predict(spark.createDataFrame(rows, SCHEMA)).filter("held_out").collect()
    assert sum(r.lang_pred == "ab"[r.doc_id % 2] for r in got) >= 0.97 * len(got) > 50
