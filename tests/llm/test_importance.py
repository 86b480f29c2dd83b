"""Importance resampling against plain counting, and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from caseweave.llm import _crc, _text, importance

SCHEMA = "doc_id long, text string, weight string, score string, rank string, n string, __words string"


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def brute(rows, aims, percent=25, n=10_000):
    counts = lambda t: np.bincount([zlib.crc32(f.encode()) % n for f in features(t)[1]] or [0], minlength=n) * bool(features(t)[1])
    s, t = (sum((counts(x) for x in texts), np.zeros(n, int)) for texts in ([r[1] for r in rows], aims))
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (float(s.sum()) + n) / ((float(s[b]) + 1) * (float(t.sum()) + n)))) for b in range(n)]
    out = []
    for r in rows:
        w, f = features(r[1])
        weight = sum(gain[zlib.crc32(x.encode()) % n] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w)])
    fit = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0]))
    for k, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = k + 1
    return [tuple(x[:5]) for x in out]


def text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    plain, aim = [f"w{k}é" for k in range(300)], [f"W{k}É" for k in range(250, 330)]
    out = [(k, text(rng, plain if k % 4 else aim, rng.choice([3, 19, 20, 60])), *"wsrnx") for k in range(150)]
    out += [(500, None, *"wsrnx"), (501, "", *"wsrnx"), (502, " .-! \x7f", *"wsrnx"), (503, text(rng, plain, 9000), *"wsrnx"), (504, "hot " * 3000, *"wsrnx")]
    return out + [(505, "x" * 5000 + " 1 " + "y" * 49 + " z" * 30, *"wsrnx"), (506, "a\x00b_C|Ää 😀x" * 9, *"wsrnx"), (None, text(rng, aim, 40), *"wsrnx")]


AIMS = ["w250é w260é w270é " * 5, None, "", "w300É W301é"]


def test_resample_against_brute_force(spark, rows):
    rng = random.Random(9)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    target = spark.createDataFrame([(t, "x") for t in AIMS], "text string, doc_id string")
    got = importance.resample(docs, target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows, AIMS)))
    drawn = {r.doc_id for r in importance.draw(docs, target).collect()}
    assert drawn == {r[0] for r in brute(rows, AIMS) if r[4] and r[0] is not None}
    twice = rows + rows[3:7]  # repeated rows are drawn each on its own
    again = importance.resample(spark.createDataFrame(rng.sample(twice, len(twice)), SCHEMA), target).collect()
    assert sorted(r["rank"] for r in again if r["rank"]) == list(range(1, sum(r[4] is not None for r in brute(twice, AIMS)) + 1))


def test_empty(spark, rows):
    docs, target = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(t,) for t in AIMS], "text string")
    assert importance.resample(docs.limit(0), target).count() == 0
    got = importance.resample(docs, target.limit(0)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, [])))


def test_planes_hold_all_counts():
    owner, bucket = np.array([0, 0, 0, 2, 2, 2, 2, 2]), np.array([7, 7, 69, 0, 0, 0, 0, 99])
    planes = importance._planes(owner, bucket, 3, 100)
    assert [len(p) // importance._width(100) for p in planes] == [2, 0, 3]
    sums = np.zeros((3, 100), int)
    for d, blob in enumerate(planes):
        for k, plane in enumerate(np.frombuffer(blob, np.uint8).reshape(-1, importance._width(100))):
            sums[d] += np.unpackbits(plane, bitorder="little")[:100].astype(int) << k
    assert sums[0][[7, 69]].tolist() == [2, 1] and sums[2][[0, 99]].tolist() == [4, 1] and sums.sum() == 8


def test_crc_of_runs_and_pairs():
    rng = random.Random(1)
    raw = [" ".join("".join(rng.choice("ab1é") for _ in range(rng.choice([1, 2, 7, 48, 49, 300]))) for _ in range(rng.choice([0, 1, 2, 50]))).encode() for _ in range(100)]
    words = _text.split(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    own = _crc.runs(words.data, words.starts, words.ends)
    assert own.tolist() == [zlib.crc32(words.text(k)) for k in range(len(own))]
    at = np.flatnonzero(np.diff(words.owner()) == 0)
    assert _crc.word_pairs(words, own, at).tolist() == [zlib.crc32(words.text(k) + b" " + words.text(k + 1)) for k in at]


def test_query_against_sql(spark, rows, tmp_path):
    (tmp_path / "d").mkdir()
    spark.createDataFrame([r for r in rows if r[0] not in (None, 506)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "d/documents.parquet"))
    spark.createDataFrame([(k, t) for k, t in enumerate(AIMS)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d/benchmark.parquet"))
    got = importance.op13(spark, str(tmp_path / "d")).collect()
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/d/{t}.parquet/*.parquet'")
    want = con.sql(importance.OP13_SQL)
    assert sorted(map(str, map(tuple, got))) == sorted(str(tuple(r[want.columns.index(c)] for c in got[0].__fields__)) for r in want.fetchall())
