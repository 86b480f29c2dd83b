"""Files over several splits, digests of large files, versioned merges, long audit logs, similarity of headers."""

import csv
import hashlib
import io
import os
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from caseweave.config import CANONICAL_FIELDS
from caseweave.operators import ingest, integrity, mapping
from caseweave.sources import files, versioned


def test_quoted_line_breaks_across_many_splits(spark, tmp_path):
    """Rows of files of many splits, some with cells longer than a split, equal those of the csv module."""
    rng = random.Random(1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        want = {}
        for name in ("a", "b"):
            out = io.StringIO()
            rows = [[str(k), rng.choice(["plain", 'has "quotes"', "two\nlines", "x, y", "many\n" * rng.choice([3, 900])])] for k in range(400)]
            csv.writer(out, lineterminator="\n").writerows([["No", "Said"], *rows])
            (tmp_path / f"{name}.csv").write_text(out.getvalue())
            at, found = 2, []
            for r in rows:
                found.append((at, r[0], r[1].strip()))
                at += 1 + r[1].count("\n")
            want[name] = found
        lines = files.numbered_lines(spark, str(tmp_path))
        assert lines.select("path", "block").distinct().count() > 20
        got = files.delimited(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(r.reason is None for r in got)
    for name, rows in want.items():
        assert sorted((r.source_row, r.cells[0], r.cells[1].strip()) for r in got if r.path.endswith(f"{name}.csv")) == rows


def test_register_of_large_and_small_files(spark, tmp_path):
    """Digests and kinds; one file is larger than a row of Spark can be."""
    (tmp_path / "cdr.csv").write_text("A Party No,IMEI,Call Date\n1,2,3\n")
    (tmp_path / "mail.txt").write_text("Received: from x\nSubject: y\n")
    (tmp_path / "other.bin").write_bytes(bytes(range(256)) * 9)
    size = (1 << 31) + 12345
    with open(tmp_path / "large.img", "wb") as f:
        os.truncate(f.fileno(), size)
    sha, left, zero = hashlib.sha256(), size, bytes(1 << 24)
    while left:
        sha.update(zero[: min(left, len(zero))])
        left -= min(left, len(zero))
    got = {os.path.basename(r.path): r for r in files.register(spark, str(tmp_path)).collect()}
    assert {k: r.kind for k, r in got.items()} == {"cdr.csv": "CDR", "mail.txt": "EML", "other.bin": "UNKNOWN", "large.img": "UNKNOWN"}
    assert got["large.img"].size_bytes == size and got["large.img"].sha256 == sha.hexdigest()
    for name in ("cdr.csv", "mail.txt", "other.bin"):
        body = (tmp_path / name).read_bytes()
        assert (got[name].sha256, got[name].md5, got[name].size_bytes) == (hashlib.sha256(body).hexdigest(), hashlib.md5(body).hexdigest(), len(body))


def test_a_merge_leaves_untouched_buckets_alone(spark, tmp_path):
    path = f"file://{tmp_path}/entities"
    schema = "case_id string, entity_type string, normalized string, occurrences long, raw string, role string, first_seen timestamp, last_seen timestamp"
    row = lambda k, n, role: ("c", "PHONE", f"+{k}", n, f"r{n}", role, None, None)
    one = spark.createDataFrame([row(k, 1, "UNKNOWN") for k in range(200)], schema)
    two = spark.createDataFrame([row(k, 5, "SUSPECT") for k in (3, 500)], schema)
    combine = lambda old, new: ingest.upserted_entities(old, new).select(*new.columns)
    keys = ["case_id", "entity_type", "normalized"]
    assert versioned.merge(one, path, keys, combine, buckets=16) == 1
    files_of = lambda: {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(tmp_path) for n in names}
    before = files_of()
    assert versioned.merge(two, path, keys, combine) == 2
    after = files_of()
    assert before.items() <= after.items()
    new_buckets = {f.split("__bucket=")[1].split("/")[0] for f in after.keys() - before.keys() if "__bucket=" in f and f.endswith(".parquet")}
    assert 1 <= len(new_buckets) <= 2
    got = {r.normalized: (r.occurrences, r.raw, r.role) for r in versioned.read(spark, path).collect()}
    assert len(got) == 201 and got["+3"] == (6, "r1", "SUSPECT") and got["+500"] == (5, "r5", "SUSPECT") and got["+4"] == (1, "r1", "UNKNOWN")
    assert versioned.read(spark, path, 1).count() == 200  # readers of an earlier version keep it
    try:
        versioned._commit(spark, path, 2, {})
        raise AssertionError("a version was overwritten")
    except Exception as e:
        assert "exist" in str(e).lower()


def test_a_long_audit_log_takes_time_in_proportion(spark):
    """One case of 300,000 entries: quadratic copying would take minutes."""
    rows = spark.range(300_000).select(
        F.lit("c").alias("case_id"), F.col("id").alias("seq"), F.lit("t").alias("occurred_at"), F.lit("b").alias("officer_badge"), F.lit("a").alias("action"),
        F.lit(None).cast("string").alias("target_type"), F.lit(None).cast("string").alias("target_id"), F.sha2(F.col("id").cast("string"), 256).alias("payload_hash"),
    )
    began = time.perf_counter()
    got = integrity.heads(integrity.chained(rows)).first()
    assert time.perf_counter() - began < 60
    last = integrity.GENESIS
    for k in range(300_000):
        last = hashlib.sha256("\x1f".join([last, str(k), "t", "b", "a", "", "", hashlib.sha256(str(k).encode()).hexdigest()]).encode()).hexdigest()
    assert (got.head_seq, got.head_hash) == (299_999, last)


def test_similarity_against_the_dynamic_programme():
    def plain(a, b):
        a, b = (" ".join(sorted(x.split())) for x in (a, b))
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for k, y in enumerate(b):
                before, row[k + 1] = row[k + 1], before + 1 if x == y else max(row[k + 1], row[k])
        return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0

    rng = random.Random(2)
    texts = ["", "a", "debit account no", "x" * 200] + ["".join(rng.choice("abcde é1") for _ in range(rng.randrange(90))) for _ in range(150)]
    fields = [f.replace("_", " ") for f in CANONICAL_FIELDS] + ["", "abc de"]
    got = mapping.ratios(pd.Series(texts), fields)
    assert all(abs(got[i, k] - plain(t, f)) < 1e-9 for i, t in enumerate(texts) for k, f in enumerate(fields))
    assert mapping.token_ratio("number b", "b number") == 100.0


def test_formats_from_files(spark, tmp_path):
    import json

    import pytest

    from caseweave.sources import formats

    one = {"kind": "NEW", "detect": ["x"], "columns": {"caller": ["X No"]}, "dates": [], "required": ["caller"]}
    (tmp_path / "a.json").write_text(json.dumps(one))
    got = formats.load(spark, str(tmp_path), {"OLD": {}})
    assert set(got) == {"OLD", "NEW"} and got["NEW"]["columns"] == {"caller": ["X No"]}
    for wrong in ("[1]", '{"kind": "Z"}', json.dumps(one)):
        (tmp_path / "b.json").write_text(wrong)
        with pytest.raises(ValueError):
            formats.load(spark, str(tmp_path))
    (tmp_path / "b.json").write_text("{")
    with pytest.raises(ValueError):
        formats.load(spark, str(tmp_path))
