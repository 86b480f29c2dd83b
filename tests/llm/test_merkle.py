"""Manifests against a plain recursion, and on odd rows."""

import hashlib
import random
import zlib

import duckdb
import pytest

from caseweave.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf0 string, k string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])])


def brute(items, m):
    """(root, siblings of each item by level as (left, right)) of a list of digests."""
    paths, level, where = [[] for _ in items], list(items), list(range(len(items)))
    while len(level) > 1:
        for k, at in enumerate(where):
            run, slot = level[at // m * m : at // m * m + m], at % m
            paths[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            where[k] = at // m
        level = [h(*level[k : k + m]) for k in range(0, len(level), m)]
    return level[0], paths


@pytest.mark.parametrize("arity,n", [(2, 57), (3, 40), (5, 26), (2, 1)])
def test_tree_against_brute_force(spark, arity, n):
    rng = random.Random(arity)
    langs = [None, "a", "ä", "b"] if n > 1 else ["a"]
    rows = [(k, f"t{k}", rng.choice(langs[:2] if k % 3 else langs), rng.choice([None, "s"]), rng.choice([None, k]), "x", "y") for k in range(n)]
    if n > 1:
        rows += [(None, None, None, None, None, None, None), (900, "é" * 70000, "lone", "", 0, "x", "y"), rows[3], rows[3]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.withColumn("leaf", merkle.leaf([df[c] for c in merkle.FIELDS]))
    out = merkle.tree(df, "lang", "doc_id", arity=arity)
    got = out.withColumns({"proof": merkle.proof(out["path"]), "again": merkle.fold(out["leaf"], out["path"])}).collect()
    assert out.columns == [*df.columns, "subroot", "root", "path"] and len(got) == len(rows)
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))):
        groups.setdefault(r[2], []).append(leaf_of(r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute(groups[g], arity) for g in names}
    root, tops = brute([trees[g][0] for g in names], arity)
    want = []
    for g, top in zip(names, tops, strict=True):
        for own, path in zip(groups[g], trees[g][1], strict=True):
            want.append((own, trees[g][0], root, h(*[s for pair in path + top for s in pair])))
    assert sorted((r.leaf, r.subroot, r.root, r.proof) for r in got) == sorted(want)
    assert all(r.again == r.root for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    df = df.withColumn("leaf", merkle.leaf([df[c] for c in merkle.FIELDS]))
    assert merkle.tree(df, "lang", "doc_id").count() == 0


def test_query(spark, tmp_path):
    """Tampered rows fail where a number changed; the SQL form agrees, nulls and odd texts included."""
    rows = [(k, None if k % 11 == 0 else f"x é {k}\n" * (k % 7), [None, "en", "de"][k % 3], [None, "a"][k % 2], None if k % 5 == 0 else k, "x", "y") for k in range(80)]
    (tmp_path / "d").mkdir()
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "d/documents.parquet"))
    got = merkle.op12(spark, str(tmp_path / "d")).collect()
    by = {r.doc_id: r for r in got}
    for r in rows:
        hit = zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
        assert by[r[0]].verified == (not hit) and (by[r[0]].folded_root == by[r[0]].root) == (not hit)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/documents.parquet/*.parquet'")
    want = con.sql(merkle.OP12_SQL)
    assert sorted(map(tuple, got)) == sorted(tuple(r[want.columns.index(c)] for c in got[0].__fields__) for r in want.fetchall())
