"""Merkle manifest of a dataset: a digest for each row, a tree over each group of rows, a tree over the groups.

Every level is a table of nodes; a node finds its siblings by equijoins with computed indices (index XOR 1 in binary
trees, slot offsets in wider ones), and the rows of slot zero emit the parents.  Paths of siblings then come down from
the root: a level's nodes join their parents' paths, so all levels together move as many paths as twice the rows.
DataFrame functions only; the number of rounds is the logarithm of the largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._ranks import placed
from ._store import written

#: Levels of paths that one job joins before it writes.
STEP = 8


def field(value: Column) -> Column:
    """`-` for null, else the value's bytes in UTF-8, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """The digest of a row: lowercase hex SHA-256 of its fields in this order."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path of siblings lead to."""
    return F.aggregate(path, digest, lambda own, step: F.sha2(F.concat(_hex(step["left"]), own, _hex(step["right"])), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf's level to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(_hex(step["left"]), _hex(step["right"]))), ""), 256)


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (__group, __index, __n, __digest, ...) with the digests of the siblings to the left and to the right."""
    slot = F.col("__index") % arity
    sides = []
    for k in range(1, arity):
        # The sibling k slots on, around the run; XOR where a run has two slots.
        away = F.col("__index").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("__index") - slot + (slot + (arity - k)) % arity
        twin = nodes.select(F.col("__group").alias("__g"), away.alias("__i"), F.unhex("__digest").alias(f"__twin{k}"))
        nodes = nodes.join(twin, (F.col("__group") == F.col("__g")) & (F.col("__index") == F.col("__i")), "left").drop("__g", "__i")
        sides.append((F.col(f"__twin{k}"), slot + k >= arity))
    none = F.lit(b"")
    left = F.concat(*[F.coalesce(F.when(before, twin), none) for twin, before in sides])
    right = F.concat(*[F.coalesce(F.when(~before, twin), none) for twin, before in sides])
    return nodes.withColumns({"__left": left, "__right": right}).drop(*[f"__twin{k}" for k in range(1, arity)])


def _climb(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """Tables of all levels, from the leaves to one node a group; a group that is done stays as it is."""
    widest = nodes.agg(F.max("__n")).first()[0] or 1
    levels = []
    while widest > 1:
        nodes = written(_with_siblings(nodes, arity), "merkle-level")
        levels.append(nodes)
        many = F.col("__n") > 1
        above = F.sha2(F.concat(_hex(F.col("__left")), "__digest", _hex(F.col("__right"))), 256)
        nodes = nodes.filter(F.col("__index") % arity == 0).select(
            "__group",
            F.floor(F.col("__index") / arity).alias("__index"),
            F.ceil(F.col("__n") / arity).alias("__n"),
            F.when(many, above).otherwise(F.col("__digest")).alias("__digest"),
        )
        widest = -(-widest // arity)
    return [*levels, written(nodes, "merkle-level")]


def _descend(levels: list[DataFrame], top: DataFrame, arity: int) -> DataFrame:
    """The leaves with the columns of top (__group, __path, ...), their own siblings before those of top."""
    others = [c for c in top.columns if c not in ("__group", "__path")]
    paths = top.withColumn("__index", F.lit(0).cast("long"))
    for k, level in reversed(list(enumerate(levels))):
        above = paths.select(F.col("__group").alias("__g"), F.col("__index").alias("__i"), F.col("__path").alias("__above"), *others)
        joined = level.join(above, (F.col("__group") == F.col("__g")) & (F.floor(F.col("__index") / arity) == F.col("__i"))).drop("__g", "__i")
        step = F.struct(F.col("__left").alias("left"), F.col("__right").alias("right"))
        path = F.when(F.col("__n") > 1, F.concat(F.array(step), "__above")).otherwise(F.col("__above"))
        paths = joined.withColumn("__path", path).drop("__above", "__left", "__right")
        if k and k % STEP == 0:
            paths = written(paths, "merkle-paths")
    return paths


def tree(leaves: DataFrame, group: str, order: str, digest: str = "leaf", arity: int = 2) -> DataFrame:
    """leaves with subroot (of the group's tree), root (of the tree over groups) and path (of siblings, leaf first).

    In a group leaves ascend by order, nulls first, equal ones by digest; groups ascend bytewise, null first.  While a
    level has several nodes, every run of arity consecutive ones (the last may have fewer, even one) becomes the
    digest of their digests' hex text.  Repeated rows are leaves each; an empty table gives an empty manifest; columns
    of leaves other than subroot, root and path stay, whatever their names.
    """
    own = leaves.withColumn("__group", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))).withColumn("__digest", F.col(digest))
    nodes = placed(own, [F.col(order).asc_nulls_first(), F.col(digest)], ["__group"]).withColumnRenamed("__place", "__index")
    levels = _climb(written(nodes, "merkle-leaves"), arity)
    groups = levels[-1].select(F.lit("").alias("__group"), F.col("__group").alias("__name"), "__digest")
    groups = placed(groups, [F.col("__name")], ["__group"]).withColumnRenamed("__place", "__index")
    above = _climb(written(groups, "merkle-groups"), arity)
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    root = above[-1].select("__group", none.alias("__path"), F.col("__digest").alias("__root"))
    # A tree of one level has no level below its top, which is then the table of leaves itself.
    paths = _descend(above[:-1] or [_leaf_level(groups)], root, arity)
    tops = written(paths.select(F.col("__name").alias("__group"), F.col("__digest").alias("__subroot"), "__root", "__path"), "merkle-groups")
    found = _descend(levels[:-1] or [_leaf_level(nodes)], tops, arity)
    kept = [c for c in leaves.columns if c not in ("subroot", "root", "path")]
    return found.select(*kept, F.col("__subroot").alias("subroot"), F.col("__root").alias("root"), F.col("__path").alias("path"))


def _leaf_level(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"__left": F.lit(b""), "__right": F.lit(b"")})


#: The fields of a document's leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op12(spark, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest, and whether its leaf, tampered with or not, still leads to the root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = leaf([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    both = docs.select("doc_id", "lang", leaf([F.col(c) for c in FIELDS]).alias("leaf"), F.when(hit, changed).alias("changed"))
    found = tree(written(both, "merkle-documents"), "lang", "doc_id")
    found = found.withColumns({"proof_sha256": proof(F.col("path")), "folded_root": fold(F.coalesce("changed", "leaf"), F.col("path"))})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP12_SQL = """
WITH RECURSIVE
bits AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
own AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g,
         CASE WHEN xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
                                   lambda c, b: xor(c >> 8, bits.t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS hit,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail, n_chars
  FROM documents, bits),
leaves AS (
  SELECT doc_id, g, hit, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS changed
  FROM own),
spots AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
up AS (
  SELECT g, 0 AS level, i, n, leaf AS digest FROM spots
  UNION ALL
  SELECT g, level + 1, i // 2, (n + 1) // 2, sha256(digest || coalesce(next, ''))
  FROM (SELECT *, lead(digest) OVER (PARTITION BY g ORDER BY i) AS next FROM up WHERE n > 1) WHERE i % 2 = 0),
subroots AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS j, count(*) OVER () AS m FROM up WHERE n = 1),
over AS (
  SELECT 0 AS level, j AS i, m AS n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(digest || coalesce(next, ''))
  FROM (SELECT *, lead(digest) OVER (ORDER BY i) AS next FROM over WHERE n > 1) WHERE i % 2 = 0),
walk AS (
  SELECT s.doc_id, s.g, 0 AS stage, 0 AS level, s.i, s.n, CASE WHEN hit = 1 THEN changed ELSE leaf END AS acc, '' AS proof, s.leaf FROM spots s
  UNION ALL
  SELECT w.doc_id, w.g, CASE WHEN w.n > 1 THEN w.stage ELSE 1 END, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END,
         CASE WHEN w.n > 1 THEN w.i // 2 ELSE r.j END, CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE r.m END,
         CASE WHEN w.n = 1 THEN w.acc
              WHEN w.i % 2 = 1 THEN sha256(coalesce(a.digest, b.digest) || w.acc)
              ELSE sha256(w.acc || coalesce(a.digest, b.digest, '')) END,
         CASE WHEN w.n = 1 THEN w.proof ELSE w.proof || coalesce(a.digest, b.digest, '') END, w.leaf
  FROM walk w
  LEFT JOIN up a ON w.stage = 0 AND w.n > 1 AND a.g = w.g AND a.level = w.level AND a.i = xor(w.i, 1)
  LEFT JOIN over b ON w.stage = 1 AND w.n > 1 AND b.level = w.level AND b.i = xor(w.i, 1)
  LEFT JOIN subroots r ON r.g = w.g
  WHERE w.n > 1 OR w.stage = 0)
SELECT w.doc_id, w.leaf, r.subroot, o.digest AS root, sha256(w.proof) AS proof_sha256, w.acc AS folded_root, w.acc = o.digest AS verified
FROM walk w JOIN subroots r ON r.g = w.g JOIN over o ON o.n = 1
WHERE w.stage = 1 AND w.n = 1
"""
