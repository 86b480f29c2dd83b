"""Near-duplicate embeddings by collision-counting projections.

Unit vectors are projected on many fixed random lines.  Two vectors of cosine 0.98 in d dimensions are 0.2 apart, so
on a line their distance is normal with deviation 0.2 / sqrt(d), whatever the data.

Candidates: every line is cut into windows at a random place.  A table takes some lines of its own, and two vectors
meet in it if they share the windows on all of them.  The number of lines of a table grows with the logarithm of the
vectors of the label, so that chance meetings stay few, and the number of tables is what the wanted recall takes.

Counting: of two vectors that meet, a window around each one's projection on further lines holds the other with known
probability, so the number of lines where it does is calibrated; pairs that pass the count are verified by their cosine
in double precision.  A pair counts in the first table where it meets.  Windows that very many vectors share are split
into blocks, and all block pairs are worked off, each in a task of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._store import ready, written
from ._text import mix64

#: Counting lines, half a window and the least count: half in deviations of a pair at the threshold; misses under 1e-4.
LINES, HALF_WINDOW, LEAST = 24, 2.0, 17
#: Width of a table's windows in such deviations, the share of pairs at the threshold that one keeps together
#: (1 - sqrt(2 / pi) / WIDTH), and by how much it thins out vectors without direction.
WIDTH, KEEPS, THINS = 6.0, 1 - math.sqrt(2 / math.pi) / 6.0, 2.95
#: Share of pairs at the threshold that meet in no table; closer pairs are missed less.
MISS = 1e-3
#: Vectors of a block, rows of one call, pairs at once.
BLOCK, CALL, PAIRS = 512, 20_000, 100_000


def lines(d: int, n: int, seed: int = 20) -> np.ndarray:
    """n fixed random unit directions in d dimensions, as columns; the first ones are the same for any n."""
    g = np.random.default_rng([seed, d]).standard_normal((n, d))
    return (g / np.linalg.norm(g, axis=1, keepdims=True)).T


def n_tables(k: int, miss: float = MISS) -> int:
    """Tables of k lines that leave a pair at the threshold apart with probability miss."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - KEEPS**k)))


_lines: dict[int, np.ndarray] = {}


def _project(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """Projections on the lines a to b - 1."""
    d = x.shape[1]
    if d not in _lines or _lines[d].shape[1] < b:
        _lines[d] = lines(d, b)
    return x @ _lines[d][:, a:b]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; dividing by the largest component first keeps the norm from over- or underflowing."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _table_keys(x: np.ndarray, k: int, apart: float) -> np.ndarray:
    """The windows' key of each row in each table of k lines."""
    t = n_tables(k)
    out = np.zeros((len(x), t), np.uint64)
    shift = (mix64(np.arange(1, t * k + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
    for s in range(0, len(x), 2000):
        cells = np.floor(_project(x[s : s + 2000], LINES, LINES + t * k) / (WIDTH * apart / math.sqrt(x.shape[1])) + shift).astype(np.int64).view(np.uint64).reshape(-1, t, k)
        key = np.zeros(cells.shape[:2], np.uint64)
        for j in range(k):
            key = mix64(key * np.uint64(0xD1342543DE82EF95) + cells[:, :, j] + np.uint64(1))
        out[s : s + 2000] = key
    return out


def nodes_of(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, label, node (name of the vector, null if it can link with nothing), d, x (its components' bytes)."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("e"), F.col(label).alias("label"))
    kinds = dict(rows.dtypes)
    arrow, plain = (pa.float32(), np.float32) if kinds["e"] == "array<float>" else (pa.float64(), np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.list_(arrow))
            sizes = np.asarray(column.value_lengths().fill_null(0))
            good = (sizes > 0) & ~np.asarray(batch.column(2).is_null())
            names: list = [None] * len(batch)
            rows: list = [None] * len(batch)
            for d in np.unique(sizes[good]):
                at = np.flatnonzero(good & (sizes == d))
                x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(plain) + plain(0)  # -0 is 0
                fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                at, x = at[fine], x[fine]
                bits = mix64(x.astype(np.float64).view(np.uint64) + np.arange(d, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
                other = mix64(bits ^ np.uint64(0x8EBC6AF09C88C6E3))
                key = np.stack([mix64(bits.sum(axis=1, dtype=np.uint64) + np.uint64(d)), mix64(other.sum(axis=1, dtype=np.uint64))], axis=1)
                for k, i in enumerate(at.tolist()):
                    names[i], rows[i] = key[k].tobytes(), x[k].tobytes()
            columns = [batch.column(0), batch.column(2), pa.array(names, pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "node", "d", "x"])

    ready(vectors.sparkSession)
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, node binary, d int, x binary")


def _plain(vectors: DataFrame, embedding: str):
    return np.float32 if dict(vectors.dtypes)[embedding] == "array<float>" else np.float64


def _keyed(groups: DataFrame, apart: float, plain) -> DataFrame:
    """(node, label, d, k, x) -> node, t, key: the windows of each vector in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, k = (batch.column(c).to_numpy() for c in (2, 3))
            keys: list = [None] * len(batch)
            for dd, kk in set(zip(d.tolist(), k.tolist(), strict=True)):
                at = np.flatnonzero((d == dd) & (k == kk))
                x = np.frombuffer(b"".join(batch.column(4).take(pa.array(at)).to_pylist()), plain).reshape(-1, dd)
                for i, row in zip(at.tolist(), _table_keys(_unit(x), kk, apart).view(np.int64), strict=True):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(keys, pa.list_(pa.int64()))], ["node", "label", "d", "keys"])

    made = groups.select("node", "label", "d", "k", "x").mapInArrow(run, f"node binary, label {dict(groups.dtypes)['label']}, d int, keys array<long>")
    made = made.select("node", "label", "d", F.posexplode("keys").alias("t", "key"))
    return made.select("node", "t", F.xxhash64("label", "d", "t", "key").alias("key"))


def n_lines(size: Column) -> Column:
    """Lines of a table for a label of that many vectors: enough that it leaves about one other to meet by chance."""
    return F.greatest(F.lit(1), F.ceil(F.log(F.greatest(size, F.lit(2)).cast("double")) / F.lit(math.log(THINS)))).cast("int")


def members(groups: DataFrame, apart: float, plain) -> DataFrame:
    """node, t, key, c: the windows that several vectors share, and how many do."""
    keyed = written(_keyed(groups, apart, plain), "vector-keys")
    several = keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    return keyed.join(several, "key")


def _near_pairs(bucket: np.ndarray, part: np.ndarray, whole: np.ndarray, p: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (u, v) of rows of one bucket that pass the count.

    Rows are sorted by bucket.  In a bucket that is a pair of blocks (not whole) only rows of different parts meet.
    """
    us, vs, held = [], [], 0
    found: list[tuple] = []

    def count() -> None:
        u, v = np.concatenate(us), np.concatenate(vs)
        for s in range(0, len(u), PAIRS):
            a, b = u[s : s + PAIRS], v[s : s + PAIRS]
            near = (np.abs(p[a] - p[b]) <= half).sum(axis=1) >= LEAST
            found.append((a[near], b[near]))

    at = np.arange(len(bucket) - 1)
    for step in range(1, len(bucket)):
        at = at[at + step < len(bucket)]
        at = at[bucket[at] == bucket[at + step]]
        if not len(at):
            break
        met = at[whole[at] | (part[at] != part[at + step])]
        us.append(met)
        vs.append(met + step)
        held += len(met)
        if held >= PAIRS:
            count()
            us, vs, held = [], [], 0
    if held:
        count()
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))


def _linked(cosine: float, plain):
    """Links inside the buckets of one call: per vector the copies it links with here, and one it is joined to."""
    apart = float(np.sqrt(2 - 2 * cosine))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("key", "ascending"), ("a", "ascending"), ("b", "ascending")])
        key, a, b, part, n, t, k = (table[c].to_numpy() for c in ("key", "a", "b", "part", "n", "t", "k"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        bucket = np.cumsum(new)
        x = _unit(np.frombuffer(b"".join(table["x"].to_pylist()), plain).reshape(len(key), -1))
        half = HALF_WINDOW * apart / np.sqrt(x.shape[1])
        u, v = _near_pairs(bucket, part, a == b, _project(x, 0, LINES).astype(np.float32), half)
        linked = np.zeros(len(u), bool)
        for s in range(0, len(u), 4096):
            linked[s : s + 4096] = np.einsum("ij,ij->i", x[u[s : s + 4096]], x[v[s : s + 4096]]) >= cosine
        u, v = u[linked], v[linked]
        # A pair that met in an earlier table was counted there.
        first = np.ones(len(u), bool)
        for kk in np.unique(k[u]).tolist():
            rows = np.unique(np.concatenate([u[k[u] == kk], v[k[u] == kk]]))
            made = _table_keys(x[rows], kk, apart)
            place = np.zeros(len(x), np.int64)
            place[rows] = np.arange(len(rows))
            own = np.flatnonzero(k[u] == kk)
            for s in range(0, len(own), 4096):
                i = own[s : s + 4096]
                same = made[place[u[i]]] == made[place[v[i]]]
                first[i] = same.argmax(axis=1) == t[u[i]]
        node = table["node"].combine_chunks()
        code = (node.chunk(0) if isinstance(node, pa.ChunkedArray) else node).dictionary_encode()
        name, index = code.dictionary, code.indices.to_numpy()
        links = np.bincount(index[u[first]], n[v[first]], len(name)) + np.bincount(index[v[first]], n[u[first]], len(name))
        root = np.arange(len(name))
        p, q = index[u], index[v]
        while True:
            low = np.minimum(root[p], root[q])
            before = root.copy()
            np.minimum.at(root, p, low)
            np.minimum.at(root, q, low)
            root = root[root]
            if (root == before).all():
                break
        hit = np.zeros(len(name), bool)
        hit[p] = hit[q] = True
        at = np.flatnonzero(hit)
        return pa.table({"node": name.take(pa.array(at)), "links": pa.array(np.rint(links[at]).astype(np.int64)), "root": name.take(pa.array(root[at]))})

    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept: links are pairs of equal label with cosine >= the threshold.

    Vectors that are null, empty, zero or hold null or non-finite components, and those of null label, link with
    nothing; vectors of different lengths do not link; equal vectors are linked.  An empty table gives an empty
    result; other columns are not read.
    """
    apart, plain = float(np.sqrt(2 - 2 * cosine)), _plain(vectors, embedding)
    named = written(nodes_of(vectors, vec_id, embedding, label), "vector-nodes")
    # The label belongs to the name: equal vectors of other labels are other nodes.
    named = named.withColumn("node", F.when(F.col("node").isNotNull(), F.concat(F.unhex(F.hex(F.xxhash64("label"))), "node")))
    groups = named.filter("node is not null").groupBy("label", "node").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("x").alias("x"), F.first("d").alias("d"))
    groups = written(groups, "vector-groups")
    sizes = groups.groupBy("label", "d").agg(F.count("*").alias("size"))
    groups = groups.join(sizes, ["label", "d"]).withColumn("k", n_lines(F.col("size")))
    met = members(groups, apart, plain).withColumn("parts", F.ceil(F.col("c") / BLOCK).cast("int"))
    dealt = met.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = written(dealt.select("key", "t", "node", "part", F.least("part", "with").alias("a"), F.greatest("part", "with").alias("b")), "vector-met")
    calls = max(1, -(-dealt.count() // CALL))
    rows = dealt.join(groups.select("node", "n", "x", "d", "k"), "node").withColumn("call", F.pmod(F.xxhash64("key", "a", "b"), F.lit(calls)).cast("int"))
    found = written(rows.groupBy("d", "call").applyInArrow(_linked(cosine, plain), "node binary, links long, root binary"), "vector-links")
    roots = components(found.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = groups.select("node", "n", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(least, "root").join(links, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    component = F.coalesce("component_id", "vec_id")
    return named.select("vec_id", "node").join(known, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )


def op10(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
