"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of half-keys (each a pair of minhashes) are computed per shingle set; the table keys are all
combinations of a half-key of the first with one of the second, so 100 keys need 40 minhashes.  Pairs of a bucket
are confirmed on the full sets.  At similarity 0.75 a pair shares a key with probability above 0.9994.

Sets that are equal are one node throughout.  Buckets are worked off without a cap: first each member against its
bucket's leader.  What this leaves apart is compared by half-key, as two sets that share a table key share a half-key:
in every half-key's bucket all members outside its largest confirmed component meet all members, in blocks of bounded
size that count exact intersections.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._components import components
from ._store import ready, written

SHINGLE = 5
#: Half-keys of each collection, and minhashes of each half-key.
HALF_KEYS, HASHES = 10, 2
#: Bits of two 128-bin sketches that must agree; two sets of similarity 0.75 have 112 in the mean, deviation under 4.
AGREE = 94
#: Sets of a block, and uses in a block pair from which a shingle's pairs are counted as a matrix product.
BLOCK, DENSE = 512, 12

_N = 2 * HALF_KEYS * HASHES
_XOR = _text.mix64(np.arange(1, _N + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_TIMES = _text.mix64(np.arange(1, _N + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)


def shingle_sets(words: _text.Words, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; the whole sequence is one when it has fewer than k words."""
    hashes = words.hashes()
    all_grams = _text.grams(hashes, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(all_grams[a : b - k + 1]))
        else:
            out.append(_text.grams(hashes[a:b], b - a)[:1] if b > a else np.zeros(0, np.uint64))
    return out


def _names(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A 128-bit name of each non-empty set flat[starts[i]:starts[i] + sizes[i]]."""
    name = np.zeros((len(starts), 2), np.uint64)
    if len(starts):
        for k in range(2):
            name[:, k] = _text.mix64(np.add.reduceat(_text.mix64(flat + _XOR[k]), starts) + sizes.astype(np.uint64))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(starts), [None, pa.py_buffer(name.tobytes())]).cast(pa.binary())


def _sketch(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    sizes = np.array([len(s) for s in sets], np.int64)
    full = sizes > 0
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = (np.cumsum(sizes) - sizes)[full]
    n = int(full.sum())
    low = np.zeros((n, _N), np.uint64)
    bits = np.zeros((n, 2), np.uint64)
    if n:
        for k in range(_N):
            low[:, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _TIMES[k], starts)
        # Sorted hashes: the first of each of 128 bins by the top bits is the bin's minimum; it gives one bit.
        own = np.repeat(np.arange(n), sizes[full])
        place = own * 128 + (flat >> np.uint64(57)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        bit = _text.mix64(flat[first]) & np.uint64(1)
        at = place[first]
        np.add.at(bits, (at // 128, at % 128 // 64), bit << (at % 64).astype(np.uint64))
    halves = np.zeros((n, 2 * HALF_KEYS), np.uint64)
    for k in range(2 * HALF_KEYS):
        own_key = np.full(n, k + 1, np.uint64)
        for t in range(HASHES):
            own_key = _text.mix64(own_key * np.uint64(0x9E3779B97F4A7C15) + low[:, k * HASHES + t])
        halves[:, k] = own_key
    rank = np.cumsum(full) - 1

    def spread(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.array(values, kind).take(pa.array(np.where(full, rank, 0), mask=~full))

    keys = pa.FixedSizeListArray.from_arrays(pa.array(halves.reshape(-1).view(np.int64)), 2 * HALF_KEYS).cast(pa.list_(pa.int64()))
    names = _names(flat, starts, sizes[full])
    take = pa.array(np.where(full, rank, 0), mask=~full)
    return {
        "n_shingles": pa.array(sizes),
        "node": names.take(take),
        "halves": keys.take(take),
        "s1": spread(bits[:, 0].view(np.int64), pa.int64()),
        "s2": spread(bits[:, 1].view(np.int64), pa.int64()),
    }


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, node (name of the set), halves (half-keys of both collections), s1, s2 (bit sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in _text.slices(batch, "text"):
                columns = _sketch(shingle_sets(_text.split(data, offsets)))
                yield pa.RecordBatch.from_arrays([rows.column(0), *columns.values()], ["doc_id", *columns])

    ready(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, node binary, halves array<long>, s1 long, s2 long")


def _sets(rows: DataFrame) -> DataFrame:
    """(text) -> (node, n, hashes), without texts that have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in _text.slices(batch, "text"):
                sets = [s for s in shingle_sets(_text.split(data, offsets)) if len(s)]
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate([np.zeros(0, np.uint64), *sets])
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([_names(flat, ends[:-1], sizes), pa.array(sizes), hashes], ["node", "n", "hashes"])

    return rows.mapInArrow(run, "node binary, n long, hashes array<long>")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(node, n, halves, s1, s2) -> (key, node, n, s1, s2): the members of all table keys that at least two nodes have.

    Only half-keys that some other node shares are combined: no other combination can be shared.
    """
    half = nodes.select("node", F.posexplode("halves").alias("i", "half"))
    shared = half.groupBy("i", "half").agg(F.count("*").alias("c")).filter("c > 1").select("i", "half")
    own = half.join(shared, ["i", "half"]).groupBy("node").agg(F.collect_list(F.struct("i", "half")).alias("h"))
    us, vs = F.filter("h", lambda x: x["i"] < HALF_KEYS), F.filter("h", lambda x: x["i"] >= HALF_KEYS)
    own = own.select("node", us.alias("us"), vs.alias("vs")).filter("size(us) > 0 and size(vs) > 0")
    keyed = own.select("node", "vs", F.explode("us").alias("x")).select("node", "x", F.explode("vs").alias("y"))
    keyed = keyed.select("node", F.xxhash64("x.i", "x.half", "y.i", "y.half").alias("key"))
    several = keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    return keyed.join(several, "key").join(nodes.select("node", "n", "s1", "s2"), "node")


def _may_link(a: str, b: str):
    """Sizes that allow similarity 0.75, and bit sketches that agree as similar sets' do.

    m is how much of a set any other set has; an intersection is no larger than either m, and similarity 0.75 takes
    3 / 7 of both sizes together.
    """
    both = (F.col(f"{a}.n") + F.col(f"{b}.n")) * 3
    size = (F.col(f"{a}.m") * 7 >= both) & (F.col(f"{b}.m") * 7 >= both)
    differ = F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) + F.bit_count(F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2")))
    return size & (differ <= 128 - AGREE)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of (a, b) whose full sets have 100 * intersection >= percent * union, as (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.asarray(h.values).view(np.uint64) for h in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                common = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["u", "v"])

    a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.distinct().join(b, "b").join(a, "a").select("a", "b", "x", "y").mapInArrow(run, "u binary, v binary")


def links(sketched: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """Confirmed links (u, v) between nodes: enough of them that components are those of all links found."""
    nodes = sketched.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("halves", "s1", "s2")], F.first("n_shingles").alias("n"))
    buckets = written(_buckets(nodes), "minhash-buckets")
    # One text for each node in a bucket; its set is made anew from the whole text.
    able = buckets.select("node").distinct()
    wanted = able.join(nodes, "node").select("doc_id")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(wanted, "doc_id", "left_semi")
    sets = written(_sets(texts.select("text")).join(able, "node", "left_semi"), "minhash-sets")
    # A shingle that no other set here has is in no intersection: with over a quarter of such, a set has no link.
    lone = sets.select("node", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.first("node").alias("node")).filter("c = 1")
    lone = lone.groupBy("node").agg(F.count("*").alias("lone"))
    able = sets.select("node", "n").distinct().join(lone, "node", "left").select("node", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("m"), "n")
    able = written(able.filter("4 * m >= 3 * n").drop("n"), "minhash-able")
    sets = sets.join(able, "node", "left_semi")
    members = written(buckets.join(able, "node"), "minhash-members")

    leader = members.groupBy("key").agg(F.min_by(F.struct("node", "n", "m", "s1", "s2"), "node").alias("l"), F.count("*").alias("c")).filter("c > 1")
    stars = members.alias("m").join(leader, "key").filter("m.node <> l.node").filter(_may_link("m", "l"))
    first = written(_confirmed(stars.select(F.col("l.node").alias("a"), F.col("m.node").alias("b")), sets, percent), "minhash-stars")

    roots = components(first)
    halves = able.join(nodes, "node").select("node", F.posexplode(F.slice("halves", 1, HALF_KEYS)).alias("i", "half"))
    placed = halves.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per = placed.groupBy("i", "half", "root").agg(F.count("*").alias("c")).groupBy("i", "half")
    per = per.agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all"), F.count("*").alias("roots")).filter("roots > 1")
    # Blocks 0 to k - 1 hold the bucket's minor components, the others its main one; a pair of blocks has a minor one.
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    per = per.withColumn("minor", F.col("all") - F.col("most")).withColumn("k", blocks("minor")).withColumn("z", F.col("k") + blocks("most"))
    deal = F.xxhash64("node", F.lit(2))
    open_ = placed.join(per, ["i", "half"]).withColumn("at", F.when(F.col("root") == F.col("main"), F.col("k") + F.pmod(deal, F.col("z") - F.col("k"))).otherwise(F.pmod(deal, F.col("k"))).cast("int"))
    partners = F.sequence(F.lit(0), F.when(F.col("at") < F.col("k"), F.col("z") - 1).otherwise(F.col("k") - 1))
    open_ = open_.withColumn("with", F.explode(partners)).select("i", "half", F.least("at", "with").alias("a"), F.greatest("at", "with").alias("b"), "node", "root")
    dealt = open_.join(sets.dropDuplicates(["node"]), "node")
    more = dealt.groupBy("i", "half", "a", "b").applyInArrow(_block(percent), "u binary, v binary")
    return first.unionByName(written(more, "minhash-rest"))


def _overlaps(row: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """Exact intersection sizes of n sets given as (row, shingle) pairs; the diagonal is not used."""
    order = np.argsort(shingle, kind="stable")
    row, shingle = row[order], shingle[order]
    start = np.flatnonzero(np.diff(shingle, prepend=shingle[:1] ^ np.uint64(1)))
    uses = np.diff(np.append(start, len(shingle)))
    counts = np.zeros(n * n, np.float32)
    for d in range(2, DENSE):
        own = row[start[uses == d][:, None] + np.arange(d)]
        if len(own):
            counts += np.bincount((own[:, :, None] * n + own[:, None, :]).ravel(), minlength=n * n)
    counts = counts.reshape(n, n)
    many = np.flatnonzero(uses >= DENSE)
    for k in range(0, len(many), 2048):
        part = many[k : k + 2048]
        has = np.zeros((n, len(part)), np.float32)
        has[row[_text.ranges(start[part], uses[part])], np.repeat(np.arange(len(part)), uses[part])] = 1
        counts += has @ has.T
    return counts


def _block(percent: int):
    """Of the links between sets of different roots in a pair of blocks, as many as join all that they join."""

    def run(table: pa.Table) -> pa.Table:
        names, roots = table["node"].to_pylist(), table["root"].to_pylist()
        lists = table["hashes"].combine_chunks()
        sizes = np.asarray(lists.value_lengths()).astype(np.int64)
        n = len(names)
        both = _overlaps(np.repeat(np.arange(n), sizes), np.asarray(lists.flatten()).view(np.uint64), n)
        _, group = np.unique(np.array(roots, object), return_inverse=True)
        union = sizes[:, None] + sizes[None, :] - both
        linked = (100 * both >= percent * union) & (group[:, None] != group[None, :])
        x, y = np.nonzero(np.triu(linked, 1))
        root = list(range(n))
        keep = []
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            a, b = p, q
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            if a != b:
                root[a] = b
                keep.append((names[p], names[q]))
        return pa.table({"u": pa.array([k[0] for k in keep], pa.binary()), "v": pa.array([k[1] for k in keep], pa.binary())})

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), kept, n_copies.

    Null, empty and wordless texts have no shingles, link with nothing and are kept; equal sets are linked; of
    repeated rows of one doc_id all have the same class.  For a null doc_id kept is null, and a set that only such rows
    have links with no other.  An empty table gives an empty result; other columns of
    docs are not read.
    """
    sketched = written(sketches(docs, doc_id, text), "minhash-sketches")
    roots = components(links(sketched, docs, doc_id, text, percent))
    nodes = sketched.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("node", "component_id", "n_copies")
    own = sketched.select("doc_id", "n_shingles", "node").join(classes, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return own.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The rows of docs of which each class of near-duplicates keeps its smallest doc_id."""
    kept = near_duplicates(docs, doc_id, text, percent).filter("kept or doc_id is null").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, docs[doc_id].eqNullSafe(kept["__id"]), "left_semi")


def op2(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
