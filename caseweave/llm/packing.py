"""Best-fit packing of documents into token sequences.

Bulk-synchronous best-fit.  Documents (their pieces) and the gaps of open sequences are sorted by size.  A sweep matches
all documents with the gaps at once: each takes its successor, the smallest gap that holds it; conflicts are resolved
by rank, larger documents first; then the gaps shrink and the next sweep follows, until every document has a place.
A size is an integer of at most `capacity`, so the sweeps, windows over runs of equal documents and equal gaps, work
on some thousand rows at any corpus size; Spark ranks the pieces inside their runs and deals the intervals to them.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import written

CAPACITY = 2048
#: Pieces in a range of the hash, when equal lengths are ranked.
RANGE_ROWS = 200_000


class Encoder:
    """Token ids (little-endian unsigned 32-bit) of a text, by a vocabulary of the tokenizers library.

    Merges use the rank file of the same vocabulary, at twice the library's speed; a text with a special token's
    string, or with a run of white space too long for the rank file's pattern, goes to the library itself.  Nothing is
    remembered between texts.
    """

    #: Characters of white space in one run from which the library encodes; the pattern fails from about a million on.
    LONG_RUN = 100_000

    def __init__(self, json_path: str, rank_path: str, pattern: str):
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_path, "rb") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.json_path, self.library = json_path, None
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        blank = len(text) >= self.LONG_RUN and any(m.end() - m.start() >= self.LONG_RUN for m in re.finditer(r"\s+", text))
        if blank or any(s in text for s in self.special):
            if self.library is None:  # few texts need it, and it takes much memory
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.json_path)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(array("I", self.encode(text)), "<u4").tobytes()


_encoders: dict[tuple, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The vocabulary's encoder, made once per Python worker."""
    if vocabulary not in _encoders:
        import public_tokenizers as P

        _encoders[vocabulary] = Encoder(P.path(f"{vocabulary}.json"), P.path(f"{vocabulary}.tiktoken"), P.PATTERN)
    return _encoders[vocabulary]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and the end id; only one longer than capacity is cut, the first piece taking the rest.
    Null and empty texts give the end id alone.
    """
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(value.as_py() or "") + tail
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[4 * a : 4 * b]
                    for column, x in zip(out, (key, k, a, b - a, zlib.crc32(own), own), strict=True):
                        column.append(x)
                if with_ids and len(out[0]) >= 2000:
                    yield table(batch, out)
                    out = [[], [], [], [], [], []]
            yield table(batch, out)

    def table(batch: pa.RecordBatch, out: list[list]) -> pa.RecordBatch:
        kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns[: 5 + with_ids], names[: 5 + with_ids])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def _sweep(docs: DataFrame, gaps: DataFrame, top: int, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One sweep of docs (length, rank, n) over gaps (gap, first, n): (docs left, gaps left, steps).

    A row is a run of equals.  A gap of several times the largest document counts as so many slots.  Larger documents
    go first: a document is placed if the slots that hold it outnumber the larger documents placed.  In rising order
    each takes its successor, the smallest slot that holds it; where several have one successor, their rank among the
    placed moves them on to the next slots.
    """
    order = lambda *c: Window.orderBy(*c).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    layers = F.greatest(F.floor(F.col("gap") / top), F.lit(1)).cast("int")
    slots = gaps.select("*", layers.alias("layers")).select("*", F.explode(F.sequence(F.lit(0), F.col("layers") - 1)).alias("layer"))
    slots = slots.select(F.floor(F.col("gap") / F.col("layers")).alias("length"), F.lit(None).cast("long").alias("rank"), "n", F.lit(0).alias("doc"), "first", "layer")
    rows = docs.select("length", "rank", "n", F.lit(1).alias("doc"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("int").alias("layer")).unionByName(slots)
    falling, rising = [F.desc("length"), "doc"], ["length", F.desc("doc"), "first", "layer"]
    of = lambda doc, c: F.when(F.col("doc") == doc, F.col(c)).otherwise(F.lit(0))
    rows = rows.withColumn("over", F.sum(of(0, "n") - of(1, "n")).over(order(*falling)))
    rows = rows.withColumn("low", F.least(F.lit(0), F.min("over").over(order(*falling))))
    rows = rows.withColumn("m", of(1, "n") - F.when(F.col("doc") == 1, F.coalesce(F.lag("low").over(Window.orderBy(*falling)), F.lit(0)) - F.col("low")).otherwise(F.lit(0)))
    # Smaller slots and placed documents below each row; where the placed begin among the slots.
    rows = rows.withColumn("below", F.sum(of(0, "n")).over(order(*rising)) - of(0, "n")).withColumn("i", F.sum("m").over(order(*rising)) - F.col("m"))
    rows = rows.withColumn("j", F.col("i") + F.max(F.when(F.col("m") > 0, F.col("below") - F.col("i"))).over(order(*rising)))
    rows = written(rows.drop("over", "low", "i"), "pack-placed")
    who = F.struct("length", "rank", "j", (F.col("j") + F.col("m")).alias("end"))
    where = F.struct("first", F.col("below").alias("at"), "layer")
    mark = lambda p, d, s: F.struct(p.alias("p"), F.when(F.lit(d), who).alias("who"), F.when(F.lit(s), where).alias("where"))
    marks = F.when(F.col("doc") == 0, F.array(mark(F.col("below"), False, True))).otherwise(F.array(mark(F.col("j"), True, False), mark(F.col("j") + F.col("m"), False, False)))
    marks = rows.filter("doc = 0 or m > 0").select(F.explode(marks).alias("x")).select("x.*").groupBy("p").agg(F.max("who").alias("who"), F.max("where").alias("where"))
    cut = marks.select("p", F.last("who", True).over(order("p")).alias("d"), F.last("where", True).over(order("p")).alias("s"), F.lead("p").over(Window.orderBy("p")).alias("q"))
    cut = cut.filter("q is not null and d.end > p")
    steps = cut.select(
        F.col("d.length").alias("length"),
        (F.col("d.rank") + F.col("p") - F.col("d.j")).alias("rank"),
        (F.col("q") - F.col("p")).alias("n"),
        (F.col("s.first") + F.col("p") - F.col("s.at")).alias("sequence"),
        (F.lit(turn << 12) + F.col("s.layer")).cast("long").alias("turn"),
        F.col("s.first").alias("run"),
    )
    left = rows.filter("doc = 1 and m < n").select("length", (F.col("rank") + F.col("m")).alias("rank"), (F.col("n") - F.col("m")).alias("n"))
    change = lambda df, run, x, n, by: df.select(F.col(run).alias("run"), F.explode(F.array(F.struct(F.col(x).alias("x"), by.alias("g")), F.struct((F.col(x) + F.col(n)).alias("x"), (-by).alias("g")))).alias("e"))
    edges = change(gaps, "first", "first", "n", F.col("gap")).unionByName(change(steps, "run", "sequence", "n", -F.col("length")))
    edges = edges.groupBy("run", "e.x").agg(F.sum("e.g").alias("g"))
    along = Window.partitionBy("run").orderBy("x")
    rest = edges.select("x", F.sum("g").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("gap"), F.lead("x").over(along).alias("z"))
    rest = rest.filter("z is not null and gap > 0").select("gap", F.col("x").alias("first"), (F.col("z") - F.col("x")).alias("n"))
    return left, rest, steps.drop("run")


def sweeps(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sizes (length, n) -> steps (length, rank, n, sequence, turn): the pieces of that length with these n ranks go, one
    each, to as many consecutive sequences; inside a sequence they stand in the order of turn.

    Bulk-synchronous rounds of _sweep.  Before each, the documents that no gap holds and that have over half the largest
    one's size open as many sequences as they need at least, by their tokens and by how many cannot share one.  Runs are tables of a few thousand rows at any corpus size.
    """
    spark = sizes.sparkSession
    kinds = {"doc": ["length", "rank", "n"], "gap": ["gap", "first", "n"], "step": ["length", "rank", "n", "sequence", "turn"]}
    fields = [f"c{k}" for k in range(5)]

    def saved(**parts: DataFrame) -> dict[str, DataFrame]:
        """The tables, written as one."""
        rows = [df.select(F.lit(kind).alias("kind"), *[(F.col(kinds[kind][k]) if k < len(kinds[kind]) else F.lit(0)).cast("long").alias(f) for k, f in enumerate(fields)]) for kind, df in parts.items()]
        table = written(reduce(DataFrame.unionByName, rows).coalesce(1), "pack-round")
        return {kind: table.filter(F.col("kind") == kind).select(*[F.col(f).alias(n) for f, n in zip(fields, kinds[kind], strict=False)]) for kind in parts} | {"all": table}

    state = saved(doc=sizes.select("length", F.lit(0).alias("rank"), "n"))
    state["gap"] = spark.createDataFrame([], "gap long, first long, n long")
    steps, sequences, turn = [], 0, 0
    while True:
        facts = state["all"].agg(F.max(F.when(F.col("kind") == "doc", F.col("c0"))).alias("top"), F.min(F.when(F.col("kind") == "doc", F.col("c0"))).alias("least"), F.max(F.when(F.col("kind") == "gap", F.col("c0"))).alias("room")).first()
        if facts["top"] is None:
            break
        top, room = facts["top"], facts["room"] or 0
        gaps = state["gap"].filter(F.col("gap") >= facts["least"])
        if top > room:
            unfit = state["doc"].filter((F.col("length") > room) & (2 * F.col("length") > top))
            need = unfit.agg(F.sum(F.col("n") * F.col("length")).alias("tokens"), F.sum(F.when(2 * F.col("length") > capacity, F.col("n"))).alias("alone")).first()
            opened = max(-(-need["tokens"] // capacity), need["alone"] or 0)
            gaps = gaps.unionByName(spark.range(1).select(F.lit(capacity).cast("long").alias("gap"), F.lit(sequences).cast("long").alias("first"), F.lit(opened).cast("long").alias("n")))
            sequences += opened
        left, rest, made = _sweep(state["doc"], gaps, top, turn)
        state = saved(doc=left, gap=rest, step=made)
        steps.append(state["step"])
        turn += 1
    return reduce(DataFrame.unionByName, steps, spark.createDataFrame([], "length long, rank long, n long, sequence long, turn long"))


def _ranked(cut: DataFrame) -> DataFrame:
    """The pieces with their rank among those of equal length."""
    # Rank among equals without gathering them in one task: each length's hashes are cut into ranges, whose sizes add up.
    # Ranges follow the hash, so the order of the rows is the same however many there are.
    ranges = max(16, cut.count() // RANGE_ROWS)
    hashed = cut.withColumn("h", F.xxhash64("doc_id", "piece"))
    dealt = hashed.withColumn("bucket", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * ranges))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = Window.partitionBy("length", "bucket").orderBy("h", "doc_id", "piece")
    ranked = dealt.withColumn("rank", F.row_number().over(place)).join(base, ["length", "bucket"])
    return ranked.select(*cut.columns, (F.col("base") + F.col("rank") - 1).alias("rank"))


def pack(docs: DataFrame, capacity: int = CAPACITY, **how) -> DataFrame:
    """Pieces of docs with sequence_id and offset, in as few sequences of at most capacity tokens as best-fit needs.

    Null and empty texts are packed as the end id alone, repeated rows once each; ties between equal lengths go by
    a hash of doc_id and piece, whatever the number of pieces.  An empty table gives an empty result; other columns of docs are not read.
    """
    cut = written(pieces(docs, capacity=capacity, **how), "pack-pieces")
    steps = sweeps(cut.groupBy("length").agg(F.count("*").alias("n")), capacity).orderBy("length", "rank").toArrow()  # runs, not pieces
    plan = np.stack([steps[c].to_numpy() for c in ("length", "rank", "sequence", "turn")], axis=1).astype(np.int64).reshape(-1, 4)
    share = docs.sparkSession.sparkContext.broadcast(plan)

    ranked = _ranked(cut)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = share.value
        key = p[:, 0] << 40 | p[:, 1]
        for b in batches:
            rank = b.column(b.schema.get_field_index("rank")).to_numpy()
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            step = np.searchsorted(key, length << 40 | rank, "right") - 1
            names = [n for n in b.schema.names if n != "rank"]
            own = [b.column(b.schema.get_field_index(n)) for n in names]
            at = p[step] if len(step) else np.zeros((0, 4), np.int64)
            more = [pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3])]
            yield pa.RecordBatch.from_arrays(own + more, [*names, "sequence_id", "turn"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    placed = ranked.mapInArrow(deal, f"{fields}, sequence_id long, turn long")
    so_far = Window.partitionBy("sequence_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*cut.columns, "sequence_id", F.coalesce(F.sum("length").over(so_far), F.lit(0)).alias("offset"))


def op1(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
