"""Exact substring deduplication with a log-structured fingerprint index.

The index holds sorted immutable runs of (fingerprint, doc_id) of earlier documents.  Each new batch is merge-joined
with the runs, what it shares is verified on whole windows, and the batch becomes a run; when runs pile up they are
compacted into one.  Fingerprints are the minimal 5-word hashes of all 13-word windows: equal windows have equal
minima, so no shared window is missed, and a document has about one fingerprint for five words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import ready, remove, written

WINDOW, ANCHOR = 13, 5
_OTHER = np.uint64(0x8EBC6AF09C88C6E3)


def _anchors(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window, position of its minimal anchor, anchor hashes by position)."""
    grams = _text.grams(hashes, ANCHOR)
    starts = _text.ranges(first[:-1], np.maximum(np.diff(first) - window + 1, 0))
    best = starts.copy()
    for t in range(1, window - ANCHOR + 1):
        better = grams[starts + t] < grams[best]
        best[better] = starts[better] + t
    return starts, best, grams


def _pair(words: _text.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each text's whole word sequence."""
    n = words.counts().astype(np.uint64)
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(words.first[:-1], words.counts()).astype(np.uint64)
    out = []
    for salt in (np.uint64(1), _OTHER):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(_text.mix64(hashes + _text.mix64(place + salt)), out=total[1:])
        out.append(_text.mix64(total[words.first[1:]] - total[words.first[:-1]] + n * salt))
    return out[0], out[1]


def described(docs: DataFrame, doc_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """doc_id, t1, t2 (names of the word sequence), n_words, sha256 of all words, anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in _text.slices(batch, "text"):
                words = _text.split(data, offsets, lower=False)
                hashes = words.hashes()
                starts, best, grams = _anchors(hashes, words.first, window)
                # Windows of one text follow each other, so equal anchor positions do too.
                new = np.flatnonzero(np.diff(best, prepend=-1))
                ends = np.searchsorted(starts[new], words.first).astype(np.int32)
                anchors = pa.ListArray.from_arrays(pa.array(ends), pa.array(grams[best[new]].view(np.int64)))
                t1, t2 = _pair(words, hashes)
                raw, edge = data.tobytes(), offsets.tolist()
                sha = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(edge, edge[1:], strict=False)]
                columns = [rows.column(0), pa.array(t1.view(np.int64)), pa.array(t2.view(np.int64)), pa.array(words.counts()), pa.array(sha), anchors]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t1", "t2", "n_words", "sha256", "anchors"])

    ready(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, t1 long, t2 long, n_words long, sha256 string, anchors array<long>")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, text, wanted anchors) -> (h1, h2, doc_id, t1, start) of the windows with a wanted anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, data, offsets in _text.slices(batch, "text"):
                words = _text.split(data, offsets, lower=False)
                hashes = words.hashes()
                starts, best, grams = _anchors(hashes, words.first, window)
                owner = np.repeat(np.arange(len(own)), np.maximum(words.counts() - window + 1, 0))
                wanted = own.column(2)
                flat = np.asarray(wanted.flatten()).view(np.uint64)
                sizes = np.asarray(wanted.value_lengths().fill_null(0))
                # A wanted anchor counts in its own text only.
                salt = _text.mix64(np.arange(len(own), dtype=np.uint64) + _OTHER)
                hit = np.isin(grams[best] ^ salt[owner], flat ^ np.repeat(salt, sizes))
                starts, owner = starts[hit], owner[hit]
                h1 = _text.grams(hashes, window)[starts]
                h2 = _text.grams(_text.mix64(hashes ^ _OTHER), window)[starts]
                t1, _ = _pair(words, hashes)
                take = pa.array(owner)
                columns = [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), own.column(0).take(take), pa.array(t1[owner].view(np.int64)), pa.array((starts - words.first[owner]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "doc_id", "t1", "start"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"h1 long, h2 long, doc_id {kind}, t1 long, start int")


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, text, t1, starts of removed windows) -> (doc_id, t1, n_removed, kept_text)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for key, text, t1, starts in zip(*[batch.column(k) for k in range(4)], strict=True):
                words = text.as_py().encode().split()
                change = np.zeros(len(words) + 1, np.int64)
                at = np.asarray(starts.values)
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                keep = np.cumsum(change[:-1]) == 0
                out[0].append(key.as_py())
                out[1].append(t1.as_py())
                out[2].append(int(len(words) - keep.sum()))
                out[3].append(b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode())
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "t1", "n_removed", "kept_text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, t1 long, n_removed long, kept_text string")


class FingerprintIndex:
    """Sorted immutable runs of (hash, doc_id), and the texts they came from for verification."""

    def __init__(self, fan: int = 4):
        self.runs: list[DataFrame] = []
        self.texts: list[DataFrame] = []
        self.fan = fan

    def append(self, prints: DataFrame, texts: DataFrame) -> None:
        """Add a batch as a run, and compact when there are more than fan runs."""
        self.runs.append(self._run(prints))
        self.texts.append(texts)
        if len(self.runs) > self.fan:
            old, self.runs = self.runs, [self._run(reduce(DataFrame.unionByName, self.runs))]
            for run in old:
                remove(run)

    @staticmethod
    def _run(prints: DataFrame) -> DataFrame:
        # Ranges of (hash, doc_id): a fingerprint of very many documents spreads over several files.
        return written(prints.repartitionByRange("hash", "doc_id").sortWithinPartitions("hash", "doc_id"), "substring-run")

    def repeats(self, prints: DataFrame, texts: DataFrame, window: int = WINDOW) -> DataFrame:
        """(doc_id, t1, starts): windows of the batch whose words also start in a smaller doc_id of batch or index."""
        every = reduce(DataFrame.unionByName, [*self.runs, prints])
        per = prints.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"))
        for run in self.runs:
            past = run.groupBy("hash").agg(F.min("doc_id").alias("a0"), F.max("doc_id").alias("z0"))
            per = per.join(past, "hash", "left").select("hash", F.least("a", "a0").alias("a"), F.greatest("z", "z0").alias("z"))
        # Written, so that the join below deals both sides anew and a very common fingerprint can be split.
        shared = written(per.filter("a < z").select("hash"), "substring-shared")
        wanted = every.join(shared, "hash", "left_semi").groupBy("doc_id").agg(F.collect_set("hash").alias("wanted"))
        sources = reduce(DataFrame.unionByName, [*self.texts, texts])
        rows = sources.join(wanted, "doc_id").select("doc_id", "text", "wanted")
        windows = written(_windows(rows, window), "substring-windows")
        least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z").select("h1", "h2", "a")
        found = windows.join(least, ["h1", "h2"]).filter("doc_id > a").join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
        starts = written(found.groupBy("doc_id", "t1").agg(F.collect_set("start").alias("starts")), "substring-found")
        remove(windows)
        remove(shared)
        return starts


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, batches: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (null where nothing was removed), kept_sha256.

    Batches follow each other in the order of doc_id; earlier ones are the index's runs.  Null, empty and short
    texts lose nothing; rows of equal doc_id are one document, so they do not remove each other's words; a null
    doc_id neither removes nor loses; an empty table gives an empty result.  Other columns of docs are not read.
    """
    base = written(described(docs, doc_id, text, window), "substring-base")
    # Of equal word sequences only the first document can keep or give words; the others lose all of them.
    named = base.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    groups = named.groupBy("t1", "t2").agg(F.min("doc_id").alias("first_id"))
    later = written(named.join(groups, ["t1", "t2"]).filter("doc_id > first_id").select("doc_id", "t1", "t2").distinct(), "substring-later")
    own = named.join(later, ["doc_id", "t1", "t2"], "left_anti").select("doc_id", F.explode("anchors").alias("hash"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    cuts: list = []
    if dict(base.dtypes)["doc_id"] in ("bigint", "int") and batches > 1:
        row = named.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("q")).first()
        cuts = sorted(set(row["q"] or []))
    edges = [None, *cuts, None]
    index, found = FingerprintIndex(), []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = lambda df: df.filter((F.lit(True) if a is None else F.col("doc_id") > a) & (F.lit(True) if b is None else F.col("doc_id") <= b))  # noqa: B023,E731
        prints, batch = inside(own), inside(texts)
        found.append(index.repeats(prints, batch, window))
        if k + 2 < len(edges):
            index.append(prints, batch)
    for run in index.runs:
        remove(run)
    starts = reduce(DataFrame.unionByName, found)
    cut = _cut(texts.join(starts, "doc_id").select("doc_id", "text", "t1", "starts"), window).withColumn("cut_sha", F.sha2(F.encode("kept_text", "utf-8"), 256))
    all_gone = F.col("first_id").isNotNull() & (F.col("doc_id") > F.col("first_id"))
    kept = base.drop("anchors").join(groups, ["t1", "t2"], "left").join(cut.dropDuplicates(["doc_id", "t1"]), ["doc_id", "t1"], "left")
    return kept.select(
        "doc_id",
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "sha256")).alias("kept_sha256"),
    )


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
