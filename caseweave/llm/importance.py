"""Importance resampling towards a target distribution, by bit-sliced aggregation.

A document's features (its words and pairs of neighbouring words) fall into buckets by CRC-32.  Its counts by bucket
are kept as bit planes: plane k holds bit k of every bucket's count, one bit a bucket.  A bucket's gain is what a
feature in it speaks for the target against the whole table; gains are bit planes too, those above zero and those
below apart.  A document's sum of gains is then exact: for each pair of planes the bits that both have are counted,
and the counts are added with their powers of two.  Documents are drawn by the largest weight plus Gumbel noise from
a seeded hash of their ids, which draws without replacement in proportion to exp(weight / 1000).

The table of planes is written once; texts are read once.  What a task holds and what is sent to the driver is bound
by the number of buckets, whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _crc, _text
from ._ranks import placed
from ._store import ready, written

BUCKETS = 10_000
#: Words of a document that can be drawn, at least.
WORDS = 20
#: Documents whose planes are made or weighed at once.
CHUNK = 256

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _width(buckets: int) -> int:
    """Bytes of a plane: whole 64-bit words."""
    return -(-buckets // 64) * 8


def _planes(owner: np.ndarray, bucket: np.ndarray, n: int, buckets: int) -> list[bytes]:
    """The bit planes of n documents one after another, the lowest first; a document without features has none."""
    width = _width(buckets)
    found, count = np.unique(owner * buckets + bucket, return_counts=True)
    of, at = found // buckets, found % buckets
    bits = np.zeros(n, np.int64)
    np.maximum.at(bits, of, np.frexp(count.astype(float))[1])
    place, value = of * width + (at >> 3), 1 << (at & 7)
    made = []
    for k in range(int(bits.max(initial=0))):
        has = (count >> k & 1).astype(bool)
        made.append(np.bincount(place[has], value[has], n * width).astype(np.uint8).reshape(n, width))
    return [b"".join(made[k][d].tobytes() for k in range(bits[d])) for d in range(n)]


def feature_planes(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """docs without their text, with __words, __features and __planes; a null text has no words."""
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, data, offsets in _text.slices(batch, text):
                words = _text.split(data, offsets, space=_BETWEEN)
                owner, single = words.owner(), _crc.runs(words.data, words.starts, words.ends)
                at = np.flatnonzero(np.diff(owner) == 0)
                pairs = _crc.word_pairs(words, single, at)
                bucket = np.concatenate([single, pairs]).astype(np.int64) % buckets
                of = np.concatenate([owner, owner[at]])
                n = words.counts()
                order = np.argsort(of, kind="stable")
                of, bucket = of[order], bucket[order]
                for k in range(0, len(own), CHUNK):
                    to = min(k + CHUNK, len(own))
                    a, b = np.searchsorted(of, [k, to])
                    planes = _planes(of[a:b] - k, bucket[a:b], to - k, buckets)
                    columns = [own.column(own.schema.get_field_index(c)).slice(k, to - k) for c in others]
                    columns += [pa.array(n[k:to]), pa.array(np.maximum(2 * n[k:to] - 1, 0)), pa.array(planes, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [*others, "__words", "__features", "__planes"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "__words long, __features long, __planes binary"]))


def _rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes, one a row; the document of each; which plane of it)."""
    sizes = np.array([len(x) // width for x in column.to_pylist()], np.int64)
    raw = b"".join(column.to_pylist())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.frombuffer(raw, np.uint8).reshape(-1, width), owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            yield batch.slice(k, size)


def bucket_totals(planes: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the whole table each bucket holds; every task sums what it reads."""
    width = _width(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * 8, np.int64)
        for part in _chunks(batches, CHUNK):
            rows, _, power = _rows(part.column(0), width)
            for k in np.unique(power):
                total += np.unpackbits(rows[power == k], axis=1, bitorder="little").sum(axis=0, dtype=np.int64) << int(k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    made = planes.select("__planes").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = made.toArrow()  # at most a row a bucket
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(everything: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share of the target's features over that of all features."""
    n, size, goal = len(everything), float(everything.sum()), float(target.sum())
    pairs = zip(everything.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (size + n) / ((s + 1.0) * (goal + n)))) for s, t in pairs], np.int64)


def _gain_planes(values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, plane as 64-bit words) of the gains, those below zero apart."""
    width, out = _width(len(values)), []
    for sign in (1, -1):
        size = np.maximum(sign * values, 0)
        for k in range(int(size.max(initial=0)).bit_length()):
            bits = np.zeros(width * 8, np.uint8)
            bits[: len(values)] = size >> k & 1
            out.append((sign << k, np.packbits(bits, bitorder="little").view(np.uint64)))
    return out


def weigh(planes: DataFrame, values: np.ndarray) -> DataFrame:
    """planes without __planes, with weight: the floored mean of the gains over a document's features, 0 without any."""
    width, tables = _width(len(values)), _gain_planes(values)
    others = [c for c in planes.columns if c != "__planes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, CHUNK):
            rows, owner, power = _rows(part.column(part.schema.get_field_index("__planes")), width)
            rows, each = rows.view(np.uint64), np.zeros(len(rows), np.int64)
            for scale, table in tables:
                each += scale * np.bitwise_count(rows & table).sum(axis=1, dtype=np.int64)
            total = np.zeros(len(part), np.int64)
            np.add.at(total, owner, each << power)
            n = np.asarray(part.column(part.schema.get_field_index("__features")))
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), pa.array(weight)], [*others, "weight"])

    kinds = dict(planes.dtypes)
    return planes.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "weight long"]))


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = 25, words: int = WORDS, buckets: int = BUCKETS, seed: int = 7,
) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (1, 2, ... of those drawn, else null).

    Drawn are the highest scores of percent in a hundred (rounded down) of the documents with enough words, equal ones
    by the smaller id, a null id last.  Null texts have no words; repeated rows score alike and are drawn each on its
    own; empty tables of documents or targets are allowed.  Other columns of either table are not read.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    made = written(feature_planes(rows, buckets=buckets), "importance-planes")
    aim = feature_planes(target.select(F.col(target_text).alias("text"), F.lit(0).alias("k")), buckets=buckets)
    values = gains(bucket_totals(made, buckets), bucket_totals(aim, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weigh(made, values).withColumn("score", F.col("weight") + noise), "importance-scores")
    fit = F.col("__words") >= words
    ranked = placed(scored.filter(fit), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    drawn = F.when(F.col("__place") < F.expr(f"(__n * {int(percent)}) div 100"), F.col("__place") + 1).alias("rank")
    columns = ["doc_id", F.col("__features").alias("n_features"), "weight", "score"]
    return ranked.select(*columns, drawn).unionByName(scored.filter(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that resample() draws, with all their columns; rows of one id come together, a null id is drawn by none."""
    ids = resample(docs, target, doc_id, **how).filter("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, docs[doc_id] == ids["__drawn"], "left_semi")


def op13(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH
bits AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
texts AS (
  SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
uses AS (
  SELECT side, doc_id, feature, count(*) AS n
  FROM (SELECT side, doc_id, unnest(w || list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS feature FROM texts)
  GROUP BY ALL),
hashed AS (
  SELECT feature, xor(list_reduce([4294967295] || list_transform(range(octet_length(encode(feature))), lambda k: ('0x' || substr(hex(encode(feature)), (2 * k + 1)::BIGINT, 2))::BIGINT),
                                  lambda c, b: xor(c >> 8, bits.t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM uses), bits),
counted AS (SELECT side, doc_id, bucket, sum(n)::BIGINT AS n FROM uses JOIN hashed USING (feature) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM counted GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums),
gained AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM sums, totals),
summed AS (SELECT doc_id, sum(n * gain)::BIGINT AS gain FROM counted JOIN gained USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(w) AS words, greatest(2 * len(w) - 1, 0) AS n_features,
         CASE WHEN len(w) > 0 THEN floor(gain::DOUBLE / (2 * len(w) - 1))::BIGINT ELSE 0 END AS weight,
         ('0x' || substr(sha256('7:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM texts d LEFT JOIN summed g ON g.doc_id = d.doc_id WHERE side = 0),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER (PARTITION BY words >= 20) AS n FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND r <= n * 25 // 100 THEN r END AS rank FROM ranked
"""
