"""From file headers to canonical fields."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseweave.config import CANONICAL_FIELDS, FORMATS, MIN_MATCHES
from caseweave.operators.checkpoints import shipped


def header(c: Column) -> Column:
    """Lower case, anything but letters and digits as single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def signature(headers: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(headers, lambda h: F.lower(F.trim(h)))), ",")


def aliases(spark: SparkSession, formats: dict = FORMATS) -> DataFrame:
    rows = [(kind, field, alias, k) for kind, f in formats.items() for field, names in f["columns"].items() for k, alias in enumerate(names)]
    return spark.createDataFrame(rows, "kind string, field string, alias string, place int").withColumn("norm", header(F.col("alias")))


def detected(files: DataFrame, formats: dict = FORMATS) -> DataFrame:
    """files (file_id, headers array, head string) -> file_id, kind, by what they hold and never by their names.

    Mail and phone dumps by their own marks; else the kind of most distinct detection headers, at least two; else a
    check-digit-proof IMEI says CDR, a payment handle UPI.
    """
    rows = [(kind, alias) for kind, f in formats.items() for alias in f["detect"]]
    marks = files.sparkSession.createDataFrame(rows, "kind string, alias string").select("kind", header(F.col("alias")).alias("norm")).filter("norm <> ''").distinct()
    own = files.select("file_id", F.explode_outer("headers").alias("h")).withColumn("h", header(F.col("h")))
    hits = own.join(F.broadcast(marks), F.col("h").contains(F.col("norm")))
    hits = hits.groupBy("file_id", "kind").agg(F.count_distinct("norm").alias("n")).filter(F.col("n") >= MIN_MATCHES)
    best = hits.groupBy("file_id").agg(F.max_by("kind", F.struct("n", "kind")).alias("by_header"))
    fifteen = F.regexp_extract_all(F.coalesce("head", F.lit("")), F.lit(r"\b[0-9]{15}\b"), F.lit(0))
    found = files.join(best, "file_id", "left")
    kind = (
        F.when(F.col("head").rlike("(?m)^Received:"), "EML")
        .when(F.col("head").rlike('"(device_info|installed_apps|sms_messages)"'), "ANDROID_DUMP")
        .when(F.col("by_header").isNotNull(), F.col("by_header"))
        .when(F.exists(fifteen, lambda x: F.call_function("luhn_check", x)), "CDR")
        .when(F.col("head").rlike(r"\b[A-Za-z0-9._-]+@[a-z]{2,}\b(?!\.)"), "UPI")
        .otherwise("UNKNOWN")
    )
    return found.select("file_id", kind.alias("kind"))


def ratios(texts: pd.Series, fields: list[str]) -> np.ndarray:
    """100 * 2 * common / total of each text with each field (63 characters at most), by sorted tokens.

    Common is the longest common subsequence, bit-parallel: a word of bits a pair stands for the row of the dynamic
    programme over the field's characters, and one step takes the next character of all texts with all fields.
    """
    ordered = lambda x: " ".join(sorted(x.split()))
    short, long = [ordered(f) for f in fields], [ordered(t) for t in texts]
    if max(map(len, short), default=0) > 63:
        raise ValueError("a field has more than 63 characters")
    symbols = {c: k for k, c in enumerate(sorted(set("".join(short))), 1)}  # 0 is any character of no field
    masks = np.zeros((len(symbols) + 1, len(short)), np.uint64)
    for f, field in enumerate(short):
        for k, c in enumerate(field):
            masks[symbols[c], f] |= np.uint64(1) << np.uint64(k)
    sizes = np.array([len(t) for t in long], np.int64)
    order = np.argsort(-sizes, kind="stable")  # the texts that still have characters come first
    codes = np.zeros((len(long), int(sizes.max(initial=0))), np.int64)
    for row, k in enumerate(order):
        codes[row, : sizes[k]] = [symbols.get(c, 0) for c in long[k]]
    bits = np.full((len(long), len(short)), ~np.uint64(0))
    left = np.sort(sizes)
    for p in range(codes.shape[1]):
        n = len(long) - int(np.searchsorted(left, p, "right"))
        hit = bits[:n] & masks[codes[:n, p]]
        bits[:n] = (bits[:n] + hit) | (bits[:n] - hit)
    own = np.array([(1 << len(f)) - 1 for f in short], np.uint64)
    common = np.empty((len(long), len(short)))
    common[order] = np.bitwise_count(~bits & own)
    total = sizes[:, None] + np.array([len(f) for f in short])
    return np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)


def token_ratio(a: str, b: str) -> float:
    """ratios() of two texts."""
    return float(ratios(pd.Series([a]), [b])[0, 0])


def claims(headers: DataFrame, formats: dict = FORMATS) -> DataFrame:
    """file_id, source, field, place: every field whose alias a header is, several headers for one field included."""
    named = headers.withColumn("norm", header(F.col("source")))
    return named.join(F.broadcast(aliases(headers.sparkSession, formats)).drop("place").distinct(), ["kind", "norm"]).select("file_id", "source", "field", "place").distinct()


def by_alias(headers: DataFrame, formats: dict = FORMATS) -> DataFrame:
    """file_id, source, field, confidence 1 of the certain mappings: the first header for a field, one field a header."""
    first = Window.partitionBy("file_id", "field").orderBy("place")
    once = Window.partitionBy("file_id", "source").orderBy("field")
    one = claims(headers, formats).withColumn("r", F.row_number().over(first)).filter("r = 1").withColumn("r", F.row_number().over(once)).filter("r = 1")
    return one.select("file_id", "source", "field", F.lit(1.0).alias("confidence"))


def confirmed(mappings: DataFrame, confirmations: DataFrame) -> DataFrame:
    """mappings with is_confirmed: those an officer confirmed (file_id, source, field), and the certain ones."""
    said = confirmations.select("file_id", "source", "field", F.lit(True).alias("said")).distinct()
    return mappings.join(said, ["file_id", "source", "field"], "left").withColumn("is_confirmed", F.coalesce("said", F.col("confidence") >= 1)).drop("said")


def proposed(headers: DataFrame, least: float = 60.0, formats: dict = FORMATS) -> DataFrame:
    """headers (file_id, kind, source, place) -> file_id, source, field, confidence, class: one header for a field.

    An alias of the file's kind is certain and taken in the order of headers; of the rest, each header goes to the
    most similar free field, and each field keeps its most similar header.
    """
    shipped(headers.sparkSession)
    named = headers.withColumn("norm", header(F.col("source")))
    sure = by_alias(headers, formats)
    fields = F.array(*[F.lit(f) for f in CANONICAL_FIELDS])
    rest = named.join(sure, ["file_id", "source"], "left_anti")
    # Files repeat headers: each different header is compared with all fields once, whatever the number of files.
    names = [f.replace("_", " ") for f in CANONICAL_FIELDS]

    @F.pandas_udf("array<double>")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(list(ratios(x, names)))

    pairs = rest.select("norm").distinct().select("norm", F.posexplode(ratio("norm")).alias("k", "share"))
    likely = pairs.select("norm", F.get(fields, F.col("k")).alias("field"), (F.col("share") / 100).alias("confidence")).filter(F.col("confidence") >= least / 100)
    near = rest.join(likely, "norm").join(sure.select("file_id", "field"), ["file_id", "field"], "left_anti")
    by_header = Window.partitionBy("file_id", "source").orderBy(F.desc("confidence"), "field")
    by_field = Window.partitionBy("file_id", "field").orderBy(F.desc("confidence"), "place")
    near = near.withColumn("r", F.row_number().over(by_header)).filter("r = 1").withColumn("r", F.row_number().over(by_field)).filter("r = 1")
    both = sure.unionByName(near.select("file_id", "source", "field", "confidence"))
    level = F.when(F.col("confidence") >= 0.9, "High").when(F.col("confidence") >= 0.7, "Med").otherwise("Low")
    return both.withColumn("class", level)


def missing_fields(files: DataFrame, mappings: DataFrame, formats: dict = FORMATS) -> DataFrame:
    """file_id, missing: required fields of the file's kind without a header."""
    required = F.coalesce(*[F.when(F.col("kind") == k, F.array(*[F.lit(x) for x in f["required"]])) for k, f in formats.items()], F.array().cast("array<string>"))
    have = mappings.groupBy("file_id").agg(F.collect_set("field").alias("have"))
    out = files.join(have, "file_id", "left")
    return out.select("file_id", F.array_sort(F.array_except(required, F.coalesce("have", F.array().cast("array<string>")))).alias("missing"))


def conflicts(mappings: DataFrame) -> DataFrame:
    """file_id, field, n of fields that several headers claim."""
    return mappings.groupBy("file_id", "field").agg(F.count("*").alias("n")).filter("n > 1")


def remembered(headers: DataFrame, saved: DataFrame) -> DataFrame:
    """Mappings of files whose header signature was confirmed before; saved (signature, source, field)."""
    own = headers.groupBy("file_id").agg(signature(F.collect_list("source")).alias("signature"))
    return own.join(saved, "signature").select("file_id", "source", "field", F.lit(1.0).alias("confidence"))
