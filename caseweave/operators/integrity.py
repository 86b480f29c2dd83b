"""Digests, hash-chained audit logs, manifests and case status."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from caseweave.functions.parsing import canonical_json, entry_hash, payload_hash

GENESIS = "0" * 64


#: The row's own fields of the entry hash, in their order, between the previous hash and the payload's.
ENTRY_FIELDS = ["seq", "occurred_at", "officer_badge", "action", "target_type", "target_id"]


def hashed_entries(actions: DataFrame, payload: dict[str, Column]) -> DataFrame:
    """actions (case_id, ENTRY_FIELDS, ...) with payload_json and payload_hash."""
    return actions.withColumn("payload_json", canonical_json(**payload)).withColumn("payload_hash", payload_hash(F.col("payload_json")))


def _entry(prev: Column, of) -> Column:
    """The entry hash: the previous hash, the row's fields, the payload's hash; a null field counts as empty."""
    return entry_hash(prev, *[of(c) for c in ENTRY_FIELDS], of("payload_hash"))


def chained(entries: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """entries with prev_hash and entry_hash: a fold over each case's entries in their order.

    Cases are dealt to partitions and sorted by number there; a partition is read once, row by row, and of a case only
    the last hash is held, so a log of any length takes time in proportion and no memory.  A chain is sequential within
    its case, so cases are what runs in parallel.  heads (case_id, head_hash) continue earlier chains, others begin with
    the genesis hash.
    """
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*ENTRY_FIELDS, "payload_hash")]
    rows = entries.withColumn("__rest", F.concat_ws("\u001f", *rest))
    if heads is not None:
        rows = rows.join(heads.select("case_id", F.col("head_hash").alias("__head")), "case_id", "left")
    else:
        rows = rows.withColumn("__head", F.lit(None).cast("string"))
    rows = rows.repartition("case_id").sortWithinPartitions("case_id", "seq")
    genesis, kept = GENESIS, [c for c in rows.columns if not c.startswith("__")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, last = object(), genesis
        for batch in batches:
            before, after = [], []
            for own, rest, head in zip(batch.column("case_id").to_pylist(), batch.column("__rest").to_pylist(), batch.column("__head").to_pylist(), strict=True):
                if own != case:
                    case, last = own, head or genesis
                before.append(last)
                last = hashlib.sha256(f"{last}\x1f{rest}".encode()).hexdigest()
                after.append(last)
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.string()), pa.array(after, pa.string())], [*kept, "prev_hash", "entry_hash"])

    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in kept), StructField("prev_hash", StringType()), StructField("entry_hash", StringType())]))


def verified(chain: DataFrame, payload: dict[str, Column]) -> DataFrame:
    """Per case: entries, ok and first_bad_seq.

    Each row recomputes its payload's hash and its own from its columns as they are now, so the work is parallel within a
    case too; a lag checks numbering and linkage.
    """
    w = Window.partitionBy("case_id").orderBy("seq")
    bad = F.col("payload_hash") != payload_hash(canonical_json(**payload))
    bad = bad | (F.col("entry_hash") != _entry(F.col("prev_hash"), F.col))
    bad = bad | (F.col("prev_hash") != F.coalesce(F.lag("entry_hash").over(w), F.lit(GENESIS))) | (F.col("seq") != F.coalesce(F.lag("seq").over(w) + 1, F.lit(0)))
    rows = chain.withColumn("bad", F.coalesce(bad, F.lit(True)))
    out = rows.groupBy("case_id").agg(F.count("*").alias("entries"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("first_bad_seq"))
    return out.select("case_id", "entries", F.col("first_bad_seq").isNull().alias("ok"), "first_bad_seq")


def filtered(chain: DataFrame, action: str | None = None, officer: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Audit entries by action, officer and range of occurred_at (ISO text, ends included)."""
    out = chain
    for column, value in (("action", action), ("officer_badge", officer)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if since is not None:
        out = out.filter(F.col("occurred_at") >= since)
    return out if until is None else out.filter(F.col("occurred_at") <= until)


def manifest_lines(files: DataFrame, chain: DataFrame) -> DataFrame:
    """A JSON line for each file (name, sha256) and for the head of each case's chain: a manifest that grows as its parts do."""
    own = files.select(canonical_json(kind=F.lit("file"), name=F.col("name").cast("string"), sha256=F.col("sha256")).alias("line"))
    last = heads(chain).select(canonical_json(kind=F.lit("head"), case_id=F.col("case_id").cast("string"), seq=F.col("head_seq"), hash=F.col("head_hash")).alias("line"))
    return own.unionByName(last)


def excluded(files: DataFrame, exclusions: DataFrame) -> DataFrame:
    """files without those excluded; an exclusion (name, reason) without a reason does not count."""
    return files.join(exclusions.filter("trim(reason) <> ''").select("name").distinct(), "name", "left_anti")


def heads(chain: DataFrame) -> DataFrame:
    """case_id, head_seq, head_hash"""
    return chain.groupBy("case_id").agg(F.max("seq").alias("head_seq"), F.max_by("entry_hash", "seq").alias("head_hash"))


def inventory(docs: DataFrame, name: str, content: str) -> DataFrame:
    """name, size_bytes, sha256 of each piece of evidence."""
    body = F.encode(F.col(content), "utf-8") if dict(docs.dtypes)[content] == "string" else F.col(content)
    return docs.select(F.col(name).alias("name"), F.octet_length(F.col(content)).cast("long").alias("size_bytes"), F.sha2(body, 256).alias("sha256"))


def manifest_diff(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """name, status UNCHANGED, CHANGED, MISSING or NEW."""
    a, b = manifest.select("name", F.col("sha256").alias("x")), now.select("name", F.col("sha256").alias("y"))
    status = F.when(F.col("y").isNull(), "MISSING").when(F.col("x").isNull(), "NEW").when(F.col("x") == F.col("y"), "UNCHANGED").otherwise("CHANGED")
    return a.join(b, "name", "full_outer").select("name", status.alias("status"))


def duplicates(files: DataFrame, case: str = "case_id") -> DataFrame:
    """files with is_duplicate: a digest seen before in the case."""
    w = Window.partitionBy(case, "sha256").orderBy("name")
    return files.withColumn("is_duplicate", F.row_number().over(w) > 1)


def case_status(chains: DataFrame, files: DataFrame, case: str) -> DataFrame:
    """case, status: COMPROMISED if a chain or a file fails, VERIFIED if both were checked, else UNVERIFIED."""
    bad = files.groupBy(case).agg(F.count_if(F.col("status").isin("CHANGED", "MISSING")).alias("bad_files"))
    both = chains.join(bad, case, "full_outer")
    status = F.when((~F.col("ok")) | (F.col("bad_files") > 0), "COMPROMISED").when(F.col("ok") & F.col("bad_files").isNotNull(), "VERIFIED").otherwise("UNVERIFIED")
    return both.select(case, F.coalesce(status, F.lit("UNVERIFIED")).alias("status"))
