"""Readers of evidence: delimited text with true row numbers, workbooks, mail, phone dumps; inventories and exports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseweave.functions.parsing import ist_to_utc, parsed_time
from caseweave.operators import mapping
from caseweave.operators.checkpoints import shipped


def inventory(spark: SparkSession, path: str, least: int = 1, most: int | None = None) -> DataFrame:
    """path, size_bytes, sha256, problem (EMPTY, TOO_LARGE or null) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    problem = F.when(F.col("length") < least, "EMPTY")
    if most is not None:
        problem = problem.when(F.col("length") > most, "TOO_LARGE")
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), problem.alias("problem"))


#: Bytes of a file that its kind is told by, and that are read at once.
HEAD, READ = 4096, 8 << 20


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, size_bytes, sha256, md5, head (the first bytes as text) of the files under a path, of any size.

    The listing is Spark's and reads no contents; each file is then one stream of reads of some megabytes through
    pyarrow's file systems, so the scheme must be one that pyarrow opens.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size_bytes"))
    head_bytes, read_bytes = HEAD, READ

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        from pyarrow import fs

        for batch in batches:
            rows = []
            for name, size in zip(batch["path"], batch["size_bytes"], strict=True):
                system, place = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
                sha, md5, head = hashlib.sha256(), hashlib.md5(usedforsecurity=False), b""
                with system.open_input_stream(place) as stream:
                    while part := stream.read(read_bytes):
                        head = head or part[:head_bytes]
                        sha.update(part)
                        md5.update(part)
                rows.append((name, size, sha.hexdigest(), md5.hexdigest(), head.decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["path", "size_bytes", "sha256", "md5", "head"])

    # Files differ in size by orders of magnitude: dealt by a hash, not in the listing's order.
    return files.repartition("path").mapInPandas(run, "path string, size_bytes long, sha256 string, md5 string, head string")


def register(spark: SparkSession, path: str) -> DataFrame:
    """path, size_bytes, sha256, md5, kind of the files under a path; the kind is told by the first bytes."""
    found = digests(spark, path)
    first = F.split(F.regexp_replace("head", "^\ufeff", ""), r"\r?\n", 2)[0]
    cells = F.transform(F.split(first, ","), lambda h: F.trim(F.regexp_replace(h, '^"|"$', "")))
    kinds = mapping.detected(found.select(F.col("path").alias("file_id"), cells.alias("headers"), "head")).withColumnRenamed("file_id", "path")
    return found.drop("head").join(kinds, "path")


def _hollow(spark: SparkSession, path: str) -> list[str]:
    """Names of the files without bytes under a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed, names = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True), []
    while listed.hasNext():
        f = listed.next()
        if f.getLen() == 0:
            names.append(f.getPath().getName())
    return names


def problems(spark: SparkSession, path: str, wanted: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """name, problem of the wanted files (name) under a path: MISSING, EMPTY, TOO_LARGE, CORRUPT (not text), or null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    problem = F.when(F.col("length") < least, "EMPTY")
    if most is not None:
        problem = problem.when(F.col("length") > most, "TOO_LARGE")
    problem = problem.when(F.contains(F.col("content"), F.lit(bytearray(b"\x00"))), "CORRUPT")
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), problem.alias("problem"), F.lit(True).alias("there"))
    # Spark's readers pass over files without bytes, so those come from the listing.
    hollow = spark.createDataFrame([(n, "EMPTY", True) for n in _hollow(spark, path)], "name string, problem string, there boolean")
    found = found.unionByName(hollow if least > 0 else hollow.withColumn("problem", F.lit(None).cast("string")))
    return wanted.join(found, "name", "left").select("name", F.when(F.col("there").isNull(), "MISSING").otherwise(F.col("problem")).alias("problem"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, source_row (from 1), line, block: numbers are counted before each split of a file, then within it.

    A file of which any line is no UTF-8 is read as Latin-1.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    raw = raw.withColumn("order", F.monotonically_increasing_id())
    sizes = raw.groupBy("path", "block").agg(F.count("*").alias("n"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.min("utf8").over(Window.partitionBy("path")).alias("utf8"))
    within = Window.partitionBy("path", "block").orderBy("order")
    out = raw.withColumn("r", F.row_number().over(within)).join(base, ["path", "block"])
    text = F.when(F.col("utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    return out.select("path", (F.col("base") + F.col("r")).alias("source_row"), F.regexp_replace(text, "^\ufeff", "").alias("line"), "block")


def records(lines: DataFrame) -> DataFrame:
    """numbered_lines joined where a quoted cell holds line breaks: a record begins at a line with an even number of
    quotes before it in its file, and has the number of its first line.

    A split of a file does not know whether it begins inside a quoted cell, so it says for both cases where its last
    record begins, and whether it turns one case into the other; these few numbers a split are combined along the file,
    and each split then joins its own lines.
    """
    quotes = lines.withColumn("q", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))))
    own = Window.partitionBy("path", "block").orderBy("source_row")
    inside = F.coalesce(F.sum("q").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    quotes = quotes.withColumn("inside", inside)
    last = [F.max(F.when(F.col("inside") == k, F.col("source_row"))).alias(f"last{k}") for k in (0, 1)]
    splits = quotes.groupBy("path", "block").agg((F.sum("q") % 2).alias("turns"), *last)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("open", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2)
    began = F.last(F.when(F.col("open") == 0, F.col("last0")).otherwise(F.col("last1")), True).over(before)
    splits = splits.select("path", "block", "open", began.alias("began"))
    rows = quotes.join(splits, ["path", "block"])
    first = F.max(F.when(F.col("inside") == F.col("open"), F.col("source_row"))).over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("first", F.coalesce(first, "began")).groupBy("path", "first").agg(F.array_sort(F.collect_list(F.struct("source_row", "line"))).alias("parts"))
    return rows.select("path", F.col("first").alias("source_row"), F.array_join(F.transform("parts", lambda x: x["line"]), "\n").alias("line"))


#: Stands between cells once quotes are resolved: no character of any text.
_BETWEEN = "\ufffe"


def _cells(line: Column, sep: str) -> Column:
    """The cells of a record.  What quotes part is outside and inside by turns; separators count outside, and nothing
    between two inside parts is a doubled quote.  No pattern runs over a whole cell, so cells may be of any length."""
    parts = F.split(line, '"')
    outside = lambda x, i: F.when((x == "") & (i > 0) & (i < F.size(parts) - 1), '"').otherwise(F.replace(x, F.lit(sep), F.lit(_BETWEEN)))
    joined = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, x).otherwise(outside(x, i))), "")
    return F.transform(F.split(joined, _BETWEEN), lambda x: F.trim(x))


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """path, source_row (2 is the first after the header), raw_line, headers, cells, reason (null where the row fits).

    Quoted cells may hold separators, doubled quotes and line breaks; a row with more or fewer cells than its header is
    a reject.
    """
    lines = records(numbered_lines(spark, path))
    split = lambda c: _cells(c, sep)
    head = lines.filter("source_row = 1").select("path", split(F.col("line")).alias("headers"))
    rows = lines.filter("source_row > 1 and trim(line) <> ''").withColumn("cells", split(F.col("line"))).join(head, "path")
    reason = F.when(F.size("cells") > F.size("headers"), "surplus cells").when(F.size("cells") < F.size("headers"), "missing cells")
    return rows.select("path", "source_row", F.col("line").alias("raw_line"), "headers", "cells", reason.alias("reason"))


def cell(name: str) -> Column:
    """The cell under a header of delimited(), null where the file has none of that name."""
    at = F.array_position(F.transform("headers", lambda h: F.lower(h)), name.lower())
    return F.when(at > 0, F.try_element_at("cells", at.cast("int")))


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _first_sheet(z: zipfile.ZipFile) -> str:
    """The part that holds the first sheet in the workbook's own order."""
    names = z.namelist()
    fallback = min(n for n in names if n.startswith("xl/worksheets/sheet"))
    if "xl/workbook.xml" not in names or "xl/_rels/workbook.xml.rels" not in names:
        return fallback
    sheet = next(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"), None)
    if sheet is None:
        return fallback
    wanted = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
    for rel in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == wanted:
            return "xl/" + rel.get("Target", "").removeprefix("/xl/").removeprefix("xl/")
    return fallback


def _date_styles(z: zipfile.ZipFile) -> set[str]:
    """Numbers of the cell styles that show a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {f.get("numFmtId") for f in root.iter(f"{_MAIN}numFmt") if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
    dates = own | {str(k) for k in (*range(14, 23), *range(45, 48))}
    styles = root.find(f"{_MAIN}cellXfs")
    return {str(k) for k, x in enumerate(styles if styles is not None else []) if x.get("numFmtId") in dates}


def _sheet(content: bytes) -> list[list[str]]:
    """Cells of the first sheet of a workbook, as text; dates as yyyy-MM-dd HH:mm:ss."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dates = _date_styles(z)
        rows = []
        for row in ElementTree.fromstring(z.read(_first_sheet(z))).iter(f"{_MAIN}row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(row.iter(f"{_MAIN}c")):
                letters = re.match("[A-Z]*", c.get("r", "")).group()
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else k
                value = c.find(f"{_MAIN}v")
                text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
                if c.get("t") == "s" and text:
                    text = shared[int(text)]
                elif c.get("t") in (None, "n") and text and c.get("s") in dates:
                    text = (datetime(1899, 12, 30) + timedelta(seconds=round(float(text) * 86400))).strftime("%Y-%m-%d %H:%M:%S")
                cells[at] = text
            rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
        return rows


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, source_row, headers, cells of the first sheet of each workbook; a workbook is one task's work."""
    files = shipped(spark).read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = _sheet(content)
                head = rows[0] if rows else []
                body = [(name, k + 2, head, r + [""] * (len(head) - len(r))) for k, r in enumerate(rows[1:])]
                yield pd.DataFrame(body, columns=["path", "source_row", "headers", "cells"])

    return files.mapInPandas(run, "path string, source_row long, headers array<string>, cells array<string>")


def mails(spark: SparkSession, path: str) -> DataFrame:
    """parsed_mails of each mail file under a path."""
    return parsed_mails(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def parsed_mails(raw: DataFrame) -> DataFrame:
    """(path, value) -> path, sender, recipient, return_path, subject, sent, spf, dkim, dmarc, hops, lookalike, spoofed.

    A header is forged if SPF or DKIM failed or the bounces go to another domain than the sender's; lookalike says that
    this other domain differs in one or two characters only.
    """
    head = F.regexp_replace(F.split("value", r"\r?\n\r?\n", 2)[0], r"\r?\n[ \t]+", " ")
    field = lambda n: F.nullif(F.trim(F.regexp_extract(F.col("head"), rf"(?im)^{n}:\s*(.*)$", 1)), F.lit(""))
    address = lambda c: F.lower(F.regexp_extract(c, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)", 1))
    result = lambda n: F.lower(F.regexp_extract(field("Authentication-Results"), rf"{n}=(\w+)", 1))
    out = raw.withColumn("head", head).select(
        "path",
        address(field("From")).alias("sender"),
        address(field("To")).alias("recipient"),
        address(field("Return-Path")).alias("return_path"),
        field("Subject").alias("subject"),
        field("Date").alias("sent"),
        result("spf").alias("spf"),
        result("dkim").alias("dkim"),
        result("dmarc").alias("dmarc"),
        F.size(F.regexp_extract_all("head", F.lit("(?im)^Received:"), F.lit(0))).alias("hops"),
    )
    domain = lambda c: F.substring_index(c, "@", -1)
    sender, back = domain(F.col("sender")), domain(F.col("return_path"))
    other = F.coalesce((F.col("return_path") != "") & (sender != back), F.lit(False))
    spoofed = F.coalesce(F.col("spf") == "fail", F.lit(False)) | F.coalesce(F.col("dkim") == "fail", F.lit(False)) | other
    return out.withColumn("lookalike", other & (F.levenshtein(sender, back) <= 2)).withColumn("spoofed", spoofed)


PHONE_DUMP = """
device_info struct<imei:string,imei2:string,imsi:string,android_id:string,model:string,android_ver:string,last_known_ip:string,mac_address:string,phone_number:string>,
installed_apps array<struct<package:string,version:string,first_install:string,certificate_sha256:string,risky_permissions:array<string>>>,
contacts array<struct<name:string,number:string,added:string>>,
call_log array<struct<number:string,type:string,date:string,duration:int>>,
sms_messages array<struct<from:string,to:string,date:string,body:string>>,
apk_artifacts array<struct<filename:string,package:string,sha256:string,signing_cert_issuer:string,embedded_urls:array<string>,permissions:array<string>>>
"""


def phone_dumps(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of the phone dumps under a path: devices, events (calls and messages), apps, contacts, artifacts."""
    return flattened_dumps(spark.read.schema(PHONE_DUMP).option("multiLine", "true").json(path).withColumn("path", F.col("_metadata.file_path")))


def flattened_dumps(raw: DataFrame) -> dict[str, DataFrame]:
    """The tables of phone_dumps from rows (path and the columns of PHONE_DUMP)."""
    owner = F.col("device_info.phone_number").alias("owner")
    at = lambda c: ist_to_utc(parsed_time(c, ["dd/MM/yyyy HH:mm:ss"]))
    calls = raw.select("path", owner, F.posexplode("call_log").alias("k", "c"))
    out = F.upper("c.type") == "OUTGOING"
    calls = calls.select("path", "k", F.lit("CALL").alias("event_type"), F.when(out, F.col("owner")).otherwise(F.col("c.number")).alias("src"), F.when(out, F.col("c.number")).otherwise(F.col("owner")).alias("dst"), at(F.col("c.date")).alias("occurred_at"), F.col("c.duration").alias("duration_sec"))
    texts = raw.select("path", owner, F.posexplode("sms_messages").alias("k", "c"))
    texts = texts.select("path", "k", F.lit("SMS").alias("event_type"), F.col("c.from").alias("src"), F.coalesce("c.to", "owner").alias("dst"), at(F.col("c.date")).alias("occurred_at"), F.lit(None).cast("int").alias("duration_sec"))
    return {
        "devices": raw.select("path", "device_info.*"),
        "events": calls.unionByName(texts),
        "apps": raw.select("path", owner, F.explode("installed_apps").alias("a")).select("path", "owner", "a.package", "a.certificate_sha256", F.size("a.risky_permissions").alias("risky_permissions")),
        "contacts": raw.select("path", owner, F.explode("contacts").alias("c")).select("path", "owner", "c.name", "c.number"),
        "artifacts": raw.select("path", owner, F.explode("apk_artifacts").alias("a")).select("path", "owner", "a.filename", "a.package", "a.sha256", "a.signing_cert_issuer", F.size("a.embedded_urls").alias("urls")),
    }


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Registers and audit logs as CSV (with header) or JSON lines, graphs as Parquet."""
    if kind == "csv":
        df.write.option("header", "true").csv(path)
    elif kind in ("json", "parquet"):
        df.write.format(kind).save(path)
    else:
        raise ValueError(f"cannot export as {kind}")


def bulk_load(events: DataFrame, entities: DataFrame, rejects: DataFrame, path: str, run_id: str) -> None:
    """Events, entities and rejects of one load as three tables under a path, by case and run."""
    for name, df in (("events", events), ("entities", entities), ("rejects", rejects)):
        save_run(df, f"{path}/{name}", run_id)


def scan_case(spark: SparkSession, path: str, case_id: str) -> DataFrame:
    """The rows of one case of a saved table: only that case's folder is read."""
    return spark.read.parquet(path).filter(F.col("case_id") == case_id)


def save_run(df: DataFrame, path: str, run_id: str, partition: str = "case_id") -> None:
    """Append a versioned result: rows of a run never replace another's."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy(partition, "run_id").parquet(path)
