"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small Parquet shards.  Shards of similar size (one tier spans a factor of `fan`) are merged
into files of the target size.  Every change writes a new manifest, moved into place without overwriting: readers see
whole versions, and of two writers of one version the later begins anew on the other's.  The manifest has a line a shard, not a row.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._store import fs_of, new_path


class ShardStore:
    """A table of shards under root; target_bytes is a finished file's size, fan the runs merged at once."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan: int = 4, least_bytes: int = 1 << 20):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.fan, self.least = target_bytes, fan, least_bytes
        self.pending: set[str] = set()  # shards that this object has written and not committed yet

    # Manifest versions

    def versions(self) -> list[int]:
        fs, p = fs_of(self.spark, f"{self.root}/_manifest")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[1:9]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the latest unless given; version 0 is the empty table."""
        found = self.versions()
        version = version if version is not None else (found[-1] if found else 0)
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        fs, p = fs_of(self.spark, f"{self.root}/_manifest/v{version:08d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, base: dict, shards: list[dict], schema: str) -> dict | None:
        """The next version after base, null if another writer made it first."""
        new = {"version": base["version"] + 1, "schema": schema, "shards": shards}
        fs, temp = fs_of(self.spark, f"{self.root}/_manifest/_{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(new, indent=1).encode()))
        out.close()
        jvm = self.spark._jvm
        final = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_manifest/v{new['version']:08d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temp, final, none)  # fails where the version exists
        except Py4JJavaError:
            fs.delete(temp, False)
            if not fs.exists(final):
                raise
            return None
        return new

    def _add(self, shards: list[dict], schema: str) -> dict:
        """Commit new shards after whatever version is the latest; an append never conflicts with another change."""
        while True:
            base = self.manifest()
            if (done := self._commit(base, base["shards"] + shards, schema)) is not None:
                return done

    def _shards(self, folder: str) -> list[dict]:
        """The Parquet files that a job wrote, as manifest entries."""
        fs, p = fs_of(self.spark, folder)
        found, files = [], fs.listFiles(p, True)
        base = fs.makeQualified(fs_of(self.spark, self.root)[1]).toString()
        while files.hasNext():
            s = files.next()
            if s.getPath().getName().endswith(".parquet"):
                found.append({"path": s.getPath().toString()[len(base) + 1 :], "bytes": s.getLen(), "modified": s.getModificationTime() / 1000})
        return sorted(found, key=lambda x: x["path"])

    # Changes

    def append(self, rows: DataFrame) -> dict:
        """Add rows as new small shards in one version; no rows commit a version without new shards.

        Nulls, repeated rows and any column names stay as they are.
        """
        folder = f"{self.root}/data/a-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        return self._add([s for s in self._shards(folder) if s["bytes"]], rows.schema.json())

    def append_each(self, rows: DataFrame, arrivals: int, key: str) -> Iterator[dict]:
        """Add rows in so many arrivals, a version for each: rows of equal key arrive together, null keys too.

        All are written in one pass; nothing of an arrival can be read before its version is there.
        """
        name = next(n for k in range(len(rows.columns) + 1) if (n := f"arrival{k or ''}") not in rows.columns)
        folder = f"{self.root}/data/a-{uuid.uuid4().hex}"
        dealt = rows.withColumn(name, F.pmod(F.xxhash64(key), F.lit(arrivals)).cast("int"))
        dealt.write.option("compression", "zstd").partitionBy(name).parquet(folder)
        found: dict[str, list[dict]] = {}
        for s in self._shards(folder):
            found.setdefault(s["path"].rsplit("/", 2)[-2], []).append(s)
        self.pending |= {s["path"] for part in found.values() for s in part}
        for part in [found[k] for k in sorted(found)] or [[]]:
            done = self._add(part, rows.schema.json())
            self.pending -= {s["path"] for s in part}
            yield done

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.least, self.fan)))

    def compact(self) -> dict:
        """Merge tiers until none holds `fan` unfinished shards; shards over half the target are finished.

        Rows stay as they are, in any order.  Where another change comes first, the merge is begun anew on its version.
        """
        while True:
            base = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for s in base["shards"]:
                if 2 * s["bytes"] < self.target:
                    tiers.setdefault(self.tier(s["bytes"]), []).append(s)
            full = [v for _, v in sorted(tiers.items()) if len(v) >= self.fan]
            if not full:
                return base
            schema = StructType.fromJson(json.loads(base["schema"]))
            gone, new = set(), []
            for run in full:
                folder = f"{self.root}/data/c-{uuid.uuid4().hex}"
                files = max(1, round(sum(s["bytes"] for s in run) / self.target))
                self._frame(run, schema).coalesce(files).write.option("compression", "zstd").parquet(folder)
                gone |= {s["path"] for s in run}
                new += self._shards(folder)
            self._commit(base, [s for s in base["shards"] if s["path"] not in gone] + new, base["schema"])

    def vacuum(self, min_age_s: float = 86_400) -> int:
        """Delete shards older than min_age_s that no version named within that time; how many.

        So a reader of a version has that long after its successor, and a writer that long between its files and its
        commit.  With 0, only the latest version can be read afterwards, and only this object's arrivals under way are safe.
        """
        fs, p = fs_of(self.spark, f"{self.root}/data")
        if not fs.exists(p):
            return 0
        now, versions = time.time(), self.versions()
        made = {v: fs.getFileStatus(fs_of(self.spark, f"{self.root}/_manifest/v{v:08d}.json")[1]).getModificationTime() / 1000 for v in versions}
        live = set(self.pending)
        for v, successor in zip(versions, [*versions[1:], None], strict=True):
            if successor is None or now - made[successor] < min_age_s:
                live |= {s["path"] for s in self.manifest(v)["shards"]}
        dead = [s for s in self._shards(f"{self.root}/data") if s["path"] not in live and now - s["modified"] >= min_age_s]
        for s in dead:
            fs.delete(fs_of(self.spark, f"{self.root}/{s['path']}")[1], False)
        return len(dead)

    # Reads

    def _frame(self, shards: list[dict], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s['path']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the latest unless given."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("nothing was appended yet")
        schema = StructType.fromJson(json.loads(m["schema"]))
        return self._frame(m["shards"], schema) if m["shards"] else self.spark.createDataFrame([], schema)


def op4(spark, sf_dir: str) -> DataFrame:
    """All documents through arrivals, compaction and vacuum, read back: doc_id, lang, source, n_bytes, text_sha256.

    Nulls stay nulls, repeated rows stay repeated; an empty table commits a version without rows.
    """
    store = ShardStore(spark, new_path(spark, "shards"))
    for _ in store.append_each(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16, "doc_id"):
        store.compact()
        store.vacuum(min_age_s=0)  # nobody else knows this store
    text = F.encode("text", "utf-8")
    return store.read().select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


OP4_SQL = """
SELECT doc_id, lang, source, octet_length(encode(text))::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents
"""
