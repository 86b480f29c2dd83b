"""Media columns: content-addressed payloads in tar shards.

Each distinct payload becomes a tar member named by its digest (an 8-bit grey PNG of 192 samples a row); table rows
carry digest, shard, offset and length only.  Metadata columns come from range reads of the PNG headers, features
from range reads of the members.  Shards are written under attempt names and moved when whole; rows of the attempt
that Spark commits are the index, so a lost executor leaves at most an unreferenced file.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import new_path, ready, written

ROW = 192
SHARD_BYTES = 64 << 20
#: Bytes of a shard that one reading task takes.
SPAN = 8 << 20
#: Payloads that a writing task remembers to store equal ones once; beyond it, it starts anew.
PLACES = 100_000
_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Signature and IHDR chunk.
HEADER = 33


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(payload: bytes) -> bytes:
    """The payload with spaces appended up to a positive multiple of a row."""
    return payload.ljust(max(1, -(-len(payload) // ROW)) * ROW, b" ")


def encode(samples: bytes) -> bytes:
    """A PNG whose grey samples are these bytes."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first bytes of a PNG."""
    if start[:8] != _MAGIC or start[12:16] != b"IHDR" or zlib.crc32(start[12:29]) != int.from_bytes(start[29:33], "big"):
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", start[16:25])


def decode(media: bytes) -> bytes:
    """The samples of a PNG that encode() wrote."""
    width, height, _ = header(media[:HEADER])
    at, data = HEADER, []
    while (kind := media[at + 4 : at + 8]) != b"IEND":
        n = int.from_bytes(media[at : at + 4], "big")
        if zlib.crc32(media[at + 4 : at + 8 + n]) != int.from_bytes(media[at + 8 + n : at + 12 + n], "big"):
            raise ValueError("broken PNG chunk")
        if kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered PNG lines")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Counts of the samples in 16 equal classes of brightness."""
    return "-".join(map(str, np.bincount(np.frombuffer(samples, np.uint8) >> 4, minlength=16).tolist()))


class _Shards:
    """The shards that one task attempt writes."""

    def __init__(self, folder: str, shard_bytes: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.uri, self.limit = folder, shard_bytes
        self.out, self.k, self.at = None, 0, 0
        self.fs.create_dir(self.folder, recursive=True)
        c = TaskContext.get()
        self.task = f"{c.partitionId():06d}-{c.taskAttemptId()}"

    def name(self) -> str:
        return f"shard-{self.task}-{self.k:04d}.tar"

    def add(self, digest: str, media: bytes) -> tuple[str, int]:
        """Append a member; its shard and the offset of its bytes."""
        if self.out is not None and self.at >= self.limit:
            self.close()
        if self.out is None:
            self.out, self.at = self.fs.open_output_stream(f"{self.folder}/_{self.name()}"), 0
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(media)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + media + bytes(-len(media) % 512))
        offset = self.at + len(head)
        self.at = offset + len(media) + -len(media) % 512
        return self.name(), offset

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.fs.move(f"{self.folder}/_{self.name()}", f"{self.folder}/{self.name()}")
            self.out, self.k = None, self.k + 1


def store(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the payloads of docs to tar shards in folder: doc_id, n_bytes, digest, shard, offset, length.

    Null texts count as empty; equal payloads of a task are stored once and those of different tasks get one
    canonical place by digest; repeated rows get a row each; an empty table writes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, places = None, {}
        for batch in batches:
            shards = shards or _Shards(folder, shard_bytes)
            out: list[list] = [[], [], [], [], []]
            for value in batch.column(1):
                raw = (value.as_py() or "").encode()
                payload = padded(raw)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in places:
                    if len(places) >= PLACES:
                        places = {}
                    media = encode(payload)
                    places[digest] = (*shards.add(digest, media), len(media))
                for column, x in zip(out, (len(raw), digest, *places[digest]), strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shards:
            shards.close()

    ready(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = written(rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, digest string, shard string, offset long, length long"), "media-rows")
    place = made.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return made.select("doc_id", "n_bytes", "digest").join(place, "digest").select("doc_id", "n_bytes", "digest", "at.*")


def _read(index: DataFrame, folder: str, columns: str, one) -> DataFrame:
    """one(read(at, n), offset, length) for each distinct member of the index, in the order of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        shard, file = None, None
        for batch in batches:
            rows = []
            for digest, name, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if name != shard:
                    shard, file = name, fs.open_input_file(f"{base}/{name}")
                rows.append((digest, *one(lambda at, n, f=file: f.read_at(n, at), offset, length)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [c.split()[0] for c in f"digest string, {columns}".split(", ")])

    members = index.select("digest", "shard", "offset", "length").distinct()
    dealt = members.repartition("shard", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(run, f"digest string, {columns}")


def metadata(index: DataFrame, folder: str) -> DataFrame:
    """digest, width, height, depth, by reading only the headers."""
    return _read(index, folder, "width long, height long, depth long", lambda read, at, n: header(read(at, HEADER)))


def _contents(read, at: int, n: int) -> tuple:
    media = read(at, n)
    samples = decode(media)
    return (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples))


def contents(index: DataFrame, folder: str) -> DataFrame:
    """Digests and features of the whole members as read back, by digest."""
    return _read(index, folder, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", _contents)


def described(index: DataFrame, folder: str) -> DataFrame:
    """contents() and metadata() of each member in one pass: a range read of its header, then one of the whole."""
    kinds = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long, depth long"
    return _read(index, folder, kinds, lambda read, at, n: (*_contents(read, at, n), *header(read(at, HEADER))))


def op3(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "media-shards")
    index = store(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    read = written(described(index, folder), "media-contents")
    return index.select("doc_id", "n_bytes", "digest").join(read, "digest").drop("digest")
