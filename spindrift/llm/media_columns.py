"""Media columns: payloads kept as images in archives, read back by a Spark data source of byte ranges.

``store`` writes each task's rows as members of one zip archive (members are 8-bit grey PNG images, lossless) in the shared
folder, under a name of its own for each attempt, and a manifest of the archives that finished: their byte ranges, each with
the directory of its members. ``ArchiveSource`` plans a partition for each range, from the manifest or, for archives without
one, from their sizes; a range owns the members whose headers start in it. It streams members in Arrow batches of bounded
size, and reads each again by its offset if reading fails, without touching the others. File access goes through pyarrow's
file systems, so the shared folder may be local, HDFS or an object store.

Defined cases: a null text is an empty one; a payload is never empty (64 bytes of 0 at least); equal texts give equal
images; a null id stays null; repeated rows are members each; an empty table gives no rows; a member that can't be read or
fails its checksum after ``ATTEMPTS`` raises an error, or with ``on_error="row"`` gives a row with the error and no data.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spindrift.llm.storage import fresh_path, type_of

WIDTH = 64
RANGE_BYTES, BATCH_BYTES, ATTEMPTS = 16 << 20, 4 << 20, 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(payload: bytes, n_bytes: int) -> bytes:
    """Rows of 64 grey samples; the unpadded length is a text chunk."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # a leading 0: no filter
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def samples(image: bytes) -> tuple[bytes, int]:
    """The samples of an image of ``png`` and the unpadded length. Checks every checksum."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, n_bytes, shape = 8, [], 0, (0, 0)
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of {kind!r} differs")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"tEXt":
            n_bytes = int(body.split(b"\0")[1])
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not of this writer")
    return lines[:, 1:].tobytes(), n_bytes


def feature(payload: bytes) -> str:
    """Size, mean, deviation and entropy of the samples, and a 64-bit difference hash of the image shrunk to 8 lines of 9."""
    x = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    share = np.bincount(x.ravel(), minlength=256) / x.size
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    mean = (share * np.arange(256)).sum()
    deviation = np.sqrt((share * (np.arange(256) - mean) ** 2).sum())
    lines = np.array([x[i * len(x) // 8 : max((i + 1) * len(x) // 8, i * len(x) // 8 + 1)].mean(axis=0) for i in range(8)])
    small = np.array([lines[:, j * WIDTH // 9 : (j + 1) * WIDTH // 9].mean(axis=1) for j in range(9)]).T
    bits = "".join("1" if b else "0" for b in (small[:, 1:] > small[:, :-1]).ravel())
    return f"{WIDTH}x{len(x)};mean={mean:.4f};deviation={deviation:.4f};entropy={entropy:.4f};dhash={int(bits, 2):016x}"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def store(df: DataFrame, *, key: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> str:
    """Writes the images of all rows, one archive for each task that had rows, and returns the manifest's path: a Parquet table
    with a row for each byte range of about ``range_bytes`` and the directory of the members that begin in it. Archives of
    attempts that didn't finish are removed."""
    folder = fresh_path(df.sparkSession, "media")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip"
        archive = sink = None
        n = 0
        for batch in batches:
            for doc_id, string in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if archive is None:
                    where, path = _open(name)
                    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    sink = where.open_output_stream(path)
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                payload = payload_of(string.as_py())
                n_bytes = len(string.as_buffer()) if string.is_valid else 0
                archive.writestr(zipfile.ZipInfo(f"{n:08d}{'' if doc_id is None else '.' + quote(str(doc_id), safe='')}.png"), png(payload, n_bytes))
                n += 1
        if archive is not None:
            members = [(m.header_offset, m.filename, m.file_size, m.CRC) for m in archive.infolist()]
            archive.close()
            sink.close()
            begun = 0
            for i in range(1, len(members) + 1):
                if i == len(members) or members[i][0] - members[begun][0] >= range_bytes:
                    yield pa.RecordBatch.from_pylist([{"path": name, "start": members[begun][0], "members": [dict(zip(_DIRECTORY, m, strict=True)) for m in members[begun:i]]}], schema=_MANIFEST)
                    begun = i

    manifest = fresh_path(df.sparkSession, "manifest")
    rows = df.select(F.col(key).cast("string"), F.col(text).cast("string")).mapInArrow(written, "path string, start long, members array<struct<offset: long, name: string, size: long, crc: long>>")
    rows.write.parquet(manifest)
    where, path = _open(folder)
    if where.get_file_info(path).type != fs.FileType.NotFound:
        kept = {r.path.rsplit("/", 1)[1] for r in df.sparkSession.read.parquet(manifest).select("path").distinct().toLocalIterator()}
        for info in where.get_file_info(fs.FileSelector(path)):
            if info.base_name not in kept:
                where.delete_file(info.path)
    return manifest


_DIRECTORY = ("offset", "name", "size", "crc")
_MANIFEST = pa.schema([("path", pa.string()), ("start", pa.int64()), ("members", pa.list_(pa.struct([("offset", pa.int64()), ("name", pa.string()), ("size", pa.int64()), ("crc", pa.int64())])))])


@dataclass
class ByteRange(InputPartition):
    """Members of an archive from one offset on, up to another; ``manifest``: the file that lists them, if there is one."""

    path: str
    start: int
    end: int
    manifest: str | None = None


class ArchiveSource(DataSource):
    """Options: manifest (the path of ``store``'s table) or archives (a list of [path, bytes] as JSON), on_error (fail or row),
    range_bytes (for archives)."""

    @classmethod
    def name(cls) -> str:
        return "member_archive"

    def schema(self) -> str:
        return "path string, offset long, name string, data binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


_MEMBERS = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("name", pa.string()), ("data", pa.binary()), ("error", pa.string())])


class ArchiveReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.manifest, self.archives = options.get("manifest"), json.loads(options.get("archives", "[]"))
        self.fail = options.get("on_error", "fail") == "fail"
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        found = [ByteRange(path, at, min(at + self.range_bytes, size)) for path, size in self.archives for at in range(0, size, self.range_bytes)]
        if self.manifest:
            where, path = _open(self.manifest)
            for info in where.get_file_info(fs.FileSelector(path)):
                if info.base_name.endswith(".parquet"):
                    with where.open_input_file(info.path) as file:  # the members themselves stay unread
                        for r in pq.read_table(file, columns=["path", "start"]).to_pylist():
                            found.append(ByteRange(r["path"], r["start"], 0, info.path))
        return found or [ByteRange("", 0, 0)]

    def _directory(self, partition: ByteRange) -> list[tuple[int, str, int, int]]:
        if partition.manifest:
            where, _ = _open(self.manifest)
            with where.open_input_file(partition.manifest) as file:
                (row,) = pq.read_table(file, filters=[("path", "=", partition.path), ("start", "=", partition.start)]).to_pylist()
            return [tuple(m[k] for k in _DIRECTORY) for m in row["members"]]
        where, path = _open(partition.path)
        with where.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
            return [(m.header_offset, m.filename, m.file_size, m.CRC) for m in archive.infolist() if partition.start <= m.header_offset < partition.end]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        mine = self._directory(partition)
        where, path = _open(partition.path)
        rows, held = [], 0
        for offset, name, size, crc in mine:
            data, error = self._member(where, path, offset, size, crc)
            if error and self.fail:
                raise OSError(f"member {name} at {offset} of {partition.path}: {error}")
            rows.append((partition.path, offset, name, data, error))
            held += size
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MEMBERS, strict=True)], schema=_MEMBERS)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MEMBERS, strict=True)], schema=_MEMBERS)

    @staticmethod
    def _member(where: fs.FileSystem, path: str, offset: int, size: int, crc: int) -> tuple[bytes | None, str | None]:
        """One member's bytes by the offset of its header; opened anew for each attempt."""
        error = ""
        for attempt in range(ATTEMPTS):
            try:
                with where.open_input_file(path) as file:
                    head = file.read_at(30, offset)
                    names, extra = struct.unpack_from("<HH", head, 26)
                    data = file.read_at(size, offset + 30 + names + extra)
                if head[:4] != b"PK\x03\x04" or len(data) != size or zlib.crc32(data) != crc:
                    raise OSError("header or checksum differs")
                return data, None
            except (OSError, struct.error) as e:
                error = str(e)
                time.sleep(0.05 * attempt)
        return None, error


_OUT = pa.schema([("doc_id", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def media_columns(spark: SparkSession, df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores all rows' payloads and returns what reading the stored bytes gives, a row per document."""
    manifest = store(df, key=key, text=text)
    spark.dataSource.register(ArchiveSource)
    members = spark.read.format("member_archive").option("manifest", manifest).load()

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload, n_bytes = samples(image)
                doc_id = name.removesuffix(".png").partition(".")
                rows.append((unquote(doc_id[2]) if doc_id[1] else None, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    found = members.select("name", "data").mapInArrow(read_back, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.withColumn("doc_id", F.col("doc_id").cast(type_of(df, key)))
