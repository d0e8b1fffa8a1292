"""Media columns: payloads stored as lossless 8-bit images in archives, read back through a Spark data source.

``ArchiveSource`` writes ZIP archives of PNG members and reads them again. Reading is planned as
byte ranges over a folder of archives from the folder's manifest alone; a task reads the archive's own directory,
fetches each member by its offset, checks it, and retries that member alone if it fails.
"""

from __future__ import annotations

import io
import json
import struct
import time
import uuid
import warnings
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from panelith.llm.common import frugal, scratch_path, utf8

#: Samples in a line of an image; payloads are whole lines.
LINE = 576
#: The first bytes of every PNG file, a fixed value.
PNG = b"\x89PNG\r\n\x1a\n"
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 64_000_000, 8_000_000, 8_000_000
TRIES, PAUSE_S = 4, 0.2
#: Every write adds a list of its own archives; names that start so are such lists.
MANIFEST = "_manifest-"


def padded(text: bytes) -> bytes:
    """The text and bytes 255 up to a positive multiple of a line."""
    return text + b"\xff" * (max(1, -(-len(text) // LINE)) * LINE - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """The payload as a grey image of 8-bit samples, ``LINE`` wide; the unpadded length is in a private chunk."""
    lines = np.zeros((len(payload) // LINE, LINE + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"nbYt", struct.pack(">Q", n_bytes)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The payload and its unpadded length; raises ValueError where the file is not one of ours or is damaged."""
    if media[:8] != PNG:
        raise ValueError("no PNG file")
    at, n_bytes, packed, width, height = 8, -1, [], 0, 0
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", data)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("no grey 8-bit image")
        elif kind == b"nbYt":
            n_bytes = struct.unpack(">Q", data)[0]
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a line filter that is not used here")
    return lines[:, 1:].tobytes(), n_bytes


@dataclass
class Written(WriterCommitMessage):
    archives: list


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    stop: int


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes archives under names of its own; those of tasks that failed are in no manifest."""

    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options.get("archivebytes", ARCHIVE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        task, done = uuid.uuid4().hex, []
        held = archive = None

        def close() -> None:
            archive.close()
            name = f"part-{task}-{len(done):05d}.zip"
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(held.getbuffer())
            done.append([name, len(held.getbuffer())])

        n = 0
        for batch in iterator:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                if archive is None:
                    held = io.BytesIO()
                    archive = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(f"{n}/{'' if doc_id is None else doc_id}.png"), to_png(padded(text), len(text)))
                n += 1
                if held.tell() >= self.limit:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Written(done)

    def commit(self, messages: list) -> None:
        archives = sorted(a for m in messages if m is not None for a in m.archives)
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(archives).encode())

    def abort(self, messages: list) -> None:
        system, folder = _place(self.path)
        for m in messages:
            for name, _ in m.archives if m is not None else []:
                system.delete_file(f"{folder}/{name}")


def directory(handle) -> list[tuple[str, int, int, int]]:
    """Name, offset, stored size and CRC of each member, from the archive's own directory."""

    with zipfile.ZipFile(handle) as archive, warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return [(x.filename, x.header_offset, x.compress_size, x.CRC) for x in archive.infolist()]


def member(handle, offset: int, size: int, crc: int) -> bytes:
    """One stored member by its offset, checked."""
    handle.seek(offset)
    head = handle.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {offset}")
    name, extra = struct.unpack_from("<HH", head, 26)
    handle.seek(offset + 30 + name + extra)
    data = handle.read(size)
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError(f"damaged member at {offset}")
    return data


def retried(act, again, tries: int = TRIES):
    """``act()``, after ``again()`` and a growing pause if it failed; the last failure is raised."""
    for turn in range(tries):
        try:
            return act()
        except (OSError, ValueError, struct.error, zlib.error, zipfile.BadZipFile):
            if turn == tries - 1:
                raise
            time.sleep(PAUSE_S * 2**turn)
            again()


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.span = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        """Ranges over the archives of the manifest; the members are not looked at here."""
        system, folder = _place(self.path)
        archives = []
        for file in system.get_file_info(fs.FileSelector(folder)):
            if file.base_name.startswith(MANIFEST):
                with system.open_input_stream(file.path) as f:
                    archives += json.loads(f.read())
        archives.sort()
        return [ByteRange(name, a, min(size, a + self.span)) for name, size in archives for a in range(0, size, self.span)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        system, folder = _place(self.path)
        path = f"{folder}/{partition.archive}"
        held = {"f": system.open_input_file(path)}

        def reopen() -> None:
            held["f"].close()
            held["f"] = system.open_input_file(path)

        names = retried(lambda: directory(held["f"]), reopen)
        rows: list[tuple] = []
        size = 0
        for name, offset, length, crc in names:
            if not partition.start <= offset < partition.stop:
                continue
            media = retried(lambda o=offset, n=length, c=crc: member(held["f"], o, n, c), reopen)
            text_id = name.split("/", 1)[1].removesuffix(".png")
            rows.append((int(text_id) if text_id else None, partition.archive, offset, media))
            size += length
            if size >= BATCH_BYTES:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)
        held["f"].close()

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "archive", "offset", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)`` and ``df.write.format("media_archive").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, archive string, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options)


def write_archives(docs: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One member a row of ``docs``. A null text is empty and stored as one line of padding; null ids are kept.

    Writing to a folder again adds to what is there.
    """
    docs.sparkSession.dataSource.register(ArchiveSource)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own.write.format("media_archive").option("archiveBytes", archive_bytes).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id, archive, offset, media``: one row a member."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("rangeBytes", range_bytes).load(path)


def feature(payload: bytes) -> str:
    """Sum, sum of squares, sum of steps between neighbours, and a 16-part histogram of the samples."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    levels = np.arange(256)
    moves = int(np.abs(np.diff(samples.astype(np.int16))).sum())
    parts = ",".join(map(str, counts.reshape(16, 16).sum(axis=1).tolist()))
    return f"{int(counts @ levels)};{int(counts @ levels**2)};{moves};{parts}"


def features(media: DataFrame) -> DataFrame:
    """Per member, from its stored bytes alone: lengths, digests and the feature of its payload.

    A null id stays null; equal members give equal values; a member that is no image of ours raises ValueError.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for stored in batch.column("media").to_pylist():
                payload, n_bytes = from_png(stored)
                rows.append((n_bytes, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), sha256(stored).hexdigest(), feature(payload)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[x.split()[0] for x in schema.split(", ")])

    return media.select("doc_id", "media").mapInArrow(frugal(run, "media"), schema)


def stored_features(docs: DataFrame) -> DataFrame:
    """Archives of all texts in the shared folder, and the features of what is read back.

    One row per input row; equal texts give equal values, as nothing in a member depends on the id; other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "media")
    write_archives(docs, path)
    return features(read_archives(spark, path))
