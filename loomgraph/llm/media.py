"""Media columns: payloads as images in archives, read through a Spark data source.

A payload's bytes become the samples of an 8-bit greyscale PNG image of ROW samples a line. Each task writes
its images into ZIP archives of its own in the shared folder. The data source plans byte ranges over the
archives from their sizes alone; a reader finds its members in the archive's directory (those whose header
begins in its range) and streams them as Arrow batches. A member that cannot be read is read again by its offset
through a new handle, and no other member with it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from loomgraph.llm.common import new_path, stored

ROW = 192
PAD = b" "
#: A task begins a new archive beyond so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Bytes of an archive that one partition reads.
RANGE_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_OWN_BYTES = b"loBy"  # ancillary, private, safe to copy: the bytes before padding


def payload(text: str | None) -> tuple[bytes, int]:
    """text as UTF-8, padded to a positive multiple of ROW, and its length before that."""
    raw = (text or "").encode()
    return raw + PAD * (ROW - len(raw) if not raw else -len(raw) % ROW), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes, n_bytes: int) -> bytes:
    """An 8-bit greyscale image of len(samples) / ROW lines without filters."""
    lines = len(samples) // ROW
    grid = np.zeros((lines, ROW + 1), np.uint8)
    grid[:, 1:] = np.frombuffer(samples, np.uint8).reshape(lines, ROW)
    header = struct.pack(">IIBBBBB", ROW, lines, 8, 0, 0, 0, 0)
    return b"".join(
        [_SIGNATURE, _chunk(b"IHDR", header), _chunk(_OWN_BYTES, struct.pack(">Q", n_bytes)), _chunk(b"IDAT", zlib.compress(grid, 1)), _chunk(b"IEND", b"")]
    )


def from_png(image: bytes) -> tuple[bytes, int]:
    """The samples and the number of bytes before padding; checks every chunk's sum."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, width, lines, n_bytes = 8, [], 0, 0, -1
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            width, lines = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == _OWN_BYTES:
            (n_bytes,) = struct.unpack(">Q", body)
        at += 12 + n
    grid = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(lines, width + 1)
    if grid[:, 0].any():
        raise ValueError("filtered lines")
    return grid[:, 1:].tobytes(), n_bytes


def feature(samples: bytes) -> str:
    """Mean and deviation of the samples, mean step between neighbours, and their 8-bin histogram."""
    x = np.frombuffer(samples, np.uint8)
    bins = np.bincount(x >> 5, minlength=8).tolist()
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    steps = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    mean = total / len(x)
    return f"mean={mean:.4f};sd={max(0.0, squares / len(x) - mean * mean) ** 0.5:.4f};step={steps / max(1, len(x) - 1):.4f};bins={'/'.join(map(str, bins))}"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a member a document and returns the stored manifest (archive, n_members, n_bytes).

    An archive gets its name when it is complete, and the manifest holds what the tasks that counted
    wrote, so archives of lost or repeated tasks are never read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(folder)
        where.create_dir(base, recursive=True)
        out = archive = None
        name, members = "", 0

        def done() -> pa.RecordBatch:
            archive.close()
            n = out.tell()
            out.close()
            where.move(f"{base}/.{name}", f"{base}/{name}")
            return pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([members], pa.int64()), pa.array([n], pa.int64())], names=["archive", "n_members", "n_bytes"])

        for batch in batches:
            for i, text in zip(batch.column("doc_id"), batch.column("text")):
                if archive is None:
                    name, members = f"{uuid.uuid4().hex}.zip", 0
                    out = where.open_output_stream(f"{base}/.{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                key = "" if i.as_py() is None else str(i.as_py())
                info = zipfile.ZipInfo(f"{members}/{key}.png")
                archive.writestr(info, to_png(*payload(text.as_py())))
                members += 1
                if out.tell() >= ARCHIVE_BYTES:
                    yield done()
                    archive = None
        if archive is not None:
            yield done()

    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return stored(held.mapInArrow(write, "archive string, n_members long, n_bytes long"), "archives")


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int

    def __post_init__(self) -> None:
        self.value = 0


def member_at(where: fs.FileSystem, path: str, offset: int, size: int) -> bytes:
    """The stored bytes of the member whose local header begins at offset."""
    with where.open_input_file(path) as f:
        f.seek(offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise OSError(f"no member at {offset} of {path}")
        name, extra = struct.unpack_from("<HH", head, 26)
        f.seek(offset + 30 + name + extra)
        data = f.read(size)
        if len(data) != size:
            raise OSError(f"{path} ends within the member at {offset}")
        return data


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", 4))
        self.archives = options.get("archives", "")

    def partitions(self) -> list[InputPartition]:
        where, base = filesystem(self.manifest)
        import pyarrow.dataset as ds

        found = ds.dataset(base, filesystem=where, format="parquet", exclude_invalid_files=False).to_table(columns=["archive", "n_bytes"])
        ranges = []
        for archive, n in zip(found.column("archive").to_pylist(), found.column("n_bytes").to_pylist()):
            ranges += [ByteRange(archive, at, at + self.range_bytes) for at in range(0, n, self.range_bytes)]
        return ranges

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archives, no ranges
            return
        where, path = filesystem(partition.archive)

        def again(action):
            for attempt in range(self.attempts):
                try:
                    return action()
                except (OSError, zipfile.BadZipFile, zlib.error):
                    if attempt + 1 == self.attempts:
                        raise

        def directory() -> list[tuple[int, int, int, str]]:
            with where.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                return [(m.header_offset, m.compress_size, m.CRC, m.filename) for m in z.infolist() if partition.start <= m.header_offset < partition.end]

        def member(offset: int, size: int, crc: int) -> bytes:
            data = member_at(where, path, offset, size)
            if zlib.crc32(data) != crc:
                raise OSError(f"damaged member at {offset} of {path}")
            return data

        names, blobs, held = [], [], 0
        for offset, size, crc, name in sorted(again(directory)):
            blobs.append(again(lambda: member(offset, size, crc)))
            names.append(name)
            held += size
            if held >= BATCH_BYTES:
                yield self.batch(names, blobs)
                names, blobs, held = [], [], 0
        if names:
            yield self.batch(names, blobs)

    @staticmethod
    def batch(names: list[str], blobs: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(names), pa.array(blobs, pa.binary())], names=["member", "media"])


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(manifest)``: member, media, as the manifest's archives hold them."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "member string, media binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as an image, and returns from the stored bytes: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature.

    Null and empty texts are one line of padding. Null ids stay null. Each of repeated rows is a member.
    An empty table gives an empty one. Other columns are not looked at; ids are integers.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "media")
    manifest = write_archives(docs, folder, id_col, text_col).inputFiles()
    spark.dataSource.register(MediaArchives)
    media = spark.read.format("media_archives").load(manifest[0].rsplit("/", 1)[0]) if manifest else spark.createDataFrame([], "member string, media binary")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, image in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist()):
                samples, n = from_png(image)
                key = name.split("/")[1].removesuffix(".png")
                rows.append((int(key) if key else None, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=NAMES)

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(digest, kinds)


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
