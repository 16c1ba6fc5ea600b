"""Media columns: content-addressed payloads in tar shards.

A payload is stored as a grey PNG of 8-bit samples, 576 wide, one tar member named by the payload's SHA-256. Each task writes
one shard and keeps a payload only once in it; index rows carry digest, shard, offset and length. read_headers fills the metadata columns
from header-only range reads (the 33 bytes of signature and IHDR), read_features reads the stored bytes back in full. Either works on
the index alone, dealt out by place, so that each payload is read by one task and the tasks have about as much to read.

No payload is shuffled: rows stay with their task's shard, so a digest is stored once a shard, and copies in different
shards are the same bytes under the same name. Shards go to the shared folder through pyarrow's file systems (local, HDFS, S3 or GCS by
the folder's scheme). A shard is named by its content's digest and put in place by a rename, so a task that runs again writes the
same file, and a lost executor loses none; what failed tasks have begun is deleted once the index is written. media_report writes its
result and then deletes the shards.

Cases: a null text is an empty payload, padded like any other; payloads are padded with bytes 255 up to a positive multiple
of 576. Repeated rows and equal texts get equal values. An empty table gives an empty result and no shard. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm.common import delete_path, fresh_path, materialize, text_slices
from sparkfolio.session import ship_package

WIDTH = 576
HEADER = 33
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes after which a task starts another shard.
SHARD_BYTES = 64 << 20
#: Stored bytes that a task reads back.
READ_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
INDEX = ("_id", "n_bytes", "digest", "offset", "length", "shard")


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    padded = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH)
    return len(raw), raw.ljust(padded, b"\xff")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_encode(payload: bytes) -> bytes:
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # filter type 0 before each row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEADER bytes."""
    if head[:8] != PNG_SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def png_decode(stored: bytes) -> bytes:
    width, height, _ = png_header(stored[:HEADER])
    at, data = HEADER, []
    while True:
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IDAT":
            data.append(body)
        if kind == b"IEND":
            break
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only filter type 0 is written here")
    return rows[:, 1:].tobytes()


class _Shard:
    """A tar file in the making."""

    def __init__(self, folder: str, task: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.temporary = f"{self.root}/_writing-{task}"
        self.stream = self.fs.open_output_stream(self.temporary)
        self.hash = hashlib.sha256()
        self.at = 0
        self.places: dict[bytes, tuple[int, int]] = {}

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.hash.update(data)
        self.at += len(data)

    def add(self, digest: bytes, stored: bytes) -> tuple[int, int]:
        if digest not in self.places:
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(stored)
            self._write(info.tobuf(tarfile.USTAR_FORMAT))
            self.places[digest] = self.at, len(stored)
            self._write(stored + b"\0" * (-len(stored) % 512))
        return self.places[digest]

    def close(self) -> str:
        self._write(b"\0" * 1024)
        self.stream.close()
        name = f"{self.hash.hexdigest()[:32]}.tar"
        self.fs.move(self.temporary, f"{self.root}/{name}")
        return name


def _writer(folder: str, shard_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        shard, held, number = None, [], 0

        def flush() -> pa.RecordBatch:
            name = shard.close()
            ids = pa.chunked_array([c for c, _ in held]).combine_chunks()
            rows = [r for _, rs in held for r in rs]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays([ids, *columns, pa.array([name] * len(rows), pa.string())], ["_id", "n_bytes", "payload_bytes", "digest", "offset", "length", "shard"])

        for batch in batches:
            done: list[tuple] = []
            start = 0
            for k, text in enumerate(t for _, texts in text_slices(batch, 1, BATCH_BYTES) for t in texts):
                if shard is None:
                    shard = _Shard(folder, f"{context.taskAttemptId()}-{number}")
                    number += 1
                size, payload = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                place = shard.places.get(digest) or shard.add(digest, png_encode(payload))
                done.append((size, len(payload), digest, *place))
                if shard.at >= shard_bytes:
                    held.append((batch.column(0)[start : k + 1], done))
                    yield flush()
                    shard, held, done, start = None, [], [], k + 1
            if done:
                held.append((batch.column(0)[start:], done))
        if shard is not None:
            yield flush()

    return write


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of what the shards in folder/shards hold: id, n_bytes, payload_bytes, digest, offset, length, shard."""
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    shards = f"{folder}/shards"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(shards)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, n_bytes long, payload_bytes long, digest binary, offset long, length long, shard string"
    rows.mapInArrow(_writer(shards, shard_bytes), schema).write.parquet(f"{folder}/index")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for left in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{shards}/_writing-*")) or ():
        files.delete(left.getPath(), False)
    return spark.read.schema(schema).parquet(f"{folder}/index")


def feature_of(samples: np.ndarray) -> str:
    """Mean, deviation, mean step between neighbours and entropy of the samples."""
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    signed = samples.astype(np.int16)
    step = np.abs(np.diff(signed)).mean() if len(samples) > 1 else 0.0
    return f"mean={samples.mean():.4f};std={samples.std():.4f};step={step:.4f};entropy={-(share * np.log2(share)).sum():.4f}"


def _at_places(folder: str, read, kinds: list[tuple[str, pa.DataType]]):
    """Adds the columns `kinds` that read(file, offset, length) gives, once for each place."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, source, seen = None, None, {}
        for batch in batches:
            out: list[tuple] = []
            for shard, offset, length in zip(*(batch.column(k).to_pylist() for k in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    if source is not None:
                        source.close()
                    name, source = shard, fs.open_input_file(f"{root}/{shard}")
                if (shard, offset) not in seen:
                    seen = {(shard, offset): read(source, offset, length)}  # rows come by place: one is enough to remember
                out.append(seen[shard, offset])
            columns = [pa.array([r[k] for r in out], kind) for k, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(n for n, _ in kinds)])
        if source is not None:
            source.close()

    return add


def by_place(index: DataFrame) -> DataFrame:
    """The index in ranges of places, with about READ_BYTES of payloads each."""
    total = index.agg(F.sum("length")).first()[0] or 0
    return index.repartitionByRange(max(1, -(-int(total) // READ_BYTES)), "shard", "offset").sortWithinPartitions("shard", "offset")


def read_headers(index: DataFrame, folder: str) -> DataFrame:
    """index (sorted by place) with width, height and depth, from the payloads' first HEADER bytes alone."""
    ship_package(index.sparkSession)
    header = lambda file, offset, length: png_header(file.read_at(HEADER, offset))
    kinds = [("width", pa.int32()), ("height", pa.int32()), ("depth", pa.int32())]
    return index.mapInArrow(_at_places(f"{folder}/shards", header, kinds), _ddl(index) + ", width int, height int, depth int")


def read_features(index: DataFrame, folder: str) -> DataFrame:
    """index (sorted by place) with digests and features from the stored bytes."""
    ship_package(index.sparkSession)

    def features(file, offset: int, length: int) -> tuple:
        stored = file.read_at(length, offset)
        payload = png_decode(stored)
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(),
            feature_of(np.frombuffer(payload, np.uint8)),
        )

    kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return index.mapInArrow(_at_places(f"{folder}/shards", features, kinds), _ddl(index) + schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def media_columns(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text of docs as media in folder (one in the shared folder by default) and reads it back."""
    folder = folder or fresh_path(docs.sparkSession, "media")
    index = by_place(store(docs, folder, id_col, text_col).select(*INDEX))
    return read_features(read_headers(index, folder), folder).withColumnRenamed("_id", id_col)


def media_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """media_columns, written; the media themselves are deleted."""
    folder = fresh_path(docs.sparkSession, "media")
    found = materialize(media_columns(docs, folder, id_col, text_col), "media-columns")
    forget(docs.sparkSession, folder)
    return found


def forget(spark: SparkSession, folder: str) -> None:
    delete_path(spark, folder)
