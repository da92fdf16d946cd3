"""Token files: documents as separately compressed id arrays under one shared dictionary.

A file (all numbers little-endian):

    magic "VTOK1", sha256 of the dictionary (32 bytes; zeros without one), width of an id in
    bytes (1 byte), partition and place in it (2 x u32), number of documents (u32),
    index: per document doc_id (i64), 1 if it has one (u8), offset of its frame (u64), n_tokens (u64),
    frames: one zstandard frame per document, of its ids

A short document is read by one look into the index and one frame. Files are in ascending
doc_id order by (partition, place), documents inside a file too. The dictionary is trained on
the serialized ids of a bounded sample and kept beside the files.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velomart.llm.common import bounded_sample, read_blobs, slices, stage, write_blobs
from velomart.llm.tokens import UnitEncoder
from velomart.sinks.tables import work_folder

MAGIC = b"VTOK1"
HEAD = "<5s32sBIII"
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("n_tokens", "<u8")])
#: Serialized ids that a file holds at most, about.
FILE_BYTES = 8_000_000
#: The dictionary's training sample: so many documents, so many leading characters of each.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 800, 8_000, 64_000
LEVEL = 1


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; with too few samples to train on, the samples themselves."""
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(content: bytes) -> zstd.ZstdCompressionDict | None:
    return zstd.ZstdCompressionDict(content) if len(content) >= 8 else None


def _digest(content: bytes) -> bytes:
    return hashlib.sha256(content).digest() if len(content) >= 8 else bytes(32)


def _serialized(ids: bytes, width: int) -> bytes:
    own = np.frombuffer(ids, "<u4")
    if len(own) and int(own.max()) >> (8 * width):
        raise ValueError(f"id {own.max()} does not fit into {width} bytes")
    return own.astype(f"<u{width}").tobytes()


def file_bytes(rows: list[tuple], dictionary: bytes, width: int, partition: int, place: int) -> bytes:
    """One file from (doc_id, ids as 32-bit bytes) rows."""
    if shared := _dictionary(dictionary):
        shared.precompute_compress(level=LEVEL)
    compressor = zstd.ZstdCompressor(level=LEVEL, dict_data=shared)
    frames = [compressor.compress(_serialized(ids, width)) for _, ids in rows]
    index = np.zeros(len(rows), INDEX)
    index["doc_id"] = [0 if key is None else key for key, _ in rows]
    index["has_id"] = [key is not None for key, _ in rows]
    sizes = np.array([len(f) for f in frames], np.uint64)
    index["offset"] = struct.calcsize(HEAD) + index.nbytes + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.uint64)
    index["n_tokens"] = [len(ids) // 4 for _, ids in rows]
    head = struct.pack(HEAD, MAGIC, _digest(dictionary), width, partition, place, len(rows))
    return b"".join([head, index.tobytes(), *frames])


class TokenFile:
    """A file's index at hand, its documents read one by one."""

    def __init__(self, content: bytes, dictionary: bytes):
        magic, digest, self.width, self.partition, self.place, n = struct.unpack_from(HEAD, content)
        if magic != MAGIC or digest != _digest(dictionary):
            raise ValueError("not a token file of this dictionary")
        self.content = content
        self.index = np.frombuffer(content, INDEX, n, struct.calcsize(HEAD))
        self._reader = zstd.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document; only its frame is touched."""
        entry = self.index[k]
        size = int(entry["n_tokens"]) * self.width
        frame = memoryview(self.content)[int(entry["offset"]) :]
        if k + 1 < len(self.index):
            frame = frame[: int(self.index[k + 1]["offset"] - entry["offset"])]
        raw = self._reader.decompressobj().decompress(frame)
        assert len(raw) == size
        return np.frombuffer(raw, f"<u{self.width}")


@dataclass
class TokenFiles:
    path: str
    dictionary: bytes


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, width: int | None = None) -> TokenFiles:
    """Write (doc_id, text) as token files in ascending doc_id order, a null id first; null text: the end id alone.

    ``width``: bytes of an id, 2 or 4, by default as few as the vocabulary needs; an id beyond it is an error. One shuffle, of the texts, by range of
    doc_id; further columns are left out, rows with one doc_id are kept as documents of their own.
    """
    spark = docs.sparkSession
    path = f"{work_folder(spark)}/tokens"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Of long texts a stretch at a hashed place.
    start = 1 + F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.char_length("text") - SAMPLE_CHARS + 1)).cast("int")
    sample = bounded_sample(docs, "doc_id", SAMPLE_DOCS).select(F.substr("text", start, F.lit(SAMPLE_CHARS)).alias("text")).collect()
    encoder = UnitEncoder(tokenizer, True, end_id)
    width = width or encoder.width
    dictionary = train_dictionary([_serialized(x, width) for x in encoder.encode([r.text for r in sample])])
    write_blobs(spark.createDataFrame([(bytearray(dictionary),)], "blob binary").coalesce(1), f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, partition = UnitEncoder.of_worker(tokenizer, True, end_id), TaskContext.get().partitionId()
        rows, size, place = [], 0, 0

        def made():
            return pa.RecordBatch.from_arrays(
                [pa.array([file_bytes(rows, shared.value, width, partition, place)], pa.binary())], ["blob"]
            )

        for batch in slices(batches):
            for key, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                rows.append((key, ids))
                size += len(ids) // 4 * width
                if size >= FILE_BYTES:
                    yield made()
                    rows, size, place = [], 0, place + 1
        if rows:
            yield made()

    ordered = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    write_blobs(ordered.mapInArrow(files, "blob binary"), f"{path}/files")
    return TokenFiles(path, dictionary)


def open_token_files(spark: SparkSession, path: str) -> TokenFiles:
    """Find the dictionary beside files written earlier."""
    stored = bytes(read_blobs(spark, f"{path}/dictionary").first().blob)
    return TokenFiles(path, stored[:-1])


def read_token_files(spark: SparkSession, files: TokenFiles, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids): documents in the files; ``start``: ids of all documents before.

    Starts add up per file, per partition and in the file, so only one number per partition is
    ever ordered in one place.
    """
    shared = spark.sparkContext.broadcast(files.dictionary)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("blob"):
                file = TokenFile(content.as_py(), shared.value)
                lengths = file.index["n_tokens"].astype(np.int64)
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, file.partition, np.int64)),
                        pa.array(np.full(n, file.place, np.int64)),
                        pa.array(file.index["doc_id"], mask=file.index["has_id"] == 0),
                        pa.array(np.cumsum(lengths) - lengths),
                        pa.array(lengths),
                        pa.array([file.ids(k).astype("<u4").tobytes() for k in range(n)], pa.binary()),
                    ],
                    ["partition", "place", "doc_id", "at", "n_tokens", "ids"],
                )

    decoded = read_blobs(spark, f"{files.path}/files").select("blob").mapInArrow(
        documents, "partition long, place long, doc_id long, at long, n_tokens long, ids binary"
    )
    decoded = decoded.withColumn("ids_crc32", F.crc32("ids"))
    if not with_ids:
        decoded = stage(decoded.drop("ids"), "decoded")
    per_file = decoded.groupBy("partition", "place").agg(F.sum("n_tokens").alias("n"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    per_partition = per_file.groupBy("partition").agg(F.sum("n").alias("n"))
    starts = (
        per_file.withColumn("in_partition", F.sum("n").over(up_to(Window.partitionBy("partition").orderBy("place"))))
        .drop("n")
        .join(per_partition.withColumn("before", F.sum("n").over(up_to(Window.orderBy("partition")))).drop("n"), "partition")
        .select("partition", "place", F.expr("coalesce(in_partition, 0) + coalesce(before, 0)").alias("file_start"))
    )
    return decoded.join(starts, ["partition", "place"]).withColumn("start", F.col("file_start") + F.col("at")).drop(
        "file_start", "at", "partition", "place"
    )
