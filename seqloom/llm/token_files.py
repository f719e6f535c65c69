"""Token-id files: independent zstandard frames, a trailing seek table, a checksum for every frame.

A file holds the documents of one range of doc_id in ascending order:

    a frame for each document: its ids, little-endian, two bytes each if all of the file's vocabulary fits, else four
    a skippable frame (magic 0x184D2A50): a zstandard frame with the doc_ids, little-endian signed 64-bit
    a skippable frame (magic 0x184D2A5E): the seek table of the public zstandard seekable format:
        per frame: compressed size, size, low 32 bits of the XXH64 of the content (unsigned 32-bit each);
        then frame count (u32), descriptor byte (bit 7: checksums are there), magic 0x8F92EAB1 (u32)

A reader takes the seek table from the file's end, then only the frames of the documents asked for, and
compares each with its checksum. Any zstandard decoder can also read the file as a whole.

Files are written and read through pyarrow's file systems, so the folder may be local or in an object
store. A task writes under a name of its own and then moves the file to its final name, so a task that is run again
replaces its file by an equal one.

Defined results: a null text is empty (the end id alone); a null doc_id comes first; rows that repeat a
doc_id are ordered by the md5 of their text and each is a document of its own, and may lie in several files; very long texts are one frame
each; other columns are not read and may have any name; an empty table gives no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm._common import scratch_path, text_of
from seqloom.llm.wordcache import word_encoder

SEEK_MAGIC, INDEX_MAGIC, FOOT_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
#: Stands for a null doc_id in a file.
NULL_ID = -(1 << 63)


#: A row per file, kept in the folder's manifest.
MANIFEST = "part bigint, file string, n_docs bigint, n_ids bigint, first_id bigint, last_id bigint"


@dataclass
class FrameWriter:
    """Writes one file to a binary stream; holds 12 bytes and the id of every document until the end."""

    out: object
    wide: bool
    table: list[tuple[int, int, int]] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.zstd = zstandard.ZstdCompressor(level=3)

    def add(self, doc_id: int, tokens: np.ndarray) -> None:
        raw = tokens.astype("<u4" if self.wide else "<u2").tobytes()
        frame = self.zstd.compress(raw)
        self.out.write(frame)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        index = self.zstd.compress(np.array(self.ids, "<i8").tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index) + 1) + bytes([4 if self.wide else 2]) + index)
        body = b"".join(struct.pack("<III", *x) for x in self.table)
        body += struct.pack("<IBI", len(self.table), 0x80, FOOT_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(body)) + body)


class FrameReader:
    """Reads documents of one file by their number; the source needs seek() and read()."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        n, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOT_MAGIC or descriptor != 0x80:
            raise ValueError("not a token file: its seek table is missing")
        at = size - 9 - 12 * n
        source.seek(at)
        table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.raw_sizes, self.sums = table.T
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        source.seek(int(self.starts[-1]))
        magic, length = struct.unpack("<II", source.read(8))
        if magic != INDEX_MAGIC:
            raise ValueError("not a token file: its index is missing")
        self.width = source.read(1)[0]
        self.zstd = zstandard.ZstdDecompressor()
        self.doc_ids = np.frombuffer(self.zstd.decompress(source.read(length - 1)), "<i8")

    def __len__(self) -> int:
        return len(self.sizes)

    def tokens(self, k: int) -> np.ndarray:
        """The ids of document k; only its frame is read."""
        self.source.seek(int(self.starts[k]))
        raw = self.zstd.decompress(self.source.read(int(self.sizes[k])), max_output_size=int(self.raw_sizes[k]))
        if len(raw) != self.raw_sizes[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"document {k}: its checksum differs")
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def write(docs: DataFrame, folder: str, vocabulary: str, *, spaced: bool = True, end_id: int = 0) -> list[tuple]:
    """Tokenise docs into files in folder, in ascending doc_id over the files; returns (part, file, documents, ids, first and last doc_id) of each.

    The list has a row per file, which is a row per partition; it is also written to the folder's manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        encoder, part = word_encoder(vocabulary, spaced), TaskContext.get().partitionId()
        wide = encoder.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        mine, final = f"{root}/.{uuid.uuid4().hex}", f"{root}/part-{part:06d}.tok.zst"
        n = 0
        end = np.array([end_id], "<u4")
        with fs.open_output_stream(mine) as out:
            file = FrameWriter(out, wide)
            for b in batches:
                ids = b.column(0).fill_null(NULL_ID).to_numpy()
                for doc_id, raw in zip(ids, encoder.encode_many(b.column(1).to_pylist()), strict=True):
                    tokens = np.concatenate((raw, end))
                    n += len(tokens)
                    file.add(int(doc_id), tokens)
            file.close()
        if not file.ids:
            fs.delete_file(mine)
            return
        fs.move(mine, final)
        row = (part, final.rpartition("/")[2], len(file.ids), n, min(file.ids), max(file.ids))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "file", "n_docs", "n_ids", "first_id", "last_id"])

    text = text_of(docs)
    keyed = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text.alias("text"), F.md5(text).alias("tie"))
    # the text's hash orders rows that repeat a doc_id, and lets their range be split
    ranged = keyed.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    done = ranged.select("doc_id", "text").mapInArrow(run, MANIFEST)
    done.write.mode("overwrite").parquet(f"{folder}/_manifest")
    return manifest(docs.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> list[tuple]:
    """The rows of the folder's manifest, in the files' order."""
    return sorted(map(tuple, spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").collect()))


def requested(spark: SparkSession, folder: str, ids: DataFrame) -> DataFrame:
    """(doc_id, ids binary) of the documents asked for in ids (doc_id); rows that repeat a doc_id all come.

    The manifest tells which files an id may be in; each of these is opened once, and only the frames of documents asked for are read.
    """
    files = [x for x in manifest(spark, folder) if x[5] != NULL_ID]
    last, first = np.array([x[5] for x in files], np.int64), np.array([x[4] for x in files], np.int64)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(0).to_numpy(zero_copy_only=False)
            # a file that also holds rows without an id starts before all of them
            lo, hi = np.searchsorted(last, wanted, side="left"), np.searchsorted(first, wanted, side="right")
            n = np.maximum(hi - lo, 0)
            place = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array([files[k][1] for k in place], pa.string()), pa.array(np.repeat(wanted, n))], ["file", "doc_id"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, held = None, {}
        for b in batches:
            for file, doc_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if file != name:
                    if held:
                        held["source"].close()
                    source = fs.open_input_file(f"{root}/{file}")
                    name, held = file, {"source": source, "reader": FrameReader(source, fs.get_file_info(f"{root}/{file}").size)}
                reader = held["reader"]
                at = np.arange(*(np.searchsorted(reader.doc_ids, doc_id, side=x) for x in ("left", "right")))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(at), pa.int64()), pa.array([reader.tokens(k).tobytes() for k in at], pa.binary())], ["doc_id", "ids"])
        if held:
            held["source"].close()

    wanted = ids.select(ids["doc_id"].cast("bigint").alias("doc_id")).filter("doc_id is not null").distinct()
    return wanted.mapInArrow(locate, "file string, doc_id bigint").repartition("file").sortWithinPartitions("file", "doc_id").mapInArrow(fetch, "doc_id bigint, ids binary")


def read(spark: SparkSession, folder: str, files: list[tuple]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids binary) of every document, from the files; start counts the ids of all before it."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = f"{root}/{name}"
                with fs.open_input_file(path) as source:
                    file = FrameReader(source, fs.get_file_info(path).size)
                    for at in range(0, len(file), 256):
                        rows = []
                        for k in range(at, min(at + 256, len(file))):
                            t = file.tokens(k)
                            doc_id = int(file.doc_ids[k])
                            rows.append((None if doc_id == NULL_ID else doc_id, start, len(t), zlib.crc32(t.tobytes()), t.tobytes()))
                            start += len(t)
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]))

    if not files:
        return spark.createDataFrame([], schema)
    starts = np.concatenate(([0], np.cumsum([x[3] for x in files])))
    listed = spark.createDataFrame([(x[1], int(s)) for x, s in zip(files, starts, strict=False)], "file string, start bigint")
    return listed.repartition(len(files)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Write docs and read the files back: (doc_id, start, n_tokens, ids_crc32) from the files."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    return read(spark, folder, write(docs, folder, vocabulary)).select("doc_id", "start", "n_tokens", "ids_crc32")
