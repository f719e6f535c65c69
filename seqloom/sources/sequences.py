"""FASTA and FASTQ as data sources of Spark: spark.read.format("seqloom.fastq").load(path).

A file is read in byte ranges, a partition each, in one scan and without a shuffle. A range finds its first record by itself: in FASTA a line that starts with
'>'; in FASTQ a line that starts with '@' whose next but one starts with '+', which no other line does: a quality line that starts with '@' is followed
by a name and a sequence. A record belongs to the range in which it begins. Compressed files (.gz) are one partition each.

Files are opened with pyarrow's file systems (local paths, file:, hdfs:, s3:, gs:); files.fasta and files.fastq read what only Spark can. Paths may be files, folders
or several of these, comma-separated. Rows: (file, name, seq), a record's lines joined; an empty file has none; a FASTQ record that ends early raises.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20
#: Rows and letters of an Arrow batch, at most about.
ROWS, LETTERS = 4096, 4 << 20


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    whole: bool = False

    def __post_init__(self):
        super().__init__(self.path)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def found(paths: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files meant; those that start with '_' or '.' in folders are left out."""
    out = []
    for path in (p.strip() for p in paths.split(",")):
        system, at = _system(path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"there is no file or folder {path}")
        inside = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(at, recursive=True)) if x.type == fs.FileType.File and x.base_name[:1] not in "_."]
        head = path[: len(path) - len(at)] if path.endswith(at) else "file://" if path.startswith("file:") else ""
        out += [(head + x.path, x.size) for x in inside]
    return sorted(out)


class Lines:
    """Lines of a file from a place on, each with the place where it begins."""

    def __init__(self, file: io.BufferedIOBase, begin: int):
        self.file, self.at = file, begin
        self.held: list[tuple[int, bytes]] = []
        if begin:
            file.seek(begin - 1)
            self.at = begin - 1 + len(file.readline())  # the rest of the line before, or its end alone

    def next(self) -> tuple[int, bytes] | None:
        if self.held:
            return self.held.pop()
        line = self.file.readline()
        if not line:
            return None
        at, self.at = self.at, self.at + len(line)
        return at, line.rstrip(b"\r\n")

    def back(self, *lines: tuple[int, bytes] | None) -> None:
        """Lines to be given again, the first of them next."""
        self.held += [x for x in reversed(lines) if x is not None]


def fasta_records(lines: Lines, end: int) -> Iterator[tuple[bytes, bytes]]:
    line = lines.next()
    while line is not None and not line[1].startswith(b">"):
        if line[0] >= end:
            return
        line = lines.next()
    while line is not None and line[0] < end:
        name, parts = line[1][1:], []
        line = lines.next()
        while line is not None and not line[1].startswith(b">"):
            parts.append(b"".join(line[1].split()))
            line = lines.next()
        yield name.strip(b"\r\n"), b"".join(parts)


def fastq_records(lines: Lines, end: int) -> Iterator[tuple[bytes, bytes]]:
    while True:  # the first name of the range
        one = lines.next()
        if one is None or one[0] >= end:
            return
        two, three = lines.next(), lines.next()
        if one[1].startswith(b"@") and three is not None and three[1].startswith(b"+"):
            lines.back(one, two, three)
            break
        lines.back(two, three)
    while (name := lines.next()) is not None and name[0] < end:
        if not name[1]:
            continue
        seq, plus, quality = lines.next(), lines.next(), lines.next()
        if not name[1].startswith(b"@") or plus is None or not plus[1].startswith(b"+") or quality is None:
            raise ValueError(f"no whole FASTQ record at byte {name[0]}")
        yield name[1][1:], seq[1]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, records):
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.paths, self.split, self.records = options["path"], int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES))), records

    def partitions(self) -> list[Range]:
        out = []
        for path, size in found(self.paths):
            out += [Range(path, 0, size, True)] if path.endswith(".gz") else [Range(path, b, min(b + self.split, size)) for b in range(0, size, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, at = _system(partition.path)
        with io.BufferedReader(system.open_input_file(at), 1 << 20) as raw:
            lines = Lines(io.BufferedReader(gzip.GzipFile(fileobj=raw)), 0) if partition.whole else Lines(raw, partition.begin)
            names, seqs, size = [], [], 0
            for name, seq in self.records(lines, float("inf") if partition.whole else partition.end):
                names.append(name.decode("utf-8", "replace"))
                seqs.append(seq.decode("utf-8", "replace"))
                size += len(seq)
                if len(names) == ROWS or size > LETTERS:
                    yield self._batch(partition.path, names, seqs)
                    names, seqs, size = [], [], 0
            if names:
                yield self._batch(partition.path, names, seqs)

    @staticmethod
    def _batch(path: str, names: list[str], seqs: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(seqs, pa.string())], ["file", "name", "seq"])


class Fasta(DataSource):
    records = staticmethod(fasta_records)

    @classmethod
    def name(cls) -> str:
        return "seqloom.fasta"

    def schema(self) -> str:
        return "file string, name string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), type(self).records)


class Fastq(Fasta):
    records = staticmethod(fastq_records)

    @classmethod
    def name(cls) -> str:
        return "seqloom.fastq"


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    spark.dataSource.register(Fasta)
    spark.dataSource.register(Fastq)
