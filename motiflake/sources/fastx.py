"""FASTA and FASTQ, plain or gzip, as a Spark data source: spark.read.format("fastx").load(path).

One partition for each file; batches leave as they fill, so a file is never held whole, a record is. Paths may be files,
folders, globs, or URIs that pyarrow's filesystems know. Options: format (auto, fasta, fastq).
"""

from __future__ import annotations

import glob
import gzip
import io
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import alphabets as a
from ..plans.session import share_code

FORMATS = ("auto", "fasta", "fastq")
# Suffixes by format.
SUFFIXES = {"fasta": (".fa", ".fasta", ".fna", ".ffn", ".frn"), "fastq": (".fq", ".fastq")}
SCHEMA = "name string, sequence string, file string, record_ord long"
BATCH_BYTES = 4 << 20


def infer_format(path: str, fmt: str = "auto") -> str:
    """fasta or fastq, by the path's suffix before an optional .gz unless given. Case doesn't matter."""
    if fmt != "auto":
        if fmt not in FORMATS:
            raise ValueError(f"Unsupported sequence format: {fmt}")
        return fmt
    suffixes = [s.lower() for s in PurePath(path).suffixes]
    if suffixes[-1:] == [".gz"]:
        suffixes.pop()
    if not suffixes:
        raise ValueError(f"Cannot infer the sequence format of {path}: it has no suffix; name the format")
    found = [f for f, known in SUFFIXES.items() if suffixes[-1] in known]
    if not found:
        raise ValueError(f"Cannot infer the sequence format of {path}: suffix {suffixes[-1]!r} is unknown; name the format")
    return found[0]


def open_text(path: str) -> io.TextIOBase:
    """The file's text, decompressed if its last suffix is .gz; all newlines become line feeds."""
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        raw = system.open_input_stream(inner, compression=None)
    else:
        raw = open(path, "rb")  # noqa: SIM115
    if path.lower().endswith(".gz"):
        raw = gzip.open(raw, "rb")
    return io.TextIOWrapper(raw, encoding="utf-8")


def _name(header: str, kind: str) -> str:
    words = header[1:].split(maxsplit=1)
    if not words:
        raise ValueError(f"{kind} header has no name")
    return words[0]


def parse_fasta(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(name, sequence) of every record, those without a body too; blanks around lines and blank lines don't count."""
    stripped = (s for s in map(str.strip, lines) if s)
    name = None
    for is_header, run in groupby(stripped, key=lambda s: s.startswith(">")):
        if is_header:
            for header in run:
                if name is not None:
                    yield name, ""
                name = _name(header, "FASTA")
        elif name is None:
            raise ValueError("FASTA sequence appeared before the first header")
        else:
            yield name, "".join(run)
            name = None
    if name is not None:
        yield name, ""


def parse_fastq(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(name, sequence) of every record. Sequence and quality may take several lines; the quality ends where it is as
    long as the sequence, so its lines may begin with any symbol. Qualities are checked for length and dropped."""
    numbered = ((i, s.rstrip("\r\n")) for i, s in enumerate(lines, 1))
    for number, header in numbered:
        if not header:
            continue
        if not header.startswith("@"):
            raise ValueError(f"FASTQ record must start with '@' near line {number}")
        name, parts, closed = _name(header, "FASTQ"), [], False
        for _, line in numbered:
            if closed := line.startswith("+"):
                break
            parts.append(line.strip())
        if not closed:
            raise ValueError(f"FASTQ record {name!r} is missing '+' quality header")
        sequence = "".join(parts)
        if not sequence:
            raise ValueError(f"FASTQ record {name!r} has an empty sequence")
        missing = len(sequence)
        while missing > 0:
            _, quality = next(numbered, (0, None))
            if quality is None:
                raise ValueError(f"FASTQ record {name!r} ended before quality block was complete")
            missing -= len(quality)
        if missing:
            raise ValueError(f"FASTQ record {name!r} has quality length {len(sequence) - missing}, expected {len(sequence)}")
        yield name, sequence


_PARSERS = {"fasta": parse_fasta, "fastq": parse_fastq}


def read_records(path: str, fmt: str = "auto") -> Iterator[tuple[str, str]]:
    """(name, sequence as written) of every record of one file."""
    parser = _PARSERS[infer_format(path, fmt)]
    with open_text(path) as lines:
        yield from parser(lines)


def _files(path: str) -> list[str]:
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        if system.get_file_info(inner).type != fs.FileType.Directory:
            return [path]
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
        found = [prefix + f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file]
    elif os.path.isdir(path):
        found = [os.path.join(path, f) for f in os.listdir(path) if os.path.isfile(os.path.join(path, f))]
    elif os.path.exists(path):
        return [path]
    else:
        found = glob.glob(path)
        if not found:
            raise FileNotFoundError(f"No such file: {path}")
    return sorted(f for f in found if os.path.basename(f)[0] not in "._")


@dataclass
class _File(InputPartition):
    path: str
    fmt: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, fmt: str):
        self.files = [_File(f, infer_format(f, fmt)) for f in _files(path)]

    def partitions(self) -> list[_File]:
        return self.files

    def read(self, partition: _File):
        import pyarrow as pa

        rows, held = [], 0
        for i, (name, sequence) in enumerate(read_records(partition.path, partition.fmt)):
            rows.append((name, sequence, partition.path, i))
            held += len(sequence) + 64
            if held >= BATCH_BYTES:
                yield _batch(pa, rows)
                rows, held = [], 0
        if rows:
            yield _batch(pa, rows)


def _batch(pa, rows: list[tuple]):
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["name", "sequence", "file", "record_ord"])


class FastxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("format", "auto"))


def read_fastx(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """name, sequence (normalised), file and record_ord (the record's place in its file) of every record."""
    share_code(spark)
    spark.dataSource.register(FastxDataSource)
    rows = spark.read.format("fastx").option("format", fmt).load(str(path))
    return rows.select("name", a.normalize(F.col("sequence")).alias("sequence"), "file", "record_ord")


def read_large_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Extension: plain FASTA by the JVM's text reader, files split at records: name, sequence (normalised), file.

    For large files whose headers begin their line and whose lines end in a line feed; there is no record_ord."""
    parts = spark.read.option("lineSep", "\n>").text(str(path)).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    body = F.regexp_replace("value", r"^\s*>", "")
    rows = parts.select(F.regexp_extract(body, r"^[ \t]*(\S+)", 1).alias("name"), a.normalize(F.regexp_replace(body, r"^[^\n]*\n?", "")).alias("sequence"), "file")
    return rows.filter(F.col("name") != "")


@dataclass(frozen=True)
class FastxReader:
    """A file, folder or glob of records; read() gives them as a DataFrame."""

    path: str
    fmt: str = "auto"

    def read(self, spark: SparkSession) -> DataFrame:
        return read_fastx(spark, self.path, self.fmt)


SequenceFileReader = FastxReader
