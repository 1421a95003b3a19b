"""Strict CSV: one snapshot of the bytes, every cell text, blank cells kept as ''."""

from __future__ import annotations

import csv
import hashlib
import io
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.runtime import materialise, reread, scope
from tidemark.sources.tables import ROW

CHUNK = 100_000  # records


class CsvProblem(ValueError):
    pass


def read_strict(spark: SparkSession, path: str | Path) -> tuple[DataFrame, str]:
    """The table, with its row order in the column ROW, and the SHA-256 of the very bytes it was read from.

    The file is UTF-8, with or without a byte-order mark; the header's names are
    unique and not blank; a record has as many fields as the header; lines
    without anything are passed over.  One pass reads, checks and hashes the file; records go to a table
    in the shared folder, CHUNK of them at a time, so the driver never holds more.  Nothing of a malformed file is left.
    """
    raw = _Hashed(open(path, "rb", buffering=0))
    with scope(kept := []), io.TextIOWrapper(io.BufferedReader(raw, 1 << 20), "utf-8-sig", newline="") as text:
        try:
            records = csv.reader(text, strict=True)
            header = next(records, [])
            if not header or not all(x.strip() for x in header) or len(set(header)) < len(header):
                raise CsvProblem("The CSV header needs names that are unique and not blank.")
            shape = T.StructType([T.StructField(ROW, T.LongType())] + [T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
            chunks = _chunks(records, header)
            first = next(chunks, [])
            table = materialise(spark.createDataFrame(first, shape), "csv")
            for chunk in chunks:
                spark.createDataFrame(chunk, shape).write.mode("append").parquet(table._tidemark_path)
                table = reread(table)
        except (UnicodeDecodeError, csv.Error) as e:
            raise CsvProblem(f"Not a well-formed CSV file: {e}") from e
        kept.append(table)
        return table.toDF(ROW, *header), raw.digest.hexdigest()


def _chunks(records: Iterable[list[str]], header: list[str]) -> Iterator[list[tuple]]:
    rows, at = [], 0
    for line, record in enumerate(records, 2):
        if record and len(record) != len(header):
            raise CsvProblem(f"CSV record {line} has {len(record)} fields where the header has {len(header)}.")
        if record:
            rows.append((at, *record))
            at += 1
        if len(rows) == CHUNK:
            yield rows
            rows = []
    if rows:
        yield rows


class _Hashed(io.RawIOBase):
    """A file that hashes what is read from it."""

    def __init__(self, raw: io.RawIOBase):
        self.raw, self.digest = raw, hashlib.sha256()

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        n = self.raw.readinto(buffer)
        self.digest.update(memoryview(buffer)[:n])
        return n

    def close(self) -> None:
        self.raw.close()
        super().close()
