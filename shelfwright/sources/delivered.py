"""A strict CSV source: `spark.read.format("strict_csv").load(path)` after register(spark).

Unlike the built-in reader it never repairs: every record keeps its place and all of its fields, however many; the header must name each column once.
Records follow RFC 4180 (quotes doubled, line breaks within quotes), a byte order mark is skipped, as are empty lines. A file is read by one task, as
the place of a record in it is only known from its start; many files are read in parallel.
"""

from __future__ import annotations

import csv
import glob
import hashlib
import io
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What a record has: its file and the digest of it, its place (from 1, the header not counted), its fields, and whether their number is the header's.
SCHEMA = "file string, source_sha256 string, source_row long, header array<string>, fields array<string>, well_formed boolean"


def header_of(fields: list[str], path: str) -> list[str]:
    names = [f.strip() for f in fields]
    if not all(names) or len(set(names)) != len(names):
        raise ValueError(f"{path}: the header has a blank or repeated column")
    return names


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[_File]:
        found = sorted(glob.glob(os.path.join(self.path, "*.csv"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not found:
            raise FileNotFoundError(self.path)
        return [_File(p) for p in found]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            digest = hashlib.file_digest(f, "sha256").hexdigest()
        with io.open(partition.path, encoding="utf-8-sig", newline="") as f:
            rows = csv.reader(f, strict=True)
            header = None
            n = 0
            for fields in rows:
                if not fields:
                    continue
                if header is None:
                    header = header_of(fields, partition.path)
                    continue
                n += 1
                yield os.path.basename(partition.path), digest, n, header, fields, len(fields) == len(header)


class StrictCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strict_csv"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    from shelfwright.session import ship

    ship(spark)
    spark.dataSource.register(StrictCsv)


def typed(records: DataFrame, columns: list[str], strict: bool = True) -> DataFrame:
    """(file, source_sha256, source_row, columns) of well-formed records, by name; missing columns and, if strict, records of a wrong width are errors."""
    have = F.transform(F.array(*[F.lit(c) for c in columns]), lambda c: F.array_position("header", c))
    checked = records.withColumn("at", F.when(F.array_contains(have, 0), F.raise_error(F.lit("a column is missing"))).otherwise(have))
    if strict:
        wrong = F.raise_error(F.concat(F.lit("wrong number of fields in record "), F.col("source_row").cast("string")))
        checked = checked.withColumn("fields", F.when(F.col("well_formed"), F.col("fields")).otherwise(wrong))
    else:
        checked = checked.filter("well_formed")
    return checked.select("file", "source_sha256", "source_row", *[F.get(F.col("fields"), (F.get(F.col("at"), F.lit(i)) - 1).cast("int")).alias(c) for i, c in enumerate(columns)])
