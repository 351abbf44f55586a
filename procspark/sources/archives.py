"""Tables inside zip archives, read as Spark rows.

A deflated member can't be entered in its middle, so an archive is one task's work and many archives are many tasks.  A
task holds the archive's compressed bytes; members are inflated and cut into records as they are read, in batches of
bounded size.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv import case_column, cross_check, differing_cases

#: Texts of a batch have about so many characters, but for one record that is longer.
BATCH_CHARS = 1 << 20
_FIELDS = pa.map_(pa.string(), pa.string())


def _archive(content: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(content))


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = _archive(content).infolist()
            names = [x.filename for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(names)), pa.array(range(len(names)), pa.int32()), pa.array(names, pa.string()), pa.array([x.file_size for x in found], pa.int64())],
                names=["archive", "place", "member", "bytes"],
            )


class _Records:
    """Records of the members whose names match, each as a map from header to field."""

    def __init__(self, member: str, encoding: str, first: bool):
        self.member, self.encoding, self.first = member, encoding, first

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit((1 << 31) - 1)
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _archive(content) as archive:
                    names = [n for n in archive.namelist() if re.search(self.member, n)]
                    for name in names[:1] if self.first else names:
                        with archive.open(name) as raw:
                            yield from self._rows(path, name, io.TextIOWrapper(raw, self.encoding, errors="replace", newline=""))

    @staticmethod
    def _rows(path: str, name: str, text: io.TextIOBase) -> Iterator[pa.RecordBatch]:
        reader = csv.reader(text)
        header, start, rows, chars = next(reader, []), 0, [], 0

        def batch() -> pa.RecordBatch:
            n = len(rows)
            columns = [pa.array([path] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array(range(start, start + n), pa.int64()), pa.array(rows, _FIELDS)]
            return pa.RecordBatch.from_arrays(columns, names=["archive", "member", "record", "fields"])

        for record in reader:
            # Blank lines aren't records; fields beyond the header are left out, missing ones are null.
            if record:
                rows.append(list(dict(zip(header, record + [None] * (len(header) - len(record)))).items()))
                chars += sum(map(len, record))
            if chars > BATCH_CHARS:
                yield batch()
                start, rows, chars = start + len(rows), [], 0
        if rows:
            yield batch()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def members(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, place, member, bytes)`` of everything in the archives of a path, directories included."""
    return _files(spark, path).mapInArrow(_list, "archive string, place int, member string, bytes bigint")


def read_tables(spark: SparkSession, path: str, member: str = r"(?i)\.csv$", encoding: str = "utf-8", first: bool = False) -> DataFrame:
    """``(archive, member, record, fields)`` of CSV members: quoted fields may hold commas and line breaks.

    ``member`` is searched in the names; ``first`` takes each archive's first match only.  A header that stands twice
    has the last field; bytes that aren't text are replaced; an empty member gives nothing; an archive is 2 GB at most.
    """
    return _files(spark, path).mapInArrow(_Records(member, encoding, first), "archive string, member string, record bigint, fields map<string,string>")


def compare(ours: DataFrame, path: str, **how) -> tuple[DataFrame, DataFrame]:
    """Our events beside the first table of an archive: the counts of ``csv.cross_check``, and the cases that differ.

    The column of the case is found by its name among their headers; archives without a table are an error.
    """
    theirs = read_tables(ours.sparkSession, path, first=True, **how)
    head = theirs.select(F.map_keys("fields").alias("names")).first()
    if head is None:
        raise ValueError(f"no table in {path}")
    cases = theirs.select(F.element_at("fields", F.lit(case_column(head.names))).alias("case_id"))
    return cross_check(ours, cases), differing_cases(ours, cases)
