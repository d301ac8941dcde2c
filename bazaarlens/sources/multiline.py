"""Quoted CSV whose records span lines, read by many tasks a file.

A byte range can't tell by itself whether it starts inside a quoted field. But the number of quotes in every range can be
counted first; whether the quotes before a range are odd says where it starts, and the records that start in the ranges
before say which number its first record has. A record that runs across ranges comes out in fragments, two or more, which
are joined by their record number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = ["csv_records", "read_multi_line"]

RANGES = "file string, at long, quotes long, outside long, inside long"


def _quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each byte range: quotes, and the records that start in it where it starts outside or inside a field."""
    now, quotes, starts, rows = None, 0, [0, 0], []

    def close() -> None:
        if now is not None:
            rows.append((*now, quotes, *starts))
    for b in batches:
        for file, at, line in zip(*(b.column(c).to_pylist() for c in ("file", "at", "value"))):
            if (file, at) != now:
                close()
                now, quotes, starts = (file, at), 0, [0, 0]
            if line.rstrip("\r"):
                starts[quotes & 1] += 1   # a line is the start of a record where it isn't within a field
            quotes += line.count('"')
    close()
    names, kinds = ("file", "at", "quotes", "outside", "inside"), (pa.string(), *[pa.int64()] * 4)
    yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds)], names)


def _records(places: dict[tuple[str, int], tuple[bool, int]]):
    """file, record, part, text; part is the byte range of a fragment, null for a whole record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, number, held, whole = None, False, 0, [], True
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 4
            out = pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "record", "part", "text"])
            rows.clear()
            return out

        def fragment() -> None:   # the range ends within a record
            if inside:
                rows.append((now[0], number, now[1], "\n".join(held)))
        for b in batches:
            for file, at, line in zip(*(b.column(c).to_pylist() for c in ("file", "at", "value"))):
                if (file, at) != now:
                    fragment()
                    now = (file, at)
                    inside, number = places[now]
                    held, whole = [], not inside
                odd = line.count('"') & 1
                if inside:
                    held.append(line)
                    if odd:
                        rows.append((file, number, None if whole else at, "\n".join(held)))
                        inside, whole = False, True
                elif line.rstrip("\r"):
                    number += 1
                    if odd:
                        inside, held, whole = True, [line], True
                    else:
                        rows.append((file, number, None, line))
            if len(rows) > 5000:
                yield made()
        fragment()
        yield made()
    return run


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, record (from 1, the header; blank lines don't count), text of every record of the quoted CSV files at path.

    Quotes within fields are doubled. A record may be as long as memory for one row allows; everything else is bounded by
    a byte range (spark.sql.files.maxPartitionBytes). One row for each range comes to the driver.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    places, last, inside, number = {}, None, False, 0
    for r in lines.mapInArrow(_quotes, RANGES).orderBy("file", "at").collect():
        if r["file"] != last:
            last, inside, number = r["file"], False, 0
        places[r["file"], r["at"]] = (inside, number)
        number += r["inside"] if inside else r["outside"]
        inside ^= bool(r["quotes"] & 1)
    found = lines.mapInArrow(_records(places), "file string, record long, part long, text string")
    pieces = found.where("part IS NOT NULL").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"))
    joined = pieces.select("file", "record", F.array_join(F.col("p.text"), "\n").alias("text"))
    return found.where("part IS NULL").drop("part").unionByName(joined)


def read_multi_line(spark: SparkSession, path: str, schema: T.StructType, strict_header: bool = True) -> DataFrame:
    """The columns of schema with ``_bad`` (text of a record that doesn't fit it), ``_file`` and ``_record``, its number in the
    file; 1 is the first after the header. A file whose quotes are not closed ends in one bad record."""
    records = csv_records(spark, path)
    if strict_header:
        names = [f.name for f in schema.fields]
        for r in records.where("record = 1").select("file", F.split(F.regexp_replace("text", '[\\r"﻿]', ""), ",").alias("names")).collect():   # one a file
            if r["names"] != names:
                raise ValueError(f"header of {r['file']} is {r['names']}, not {names}")
    with_bad = T.StructType(list(schema.fields) + [T.StructField("_bad", T.StringType())])
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    row = F.from_csv(F.regexp_replace("text", "\r$", ""), with_bad.simpleString()[7:-1].replace(":", " "), options)
    return records.where("record > 1").select(row.alias("_r"), F.col("file").alias("_file"), (F.col("record") - 1).alias("_record")).select(
        *[F.col(f"_r.{f.name}").alias(f.name) for f in with_bad.fields], "_file", "_record")
