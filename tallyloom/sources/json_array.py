"""Large JSON files of records, read by many tasks: arrays of objects, or objects one after another.

A file is read by Spark's text reader, with the closing brace as its separator, so that it is split into byte ranges like any text. Whether a
range starts inside a string, and how deep, follows from what the ranges before it hold: a first pass finds for every range how it changes both states
from either start, the driver strings these few numbers together, and a second pass cuts the records out. Only a record that crosses ranges
is put together from its pieces by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ESCAPED = re.compile(r"\\.", re.DOTALL)
#: What may stand before a record, outside strings.
LEAD = r"^[^{]*"
HEAD, MIDDLE, TAIL, WHOLE = range(4)


def _change(piece: str) -> tuple[int, int, int]:
    """(1 if it has an odd number of quotes; depth that it adds if it starts outside a string, and if inside), without the brace that ends it."""
    if "\\" in piece:
        piece = ESCAPED.sub("", piece)
    parts = piece.split('"')
    depth = [sum(p.count("{") + p.count("[") - p.count("]") for p in parts[k::2]) for k in (0, 1)]
    return (len(parts) - 1) & 1, depth[0], depth[1]


def _after(inside: int, depth: int, change: tuple[int, int, int]) -> tuple[int, int]:
    """The state after a piece and the brace that ends it."""
    odd, out, within = change
    depth += within if inside else out
    inside ^= odd
    return inside, depth - (1 - inside)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """(file, start of its range, pieces): some pieces of one range at a time, in order."""
    for batch in batches:
        files, starts, pieces = (batch.column(c).to_pylist() for c in ("file", "start", "value"))
        begin = 0
        for end in range(1, len(pieces) + 1):
            if end == len(pieces) or starts[end] != starts[begin] or files[end] != files[begin]:
                yield files[begin], starts[begin], pieces[begin:end]
                begin = end


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "start", "first", "odd", "out", "within"]

    def row(file, start, first, states):
        (a, x), (_, y) = states
        return pa.RecordBatch.from_pylist([{"file": file, "start": start, "first": first, "odd": a, "out": x, "within": y}]).select(names)

    now, first, states = None, "", [(0, 0), (1, 0)]
    for file, start, pieces in _ranges(batches):
        if now != (file, start):
            if now:
                yield row(*now, first, states)
            now, first, states = (file, start), "", [(0, 0), (1, 0)]
        for piece in pieces:
            first = first or piece.lstrip(" \t\r\n\ufeff")[:1]
            change = _change(piece)
            states = [_after(*s, change) for s in states]
    if now:
        yield row(*now, first, states)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(value): the text of every object in the arrays, or the sequence, of each file of path; array elements that are no objects are passed over.

    A file that breaks off within a record gives what there is of it, with a closing brace: as a rule no JSON.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    found = pieces.mapInArrow(_states, "file string, start long, first string, odd long, out long, within long").orderBy("file", "start").collect()  # one row a range
    starts: dict[tuple[str, int], tuple[int, int, int, int]] = {}
    file, at, inside, depth, base = None, 0, 0, 0, 0
    for r in found:
        if r.file != file:
            file, at, inside, depth, base = r.file, 0, 0, 0, 1 if r.first == "[" else 0
        starts[r.file, r.start] = (at, inside, depth, base)
        depth += r.within if inside else r.out
        inside, at = inside ^ r.odd, at + 1
    shared = spark.sparkContext.broadcast(starts)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "at", "role", "value"]
        now, held, open_, rows = None, [], False, []
        at = inside = depth = base = 0

        def left() -> list[tuple]:
            return [(now[0], at, MIDDLE if open_ else HEAD, "}".join(held) + "}")] if held else []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names)

        for file, start, pieces in _ranges(batches):
            if now != (file, start):
                rows += left()
                now, held = (file, start), []
                at, inside, depth, base = shared.value[now]
                open_ = at > 0 and (inside or depth != base)  # it starts within a record
            for piece in pieces:
                inside, depth = _after(inside, depth, _change(piece))
                held.append(piece)
                if not inside and depth == base:
                    rows.append((file, at, TAIL if open_ else WHOLE, "}".join(held) + "}"))
                    held, open_ = [], False
            if len(rows) >= 1000:
                yield batch_of(rows)
                rows = []
        yield batch_of(rows + left())

    parts = pieces.mapInArrow(cut_out, "file string, at long, role int, value string")
    # A record goes from a head through whole ranges to a tail; a tail stands before the head of its range.
    crossing = parts.filter(F.col("role") != WHOLE)
    order = Window.partitionBy("file").orderBy("at", F.col("role").desc())
    joined = (
        crossing.withColumn("record", F.sum((F.col("role") == HEAD).cast("int")).over(order))
        .groupBy("file", "record")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "").alias("value"), F.max("role").alias("last"))
        .filter(F.col("last") == TAIL)
    )
    texts = parts.filter(F.col("role") == WHOLE).select("value").union(joined.select("value"))
    return texts.select(F.regexp_replace("value", LEAD, "").alias("value"))


def schema_of(texts: DataFrame) -> str:
    """The struct that holds every object; numbers with a point are double, and what differs from object to object is string."""
    said = texts.agg(F.schema_of_variant_agg(F.try_parse_json("value")).alias("s")).first().s
    if not said or not said.startswith("OBJECT<"):
        return "struct<>"
    said = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", said)
    return re.sub(r"\b(VARIANT|VOID)\b(?!:)", "STRING", said).replace("OBJECT<", "STRUCT<")


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The records of read_texts(), one row each. Without a schema, one more pass finds it. Files without records give none."""
    texts = read_texts(spark, path)
    kind = f"struct<{schema}>" if schema and not schema.lower().startswith("struct<") else schema or schema_of(texts)
    if kind == "struct<>":
        return texts.limit(0).select()
    return texts.select(F.from_json("value", kind).alias("r")).select("r.*")


def write_array(records: DataFrame, path: str, files: int = 1) -> None:
    """Records as `files` JSON arrays at most, one a line, in the order of their texts; an array's records must fit a task, as it is one text."""
    place = F.pmod(F.xxhash64(F.to_json(F.struct("*"))), F.lit(files))
    whole = records.select(place.alias("f"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).groupBy("f").agg(F.sort_array(F.collect_list("value")).alias("v"))
    whole.repartition(files, "f").select(F.concat(F.lit("["), F.array_join("v", ",\n "), F.lit("]")).alias("value")).write.mode("overwrite").text(path)
