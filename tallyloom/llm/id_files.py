"""Files of token ids: a Spark data source, written and read file by file.

A file, all little-endian, stands for itself:

    "PFF1", bytes of the document ids (u64), bytes of the lengths (u64), ids of the part's files before it (u64)
    document ids as a JSON list, lengths (ids of each document) as packed blocks, ids as packed blocks (see pfor)

part-NNNNNNNN-SSSSSSSS-ATTEMPT.pfr is file S of part N: in this order the files hold all documents in ascending order of id. _parts.json, which is
written last and by one rename, names every part's attempt that counts and how many files and ids it has: what lost attempts left is not named, and where a
part's ids start follows from it. Paths go by Arrow's file systems, so that a cluster's shared folder may be a mount, HDFS or an object store.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .pfor import Segment, pack

MAGIC = b"PFF1"
PARTS = "_parts.json"
ROWS = "part long, segment long, doc_ids array<{kind}>, lengths array<long>, first long, n_tokens long, data binary"


def name_of(part: int, segment: int, attempt: str) -> str:
    return f"part-{part:08d}-{segment:08d}-{attempt}.pfr"


def dump(doc_ids: list, lengths: list[int], first: int, data: bytes) -> bytes:
    """A file's bytes, from what pfor.segments_of() has of a segment."""
    ids, sizes = json.dumps(doc_ids).encode(), pack(np.asarray(lengths, dtype="<u4"))
    return MAGIC + struct.pack("<QQQ", len(ids), len(sizes), first) + ids + sizes + data


def load(raw: bytes) -> tuple[list, np.ndarray, int, np.ndarray]:
    """(document ids, their lengths, ids of the part's files before it, ids) of a file's bytes."""
    if raw[:4] != MAGIC:
        raise ValueError("not a file of packed ids")
    a, b, first = struct.unpack_from("<QQQ", raw, 4)
    at = 28 + a
    return json.loads(raw[28:at]), Segment(raw[at : at + b]).read().astype(np.int64), first, Segment(raw[at + b :]).read()


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _read(fs: pafs.FileSystem, path: str) -> bytes:
    with fs.open_input_stream(path) as f:
        return f.read()


def _write(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    with fs.open_output_stream(path) as f:
        f.write(data)


@dataclass
class _Written(WriterCommitMessage):
    part: int
    attempt: str
    files: int
    tokens: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> _Written:
        fs, root = _at(self.path)
        out = _Written(-1, uuid.uuid4().hex[:12], 0, 0)
        fs.create_dir(root, recursive=True)
        for row in rows:
            out.part = row.part
            _write(fs, f"{root}/{name_of(row.part, row.segment, out.attempt)}", dump(list(row.doc_ids), list(row.lengths), row.first, bytes(row.data)))
            out.files += 1
            out.tokens += row.n_tokens
        return out

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = _at(self.path)
        parts = sorted([m.part, m.attempt, m.files, m.tokens] for m in messages if m is not None and m.files)  # one a task
        fs.create_dir(root, recursive=True)
        draft = f"{root}/.{uuid.uuid4().hex}"
        _write(fs, draft, json.dumps(parts).encode())
        fs.move(draft, f"{root}/{PARTS}")


@dataclass
class _File(InputPartition):
    path: str
    start: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, with_ids: bool, id_type: pa.DataType):
        self.path, self.with_ids, self.id_type = path, with_ids, id_type

    def partitions(self) -> list[_File]:
        fs, root = _at(self.path)
        out, start = [], 0
        for part, attempt, files, tokens in json.loads(_read(fs, f"{root}/{PARTS}")):
            out += [_File(name_of(part, k, attempt), start) for k in range(files)]
            start += tokens
        return out

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        import zlib

        if part is None or part.path is None:  # no files at all
            return
        fs, root = _at(self.path)
        docs, lengths, first, ids = load(_read(fs, f"{root}/{part.path}"))
        ends = np.cumsum(lengths)
        cuts = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
        columns = [pa.array(docs, self.id_type), pa.array(ends - lengths + first + part.start, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in cuts], pa.int64())]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        if self.with_ids:
            columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in cuts], pa.list_(pa.int64())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


class IdFiles(DataSource):
    """format("id_files"): save(path) takes the rows of pfor.segments_of(); load(path) gives one row a document.

    Options of a reader: with_ids ("true" or "false"), id_type (the Spark type of the document ids, bigint as a rule).
    """

    @classmethod
    def name(cls) -> str:
        return "id_files"

    def schema(self) -> str:
        kind = self.options.get("id_type", "bigint")
        return f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * self._with_ids()

    def _with_ids(self) -> bool:
        return self.options.get("with_ids", "true").lower() == "true"

    def reader(self, schema) -> _Reader:
        from pyspark.sql.pandas.types import to_arrow_type

        return _Reader(self.options["path"], self._with_ids(), to_arrow_type(schema["doc_id"].dataType))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def save_ids(segments: DataFrame, path: str) -> str:
    """Writes the rows of pfor.segments_of() as files under path, which must be new. What is there after a failure has no _parts.json."""
    segments.sparkSession.dataSource.register(IdFiles)
    segments.write.format("id_files").mode("append").save(path)
    return path


def load_ids(spark: SparkSession, path: str, with_ids: bool = True, id_type: str = "bigint") -> DataFrame:
    """One row per document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    spark.dataSource.register(IdFiles)
    return spark.read.format("id_files").option("with_ids", str(with_ids).lower()).option("id_type", id_type).load(path)
