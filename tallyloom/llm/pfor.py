"""Token ids in patched frame-of-reference blocks, and the segments that hold them; id_files writes and reads these.

A segment's bytes, all little-endian:

    "PFR1", ids (u64), ids to a block (u32), blocks (u32)
    index: where each block starts, and the end (u64 each), counted from the first block
    block: least id (u32), width (u8), exceptions (u16),
           places of the exceptions (u16 each), their full ids (u32 each),
           all ids less the least, width bits each (an exception's are 0), the last byte filled with 0

width is what PERCENT of the block's values fit in. The index lets a reader go to one block without those before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SPACED, encoder_of
from .shared import small_batches

MAGIC = b"PFR1"
BLOCK = 512
PERCENT = 90
SEGMENT = 1_000_000
#: Estimated bytes of chunks that a worker remembers: the data source has workers of its own beside those that encode.
CHUNK_MEMO = 160_000_000


def _bits(x: np.ndarray) -> np.ndarray:
    """How many bits each value needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _block(part: np.ndarray, least: np.uint32, kept: np.ndarray, width: int, places: np.ndarray) -> bytes:
    packed = b""
    if width:
        packed = np.packbits(np.unpackbits(kept.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=width), bitorder="little").tobytes()
    return least.tobytes() + bytes([width]) + len(places).to_bytes(2, "little") + places.astype("<u2").tobytes() + part[places].tobytes() + packed


def pack(ids: np.ndarray, block: int = BLOCK, percent: float = PERCENT) -> bytes:
    if not 1 <= block <= 0xFFFF:
        raise ValueError("a block holds 1 to 65535 ids")
    ids = np.ascontiguousarray(ids, dtype="<u4")
    bodies, starts, whole = [], [0], len(ids) // block * block
    for rows in (ids[:whole].reshape(-1, block), ids[whole:].reshape(1, -1)):
        if not rows.size:
            continue
        leasts = rows.min(axis=1)
        lows = rows - leasts[:, None]
        needs = _bits(lows)
        k = min(rows.shape[1] - 1, int(rows.shape[1] * percent / 100))
        widths = np.partition(needs, k, axis=1)[:, k]
        odd = needs > widths[:, None]
        kept_rows = np.where(odd, 0, lows).astype("<u4")
        for part, least, kept, width, places in zip(rows, leasts, kept_rows, widths.tolist(), map(np.flatnonzero, odd), strict=True):
            body = _block(part, least, kept, width, places)
            bodies.append(body)
            starts.append(starts[-1] + len(body))
    head = MAGIC + len(ids).to_bytes(8, "little") + block.to_bytes(4, "little") + len(bodies).to_bytes(4, "little")
    return head + np.asarray(starts, dtype="<u8").tobytes() + b"".join(bodies)


class Segment:
    """Reads what pack() wrote."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of packed ids")
        self.n, self.block, self.blocks = (int.from_bytes(data[a:b], "little") for a, b in ((4, 12), (12, 16), (16, 20)))
        self.starts = np.frombuffer(data, "<u8", self.blocks + 1, 20).astype(np.int64) + 20 + 8 * (self.blocks + 1)
        self.data = data
        if self.starts[-1] != len(data):
            raise ValueError("a segment of packed ids is cut short")

    def read_block(self, k: int) -> np.ndarray:
        at, n = int(self.starts[k]), min(self.block, self.n - k * self.block)
        least = int.from_bytes(self.data[at : at + 4], "little")
        width, odd = self.data[at + 4], int.from_bytes(self.data[at + 5 : at + 7], "little")
        places = np.frombuffer(self.data, "<u2", odd, at + 7)
        full = np.frombuffer(self.data, "<u4", odd, at + 7 + 2 * odd)
        out = np.zeros((n, 4), dtype=np.uint8)
        if width:
            packed = np.frombuffer(self.data, np.uint8, (n * width + 7) // 8, at + 7 + 6 * odd)
            bits = np.unpackbits(packed, bitorder="little", count=n * width).reshape(n, width)
            whole = np.packbits(bits, axis=1, bitorder="little")
            out[:, : whole.shape[1]] = whole
        ids = out.view("<u4").ravel() + np.uint32(least)
        ids[places] = full
        return ids

    def read(self) -> np.ndarray:
        return np.concatenate([self.read_block(k) for k in range(self.blocks)]) if self.blocks else np.empty(0, "<u4")


def segments_of(
    docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT
) -> DataFrame:
    """The ids of all documents by the tokenizer at path, end_id after each, in ascending id order, as a table of segments.

    One row per segment, for id_files.save_ids(): part and segment (their order is that of
    the ids), doc_ids array, lengths array<long>, first (ids of the part's segments before it), n_tokens, data (the bytes above). A segment is closed once it holds
    `segment` ids, so one holds more only by its last document. Null texts are empty, null ids come first; rows that share an
    id go by their text. Range partitions are cut by id and text hash, so that no id need fit one partition.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        end, part, number = np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId(), 0
        held, ids, lengths, n, written = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            data = b"".join(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int64())), pa.array([written], pa.int64()), pa.array([len(data) // 4], pa.int64()), pa.array([pack(np.frombuffer(data, "<u4"))], pa.binary())],
                ["part", "segment", "doc_ids", "lengths", "first", "n_tokens", "data"],
            )

        for batch in batches:
            id_type = batch.column("id").type
            for doc, packed in zip(batch.column("id").to_pylist(), encoder_of(path, SPACED, CHUNK_MEMO)(batch.column("text")), strict=True):
                held.append(packed + end)
                ids.append(doc)
                lengths.append(len(packed) // 4 + 1)
                n += lengths[-1]
                if n >= segment:
                    yield close()
                    written += n
                    held, ids, lengths, n, number = [], [], [], 0, number + 1
        if ids:
            yield close()

    dealt = (
        docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("id", "tie")
        .sortWithinPartitions("id", "tie")
        .select("id", "text")
    )
    return dealt.mapInArrow(run, f"part long, segment long, doc_ids array<{kind}>, lengths array<long>, first long, n_tokens long, data binary")
