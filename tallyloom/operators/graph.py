"""Depth over parent links: whole targets in one pass, very large ones by pointer doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.lineage import cut, cut_counting

CONTROL = ("control_repeat", "control_forever", "control_if")
#: A target of more blocks is not walked by one task.
LARGE = 500_000
#: Tables that Spark takes for smaller than this are walked without counting their targets first.
SMALL_BYTES = 256 << 20
#: Rows of whole targets that a task walks at a time.
CHUNK = 200_000
_TARGET = ["project_id", "target_idx"]
_KEY = [*_TARGET, "block_id"]


def _control(opcode: str) -> Column:
    out = F.lit(False)
    for prefix in CONTROL:
        out = out | F.coalesce(F.col(opcode).startswith(prefix), F.lit(False))
    return out


def _numbers(*columns: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """The same number for equal values of any of the columns, -1 for null."""
    whole = pa.chunked_array([pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in columns])
    codes = pc.fill_null(whole.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def _starts(table: pa.Table) -> np.ndarray:
    """The first row of every target."""
    return np.flatnonzero(table.column("__place").to_numpy() == 1)


def walk(target: np.ndarray, block: np.ndarray, parent: np.ndarray, control: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth, nested, cyclic) of rows of many targets at once; block and parent are numbers, -1 for none.

    Of rows with the same block number in a target, the first is the parent. A chain is no longer than there are rows, so that one that
    goes on for as long is a cycle; depth is 0 there.
    """
    n = len(block)
    width = max(int(block.max(initial=0)), int(parent.max(initial=0))) + 2
    rows = np.flatnonzero(block >= 0)
    key = target[rows] * width + block[rows]
    by = np.argsort(key, kind="stable")
    key, rows = key[by], rows[by]
    wanted = target * width + parent
    at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
    found = (parent >= 0) & (key[at] == wanted) if len(key) else np.zeros(n, bool)
    to = np.where(found, rows[at] if len(rows) else 0, -1)
    depth = np.where(to >= 0, control[to], False).astype(np.int64)
    nested = control & (depth > 0)
    longest = int(np.bincount(target).max(initial=1)) if n else 1
    live = np.flatnonzero(to >= 0)
    for _ in range(longest.bit_length()):
        if not len(live):
            break
        ahead = to[live]
        more, beyond = depth[ahead], to[ahead]
        depth[live] += more
        to[live] = beyond
        live = live[beyond >= 0]
    cyclic = to >= 0
    return np.where(cyclic, 0, depth), nested, cyclic


def _walked(blocks: DataFrame) -> DataFrame:
    """Whole targets in a task each, several at a time."""
    order = Window.partitionBy(*_TARGET).orderBy("block_id", "opcode", "parent_id")  # deals targets out, unless they are so already
    near = blocks.withColumns({"__control": _control("opcode"), "__place": F.row_number().over(order)})

    def measured(table: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = _starts(table)
        target = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        block, parent = _numbers(table.column("block_id").combine_chunks(), table.column("parent_id").combine_chunks())
        control = table.column("__control").to_numpy()
        depth, nested, cyclic = walk(target, block, parent, control)
        out = table.drop_columns(["__control", "__place"]).append_column("depth", pa.array(depth)).append_column("nested", pa.array(nested)).append_column("cyclic", pa.array(cyclic))
        yield from out.to_batches(max_chunksize=10_000)

    def pass_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                table = pa.Table.from_batches(held).combine_chunks()
                last = int(_starts(table)[-1])
                if last:
                    yield from measured(table.slice(0, last).combine_chunks())
                held = table.slice(last).combine_chunks().to_batches()
                n = table.num_rows - last
        if n:
            yield from measured(pa.Table.from_batches(held).combine_chunks())

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
    return near.mapInArrow(pass_over, f"{kinds}, depth long, nested boolean, cyclic boolean")


def _doubled(blocks: DataFrame, longest: int) -> DataFrame:
    """Targets of any size: every round doubles how far a block's pointer reaches, by one join, cut to the shared folder."""
    first = F.min(F.struct("opcode", "parent_id", _control("opcode").alias("control")))
    up = blocks.filter("block_id is not null").groupBy(*_KEY).agg(first.alias("b")).select(*_TARGET, F.col("block_id").alias("parent_id"), F.col("b.control").alias("parent_control"))
    whole = blocks.join(up, [*_TARGET, "parent_id"], "left").select(
        *blocks.columns,
        F.when(F.col("parent_control").isNotNull(), F.col("parent_id")).alias("__to"),
        F.coalesce(F.col("parent_control").cast("int"), F.lit(0)).cast("long").alias("depth"),
        (_control("opcode") & F.coalesce("parent_control", F.lit(False))).alias("nested"),
    )
    whole = cut(whole)
    state, left = cut_counting(
        whole.filter("block_id is not null").groupBy(*_KEY).agg(F.min(F.struct("opcode", "parent_id", "__to", "depth")).alias("b")).select(*_KEY, F.col("b.__to").alias("to"), F.col("b.depth").alias("depth")),
        "to is not null",
    )
    for _ in range(longest.bit_length()):
        if not left:
            break
        ahead = state.select(*_TARGET, F.col("block_id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        state, left = cut_counting(
            state.join(ahead, [*_TARGET, "to"], "left").select(*_KEY, F.col("next").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")),
            "to is not null",
        )
    # A block goes as far as its parent, and one step more.
    parents = state.select(*_TARGET, F.col("block_id").alias("__to"), F.col("depth").alias("__depth"), F.col("to").isNotNull().alias("__round"))
    cyclic = F.coalesce("__round", F.lit(False))
    return whole.join(parents, [*_TARGET, "__to"], "left").select(
        *blocks.columns, F.when(cyclic, F.lit(0)).otherwise(F.col("depth") + F.coalesce("__depth", F.lit(0))).cast("long").alias("depth"), "nested", cyclic.alias("cyclic")
    )


def _bytes(df: DataFrame) -> int:
    """What Spark's optimizer takes the size of df for: file sizes, without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def control_depth(blocks: DataFrame, large: int = LARGE, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """blocks with depth (control blocks among all its ancestors), nested (it and its direct parent are control), cyclic.

    A parent counts only if it stands on the same target; of several blocks with one id, the first by opcode and parent. Blocks on a cycle, or below one, are
    cyclic, and their depth is 0. A target is walked by one task, many of them at a time, after one exchange; no job
    runs before the caller's. Only where the table may be as large as small_bytes are targets counted first, and those of more than `large` blocks go by
    pointer doubling instead, log2 of the largest one's blocks in rounds.
    """
    if _bytes(blocks) < small_bytes:
        return _walked(blocks)
    counted = cut(blocks.groupBy(*_TARGET).agg(F.count("*").alias("__blocks")).filter(F.col("__blocks") > large))
    longest = counted.agg(F.max("__blocks").alias("n")).first().n
    if not longest:
        return _walked(blocks)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in _TARGET]
    l, r = blocks.alias("l"), counted.alias("r")
    return _walked(l.join(r, same, "left_anti")).unionByName(_doubled(l.join(r, same, "left_semi"), longest))
