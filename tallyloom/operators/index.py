"""Most similar records without comparing all with all.

Records that share their flags, and whose numbers are of like size, form a cell; a cell has a box (the least and greatest of every number in it) and
a count. What a test's similarity to any record of a cell is at most and at least follows from the cell's flags and box. The cells that are
certain to hold k candidates give a similarity that the k-th best can't fall below; only cells that may reach it are joined with the test.
Flags alone make 2**15 cells at most, so the driver holds a bounded table of cells, however many records there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import similar
from tallyloom.operators.scoring import complexity_band
from tallyloom.plans.dims import FEATURES, FLAG_FEATURES, NUMERIC_FEATURES

#: Cells that the driver takes. Beyond them numbers are told apart more coarsely, at last not at all.
MOST_CELLS = 1 << 17
#: Steps of a number's size by doublings: at first half a doubling, then one, then none.
STEPS = (2, 1, 0)
#: Test-cell pairs that a task looks at in one go.
AT_ONCE = 1 << 19
#: And in all, were none passed over: tests are dealt out to as many tasks as that takes.
IN_TASK = 1 << 25
#: Cells of the likest flags that tell tests of one pattern of flags which others to pass over.
FIRST = 512
SLACK = 1e-6


def _weights() -> tuple[np.ndarray, np.ndarray]:
    flags, numbers = np.zeros(len(FLAG_FEATURES)), np.zeros(len(NUMERIC_FEATURES))
    for own_flags, flag_weight, own_numbers, number_weight in similar.PROFILES:
        for c in own_flags:
            flags[FLAG_FEATURES.index(c)] += flag_weight
        for c in own_numbers:
            numbers[NUMERIC_FEATURES.index(c)] += number_weight
    return flags, numbers


def _cell_columns(step: int, kind: Column) -> list[Column]:
    size = lambda c: F.floor(F.log2(F.greatest(F.abs(F.coalesce(F.col(c), F.lit(0)).cast("double")), F.lit(1.0))) * step)
    return [kind, *map(F.col, FLAG_FEATURES), complexity_band(), *((size(c) if step else F.lit(0)) for c in NUMERIC_FEATURES)]


def _cells(records: DataFrame, most: int, kind: Column) -> tuple[pa.Table | None, int]:
    """(one row for each cell, the step that they were made with); None where even flags alone make too many, as with many null flags."""
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in NUMERIC_FEATURES]
    for step in STEPS:
        found = (
            records.select(*FLAG_FEATURES, complexity_band().alias("band"), kind.alias("kind"), F.xxhash64(*_cell_columns(step, kind)).alias("cell"), *numbers)
            .groupBy("cell", "band", "kind", *FLAG_FEATURES)
            .agg(F.count("*").alias("n"), *(f(c).alias(f"{a}_{c}") for c in NUMERIC_FEATURES for a, f in (("lo", F.min), ("hi", F.max))))
        )
        table = found.limit(most + 1).toArrow()
        if table.num_rows <= most:
            return table, step
    return None, 0


def _states(columns: list[pa.Array]) -> np.ndarray:
    """Flags as one-hot columns of false, true and missing."""
    out = []
    for c in columns:
        missing = c.is_null().to_numpy(zero_copy_only=False)
        value = c.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        out += [~value & ~missing, value & ~missing, missing]
    return np.array(out, dtype=np.float64).T.reshape(-1, 3 * len(columns))


def _closeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 1 - np.abs(x - y) / np.maximum(np.maximum(np.abs(x), np.abs(y)), 1.0)


def bounds(flags: np.ndarray, numbers: np.ndarray, cell_flags: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at least, at most): the similarity of every test with any record of every cell."""
    return _bounds_from((flags * np.repeat(_weights()[0], 3)) @ cell_flags.T, numbers, low, high)


def _bounds_from(same: np.ndarray, numbers: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """bounds() from what flags alone give."""
    least, most = same + np.zeros((len(numbers), 1)), same + np.zeros((len(numbers), 1))
    for j, weight in enumerate(_weights()[1]):
        x, lo, hi = numbers[:, j, None], low[None, :, j], high[None, :, j]
        best = np.where(x < lo, _closeness(x, lo), np.where(x > hi, _closeness(x, hi), 1.0))
        worst = np.minimum(_closeness(x, lo), _closeness(x, hi))
        odd = (x < 0) | (lo < 0)  # across zero, closeness doesn't fall steadily
        most += weight * np.where(odd, 1.0, best)
        least += weight * np.where(odd, -1.0, worst)
    return least, most


def _floor(low: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """What each test's k-th best among the cells can't fall below; low is -inf where it doesn't look."""
    order = np.argsort(-low, axis=1, kind="stable")
    at_least = np.take_along_axis(low, order, axis=1)
    enough = np.cumsum(np.where(np.isfinite(at_least), n[order], 0), axis=1) > k  # the test itself may be one of them
    return np.where(enough.any(axis=1), at_least[np.arange(len(low)), enough.argmax(axis=1)], -np.inf)


def _floors(low: np.ndarray, n: np.ndarray, kinds: np.ndarray, k: int, count: int) -> np.ndarray:
    """_floor() of every test in each of count kinds."""
    out = np.full((len(low), count), -np.inf)
    for of in np.unique(kinds):
        some = kinds == of
        out[:, of] = _floor(low[:, some], n[some], k)
    return out


def _wanted(same: np.ndarray, numbers: np.ndarray, margin: np.ndarray, held: dict, cells: np.ndarray, k: int, each_kind: bool) -> tuple[np.ndarray, np.ndarray]:
    """(tests, cells) that may matter, of tests with the same flags; same is what flags give for each cell, cells are those in scope.

    The cells of the likest flags give floors; a cell whose flags keep it under these, whatever its numbers are, is passed over.
    """
    near = cells if len(cells) <= FIRST else cells[np.argpartition(-same[cells], FIRST)[:FIRST]]
    low, _ = _bounds_from(same[near], numbers, held["low"][near], held["high"][near])
    floor = _floor(low, held["n"][near], k)
    best = same[cells] + _weights()[1].sum() + SLACK
    open_ = best >= (floor - margin).min()
    if each_kind:
        floors = _floors(low, held["n"][near], held["kinds"][near], k, held["count"])
        open_ &= best >= floors.min(axis=0)[held["kinds"][cells]]
    some = cells[open_]
    found = []
    height = max(1, AT_ONCE // max(1, len(some)))
    for at in range(0, len(numbers), height):
        part = slice(at, at + height)
        low, high = _bounds_from(same[some], numbers[part], held["low"][some], held["high"][some])
        wanted = high >= (np.maximum(floor[part], _floor(low, held["n"][some], k)) - margin[part] - SLACK)[:, None]
        if each_kind:
            own = np.maximum(floors[part], _floors(low, held["n"][some], held["kinds"][some], k, held["count"]))
            wanted &= high >= own[:, held["kinds"][some]] - SLACK
        test, cell = np.nonzero(wanted)
        found.append((test + at, some[cell]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


@dataclass(frozen=True)
class Index:
    """The cells of a table of records, on the driver and broadcast: most_cells rows at most. None where there would be more."""

    count: int
    step: int
    bands: Column
    least: int | None
    cells: Broadcast | None
    kind: Column


def index_of(records: DataFrame, least: int | None = None, most_cells: int = MOST_CELLS, kind: Column | None = None) -> Index:
    """least: how many candidates a test should have before its complexity band is widened; None takes all records.

    kind: a long of the records of which there are few values; records of one cell are of one kind.
    """
    kind = F.lit(0).cast("long") if kind is None else kind
    table, step = _cells(records, most_cells, kind)
    if table is None:
        return Index(records.count(), 0, similar.allowed_bands(records, least), least, None, kind)
    band, n, kinds = (table.column(c).to_numpy() for c in ("band", "n", "kind"))
    different, kinds = np.unique(kinds, return_inverse=True)
    patterns, pattern = np.unique(_states([table.column(c).combine_chunks() for c in FLAG_FEATURES]), axis=0, return_inverse=True)
    cells = {
        "cell": table.column("cell").to_numpy(),
        "band": band,
        "kinds": kinds,
        "count": len(different),
        "n": n,
        "patterns": patterns,
        "pattern": pattern.ravel(),
        "low": np.stack([table.column(f"lo_{c}").to_numpy() for c in NUMERIC_FEATURES], axis=1),
        "high": np.stack([table.column(f"hi_{c}").to_numpy() for c in NUMERIC_FEATURES], axis=1),
    }
    counts = {int(b): int(n[band == b].sum()) for b in np.unique(band)}
    return Index(int(n.sum()), step, similar.bands_for(counts, least), least, records.sparkSession.sparkContext.broadcast(cells), kind)


def near_pairs(
    records: DataFrame, tests: DataFrame, k: int, index: Index, margin: Column | None = None, each_kind: bool = False, more: tuple[str, ...] = ()
) -> DataFrame:
    """Of similar.candidates(records, tests, least), all of every test's k most similar, and of others some: the same columns.

    index is that of records, or of a table of which records keeps the first k + 1 by pos of equal features. margin, over the columns of tests, asks for all
    whose similarity is less than the k-th best's by that much at most, and each_kind leaves of these, for each kind of the index, its k most similar and
    some others, and adds kind. more are columns of records that are kept, where the index has cells. Ties are kept. Tests and records are told apart by pos
    alone, as there. Tests of one pattern of flags are dealt out together: such a group costs an operation for each cell, a test a few for each cell whose
    flags are alike enough, and one comparison for each record of the cells that may matter.
    """
    if index.cells is None:
        return similar.candidates(records, tests, index.least, bands=index.bands)
    shared, step = index.cells, index.step
    own = F.struct(*FEATURES)
    asked = tests.select(
        F.col("pos").alias("test_pos"),
        F.col("id").alias("test_id"),
        (F.lit(0.0) if margin is None else margin).cast("double").alias("margin"),
        complexity_band().alias("band"),
        *FLAG_FEATURES,
        *(F.coalesce(F.col(c), F.lit(0)).cast("double").alias("n_" + c) for c in NUMERIC_FEATURES),
        own.alias("a"),
    )
    tasks = max(1, -(-tests.count() * len(shared.value["n"]) // IN_TASK))
    asked = asked.withColumn("bands", index.bands).repartitionByRange(tasks, F.xxhash64(*FLAG_FEATURES), "test_pos").sortWithinPartitions(F.xxhash64(*FLAG_FEATURES))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flags = _states([batch.column(c) for c in FLAG_FEATURES])
            numbers = np.stack([batch.column("n_" + c).to_numpy() for c in NUMERIC_FEATURES], axis=1)
            margins = batch.column("margin").fill_null(np.inf).to_numpy()
            scope = np.zeros((batch.num_rows, 3), bool)
            for i, bands in enumerate(batch.column("bands").to_pylist()):
                scope[i, bands] = True
            groups, of = np.unique(np.hstack([flags, scope]), axis=0, return_inverse=True)
            for g, tests_ in enumerate(np.split(np.argsort(of.ravel(), kind="stable"), np.cumsum(np.bincount(of.ravel()))[:-1])):
                same = ((groups[g, :-3] * np.repeat(_weights()[0], 3)) @ held["patterns"].T)[held["pattern"]]
                cells = np.flatnonzero(groups[g, -3:].astype(bool)[held["band"]])
                height = max(1, AT_ONCE // max(1, min(len(cells), FIRST)))
                for at in range(0, len(tests_), height):
                    some = tests_[at : at + height]
                    test, cell = _wanted(same, numbers[some], margins[some], held, cells, k, each_kind)
                    pairs = np.unique(np.stack([some[test], held["cell"][cell]], axis=1), axis=0)
                    for part in range(0, len(pairs), 10_000):
                        rows = batch.take(pa.array(pairs[part : part + 10_000, 0]))
                        yield pa.RecordBatch.from_arrays([rows.column("test_pos"), rows.column("test_id"), rows.column("a"), pa.array(pairs[part : part + 10_000, 1], pa.int64())], ["test_pos", "test_id", "a", "cell"])

    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    wanted = asked.mapInArrow(visit, f"test_pos {kinds['test_pos']}, test_id {kinds['test_id']}, a {kinds['a']}, cell long")
    right = records.select("pos", "id", index.kind.alias("kind"), F.xxhash64(*_cell_columns(step, index.kind)).alias("cell"), own.alias("b"), *more)
    joined = wanted.join(right.hint("merge"), "cell").filter("pos <> test_pos")  # a small file's rows may be too many for the driver
    return joined.select("test_pos", "test_id", "pos", "id", *(["kind"] if each_kind else []), *more, similar.similarity().alias("similarity"))


def most_similar(records: DataFrame, tests: DataFrame, k: int, least: int | None = None, index: Index | None = None) -> DataFrame:
    """similar.nearest(similar.candidates(records, tests, least), k), by way of the cells.

    Of records with the same features only the first k + 1 by pos can be among anyone's k nearest; no others are joined.
    """
    index = index or index_of(records, least)
    w = Window.partitionBy(*FEATURES).orderBy("pos")
    first = records.withColumn("__copy", F.row_number().over(w)).filter(F.col("__copy") <= k + 1).drop("__copy")
    return similar.nearest(near_pairs(first, tests, k, index), k)
