"""Packing documents into fixed-length sequences by bin completion.

Pieces differ in length only, and there are at most `capacity` lengths, so the packing problem is a histogram, whatever
the number of documents. The driver solves it as a list of patterns (a filling, and how many sequences get it): the largest
remaining length is completed by an undominated filling of the room around it, applied as often as the counts
allow. The first incumbents are the best-fit-decreasing packing and the completion that always takes the fullest filling; branch
and bound then tries the other undominated fillings, cutting off where the waste already made rules out fewer
sequences than the incumbent has. Pieces get their place from their rank among those of the same length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import WORDS, encoder_of
from .shared import cut, enter, small_batches

CAPACITY = 2048
END_ID = 0
FILL_STEPS = 4000
FILLINGS = 6
NODES = 3000
SALT_ROWS = 100_000
#: Estimated bytes of chunks that a worker remembers: beside the ids of its texts, more than this costs memory and saves no measurable time.
WORD_MEMO = 64_000_000
#: A batch of pieces is handed on once it holds so many bytes of ids.
OUT_BYTES = 8_000_000


def _times(sums: int, x: int, least: int, most: int) -> int:
    """Of a set of sums as bits, those with least to most times x added."""
    out, n = sums << least * x, most - least + 1
    have = 1
    while have < n:
        more = min(have, n - have)
        out |= out << more * x
        have += more
    return out if n > 0 else 0


def dominated(filling: dict[int, int], counts: dict[int, int], room: int) -> bool:
    """Whether a length that is left could stand in the filling's room for some of its pieces, or beside them all, at no loss.

    It could for one shorter piece, or for several that are no longer in all: what it frees fits wherever it would have gone.
    """
    slack = room - sum(x * n for x, n in filling.items())
    none, one, several = 1, 0, 0  # sums of no, one, and two or more of the pieces
    for x, n in filling.items():
        several = _times(several, x, 0, n) | _times(one, x, 1, n) | (_times(none, x, 2, n) if n > 1 else 0)
        one |= none << x
    spare = 0
    for x, n in counts.items():
        if n > filling.get(x, 0):
            spare |= 1 << x
    wider = lambda sums, least: _times(sums, 1, least, slack) if slack >= least else 0
    return bool(spare & (wider(none, 1) | wider(one, 1) | wider(several, 0)))


def fillings(counts: dict[int, int], room: int, most: int = FILLINGS, steps: int = FILL_STEPS) -> list[tuple[int, ...]]:
    """Undominated multisets of counts' lengths that fit into room, fullest first, then those of longer lengths.

    Lengths are tried in descending order, each as often as it fits before fewer times, so that the search meets fillings of few
    long pieces first; it ends after `steps`, or once `most` fillings leave no room. It goes no deeper than there are different
    lengths in a filling, however many pieces that has.
    """
    if counts.get(room):
        return [(room,)]
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    if not lengths:
        return [()]
    falling = [-x for x in lengths]
    found: dict[tuple[tuple[int, int], ...], int] = {}
    left, exact = steps, 0

    def search(k: int, room: int, own: list[tuple[int, int]]) -> None:
        nonlocal left, exact
        k = bisect_left(falling, -room, k)
        if k == len(lengths):
            found[tuple(own)] = room
            exact += room == 0
            return
        while k < len(lengths):
            x = lengths[k]
            for n in range(min(counts[x], room // x), 0, -1):
                left -= 1
                search(k + 1, room - n * x, [*own, (x, n)])
                if left <= 0 or exact >= most:
                    return
            k += 1

    search(0, room, [])
    if not exact:
        best = _fullest(counts, lengths, room)
        found[best] = room - sum(x * n for x, n in best)
    order = sorted(found, key=lambda f: (found[f], [(-x, -n) for x, n in f]))
    out = []
    for f in order:
        if len(out) < most and not dominated(dict(f), counts, room):
            out.append(f)
    return [tuple(x for x, n in f for _ in range(n)) for f in out or order[:1]]


def _fullest(counts: dict[int, int], lengths: list[int], room: int) -> tuple[tuple[int, int], ...]:
    """A filling (length, times) with the least room left, by the sums that can be reached."""
    reached, layers = 1, []
    mask = (1 << room + 1) - 1
    for x in lengths:
        n, k = min(counts[x], room // x), 1
        while n > 0:
            k = min(k, n)
            layers.append((x, k, reached))
            reached |= reached << x * k & mask
            n -= k
            k *= 2
        if reached >> room & 1:
            break
    at, out = reached.bit_length() - 1, Counter()
    for x, k, before in reversed(layers):
        if not before >> at & 1:
            out[x] += k
            at -= x * k
    return tuple(sorted(out.items(), reverse=True))


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, lengths in each) by best-fit decreasing: a piece goes where it leaves the least room.

    Sequences that hold the same are one entry, so that the work follows the lengths and not the pieces.
    """
    groups: list[tuple[int, int, tuple[tuple[int, int], ...]]] = []  # (room, how many, lengths and times), least room first

    def add(room: int, many: int, held: tuple[tuple[int, int], ...]) -> None:
        if many:
            groups.insert(bisect_left(groups, (room,)), (room, many, held))

    for x in sorted((x for x, n in histogram.items() if n), reverse=True):
        n = histogram[x]
        while n:
            at = bisect_left(groups, (x,))
            room, many, held = groups.pop(at) if at < len(groups) else (capacity, n, ())
            each = room // x
            full = min(many, n // each)
            rest = n - full * each if full < many else 0
            add(room - each * x, full, (*held, (x, each)))
            if rest:
                add(room - rest * x, 1, (*held, (x, rest)))
            if held:  # what is left of a group; new sequences are opened as needed
                add(room, many - full - (rest > 0), held)
            n -= full * each + rest
    return [(many, tuple(x for x, n in held for _ in range(n))) for _, many, held in groups]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, lengths in each) that hold every piece of the histogram {length: count}.

    Each step of a completion uses up a length, so a packing by it has at most as many patterns as there are lengths, and so has the
    rest of any other. The search visits `nodes` states at most.
    """
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError("a length isn't between 1 and the capacity")
    total = sum(x * n for x, n in histogram.items())
    bound = max(-(-total // capacity), _large(histogram, capacity))

    def take(counts: dict[int, int], filling: tuple[int, ...], top: int) -> tuple[int, tuple[int, ...]]:
        pattern = (top, *filling)
        need = Counter(pattern)
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        return times, pattern

    def completions(counts: dict[int, int], most: int) -> list[tuple[int, ...]]:
        top = max(counts)
        counts[top] -= 1
        out = fillings(counts, capacity - top, most)
        counts[top] += 1
        return out

    full: list[tuple[int, tuple[int, ...]]] = []
    counts = {x: n for x, n in histogram.items() if n}
    while counts:
        full.append(take(counts, completions(counts, 1)[0], max(counts)))
    best = min((full, best_fit(histogram, capacity)), key=lambda p: (sum(n for n, _ in p), len(p)))
    fewest = sum(n for n, _ in best)

    stack = [({x: n for x, n in histogram.items() if n}, total, 0, [])] if fewest > bound else []
    while stack and nodes > 0 and fewest > bound:
        counts, rest, used, done = stack.pop()
        nodes -= 1
        if not counts:
            if used < fewest:
                fewest, best = used, done
            continue
        if used + max(-(-rest // capacity), _large(counts, capacity)) >= fewest:
            continue  # the waste of what is done rules out a better packing
        top = max(counts)
        for filling in reversed(completions(counts, FILLINGS)):
            after = dict(counts)
            times, pattern = take(after, filling, top)
            stack.append((after, rest - times * sum(pattern), used + times, [*done, (times, pattern)]))
    return best


def _large(counts: dict[int, int], capacity: int) -> int:
    """No two lengths over half the capacity share a sequence."""
    return sum(n for x, n in counts.items() if 2 * x > capacity)


def cut_pieces(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = True
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and ids if asked for. A map without a shuffle.

    ids are little-endian unsigned 32-bit numbers in a binary, which the JVM stores and sorts as it is.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            docs_of, rows, ids, held = batch.column("id"), [], [], 0

            def made() -> pa.RecordBatch:
                k, *rest = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                columns = [docs_of.take(pa.array(k, pa.int64())), pa.array(rest[0], pa.int32()), *(pa.array(x, pa.int64()) for x in rest[1:])]
                return pa.RecordBatch.from_arrays([*columns, *[pa.array(ids, pa.binary())] * with_ids], names)

            for k, packed in enumerate(encoder_of(path, WORDS, WORD_MEMO)(batch.column("text"))):
                data = packed + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((k, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        ids.append(part)
                held += len(data)
                if held > OUT_BYTES:
                    yield made()
                    rows, ids, held = [], [], 0
            yield made()

    fields = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    out = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, fields)
    return out.withColumnRenamed("id", "__id")


def unpacked(ids: pa.Array) -> pa.Array:
    """Lists of the numbers in a binary column without nulls."""
    data = ids.to_pylist()
    ends = np.cumsum([0, *map(len, data)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(data), "<u4").astype(np.int32)))


def as_arrays(packed: DataFrame) -> DataFrame:
    """packed with its binary ids as array<int>."""
    names = packed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("packing")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([unpacked(part.column(c)) if c == "ids" else part.column(c) for c in names], names)

    fields = ", ".join(f"`{f.name}` {'array<int>' if f.name == 'ids' else f.dataType.simpleString()}" for f in packed.schema)
    return packed.mapInArrow(run, fields)


def digest_ids(packed: DataFrame) -> DataFrame:
    """packed with the digest of its ids, taken from them anew, in place of ids and ids_crc32.

    Binary ids are digested as they are, without Python; those in arrays are made bytes again.
    """
    names = [c for c in packed.columns if c != "ids"]
    if packed.schema["ids"].dataType.simpleString() == "binary":
        return packed.withColumn("ids_crc32", F.crc32("ids")).select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            data, ends = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B"), ids.offsets.to_numpy().tolist()
            found = pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([found if c == "ids_crc32" else batch.column(c) for c in names], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema if f.name != "ids")
    return packed.mapInArrow(run, fields)


def pack_documents(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    with_ids: bool = True,
    arrays: bool = True,
) -> DataFrame:
    """The pieces of cut_pieces() with sequence_id and offset: where each stands, gapless from 0 in every sequence.

    In order of offset, the ids of a sequence's pieces are the sequence: array<int>, or with arrays=False a binary of little-endian
    unsigned 32-bit numbers. A column of the result that id_col already names gets a leading underscore.

    A document is its ids by the tokenizer in path, then end_id, so that an empty or null text is one piece of one id. Only documents
    longer than capacity are cut. Rows that share an id are packed each by itself. Other columns are not read. An empty
    table gives an empty result. The driver sees a histogram of at most `capacity` lengths; the runs that it broadcasts are
    fewer than the square of that, as no filling holds more different lengths than sum to the capacity. Ranks and places are
    found on rows of three numbers; the ids are moved once, to meet their place.
    """
    spark = docs.sparkSession
    pieces = cut(cut_pieces(docs, path, id_col, text_col, end_id, capacity, with_ids).withColumn("row", F.monotonically_increasing_id()), "zstd")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    runs, first = {}, 0
    for times, pattern in plan(histogram, capacity):
        offset = 0
        for x, n in Counter(pattern).items():
            own = runs.setdefault(x, [[0], [], [], []])
            own[0].append(own[0][-1] + n * times)
            for part, value in zip(own[1:], (first, n, offset), strict=True):
                part.append(value)
            offset += n * x
        first += times
    shared = spark.sparkContext.broadcast({x: [np.array(y) for y in own] for x, own in runs.items()})

    salts = max(16, -(-max(histogram.values(), default=1) // SALT_ROWS))
    salted = pieces.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"))
    order = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("before"))
    )
    ranked = (
        salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")))
        .join(before, ["length", "salt"])
        .select("row", "length", (F.col("rank") + F.col("before") - 1).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("packing")
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                ends, firsts, per, offsets = shared.value[int(x)]
                run = np.searchsorted(ends, rank[own], side="right") - 1
                within = rank[own] - ends[run]
                sequence[own] = firsts[run] + within // per[run]
                offset[own] = offsets[run] + within % per[run] * x
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sequence), pa.array(offset)], ["row", "sequence_id", "offset"])

    placed = pieces.join(ranked.mapInArrow(place, "row long, sequence_id long, offset long"), "row").drop("row")
    placed = as_arrays(placed) if with_ids and arrays else placed
    free = lambda c: "_" + c if c.lower() == id_col.lower() else c
    return placed.select(F.col("__id").alias(id_col), *(F.col(c).alias(free(c)) for c in placed.columns if c != "__id"))
