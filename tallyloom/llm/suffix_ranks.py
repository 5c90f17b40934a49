"""Suffix-array dedup: distributed prefix doubling over byte positions.

A removed byte lies in a string of LENGTH bytes that also starts in an earlier document. Positions are ranked by growing prefixes, and
those whose rank no other document shares drop out. A rank is a 64-bit hash in place of a dense number, so that equal prefixes have equal ranks
without a global count; Spark deals rank records out by ranges of rank, and each range is sorted in its task.

Round 1 ranks prefixes of GRAM bytes at positions chosen by content: a string of LENGTH bytes is placed at the least rank of the LENGTH - GRAM + 1
prefixes that start in it, which is the same wherever the string stands. Neighbouring strings with the same least rank make one run, with
a second rank of its whole content; there are about LENGTH - GRAM + 1 strings to two runs. A run that an earlier document holds in the same content is
removed; one whose rank only one document has drops out; what is left is contested.

Round 2 looks at every string of the contested runs: ranks of GRAM bytes are paired at offset GRAM, and these pairs again with a third at offset
LENGTH - GRAM, which is past the threshold. Strings whose rank an earlier document has as well are removed. A rank that very many different runs share
is hot, and its strings are dealt out by their own ranks.

Within a task equal records of later documents are settled before anything is dealt out, so that a text, line or passage however frequent
leaves one record a task. Records go as compressed blobs, one for each task and target; nothing but counts reaches the driver. Texts are
compressed and moved twice, to the contested runs and to the removed ranges.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard, small_batches

LENGTH = 50
GRAM = 20
#: Bytes of text for each range of ranks and each part of the documents, for a flush of a task, and for a piece looked at in one go.
RANGE_BYTES = 12 << 20
FLUSH_BYTES = 10 << 20
PIECE = 1 << 17
#: Windows in a range of the hot ones, and the runs of one rank from which it is hot.
HOT_WINDOWS = 2 << 20
HOT_RUNS = 1024
TEXT, REMOVED, CONTESTED, HOT, RUNS = range(5)
ROWS = "kind int, place int, windows long, blob binary"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
NO_ID = np.iinfo(np.int64).max


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def grams(data: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A rank of the k bytes at every position that has k; another one for every salt."""
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    padded = data.tobytes() + bytes(8)
    words = np.ndarray((len(data),), "<u8", padded, 0, (1,)).astype(np.uint64)
    if k < 8:
        words &= np.uint64((1 << 8 * k) - 1)
    if salt:
        words = mix(words + _C * np.uint64(salt))
    out = words[:n] * _A
    for at in [*range(8, k - 8, 8), k - 8] if k > 8 else []:
        out = mix(out + _C) + words[at : at + n] * _B
    return mix(out)


def least(ranks: np.ndarray, width: int) -> np.ndarray:
    """The least of every width neighbours."""
    size = 1
    while 2 * size <= width:
        ranks = np.minimum(ranks[: len(ranks) - size], ranks[size:])
        size *= 2
    rest = width - size
    return np.minimum(ranks[: len(ranks) - rest], ranks[rest:]) if rest else ranks


def runs_of(data: np.ndarray, start: np.ndarray, size: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(piece, first window, windows, rank, content rank) of all runs in the pieces of data; those shorter than length have none."""
    piece = np.flatnonzero(size >= length)
    first = start[piece]
    if not len(piece):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    last = first + size[piece] - length
    rank = grams(data, gram)
    low = least(rank, length - gram + 1)
    new = np.zeros(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    new[first] = True
    inside = np.zeros(len(low) + 1, np.int8)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    at = np.flatnonzero(new & (np.cumsum(inside[:-1], dtype=np.int8) > 0))
    own = np.searchsorted(first, at, "right") - 1
    windows = np.minimum(np.append(at[1:], len(low)), last[own] + 1) - at
    # The content of a run, tiled by grams, the last of which ends with it. The least of many ranks is small: mixed, it is spread evenly again.
    whole = windows + length - 1
    tiles = -(-whole // gram)
    ahead = np.cumsum(tiles) - tiles
    number = np.arange(tiles.sum()) - np.repeat(ahead, tiles)
    where = np.minimum(np.repeat(at, tiles) + number * gram, np.repeat(at + whole - gram, tiles))
    content = np.add.reduceat(mix(rank[where] + (number.astype(np.uint64) + np.uint64(1)) * _A), ahead)
    return piece[own], at, windows, mix(low[at]), mix(content + windows.astype(np.uint64) * _C)


def window_ranks(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent ranks of the length bytes at each of at: equal strings agree in both, others in 128 bits of hash."""
    return _window_rank(grams(data, gram), at, length, gram), _window_rank(grams(data, gram, 1), at, length, gram)


def _window_rank(rank: np.ndarray, at: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Pairs of ranks at offset gram, as long as it fits, then one that ends with the string."""
    out, reach = rank[at], gram
    while reach + gram <= length:
        out = mix(out * _A + rank[at + reach])
        reach += gram
    return mix(out * _B + rank[at + length - gram]) if reach < length else out


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, size of them."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns in one compressed blob, byte by byte of like places."""
    head = [struct.pack("<I", len(columns))]
    body = []
    for c in columns:
        head.append(struct.pack("<cIQ", c.dtype.kind.encode(), c.dtype.itemsize, len(c)))
        body.append(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes() if len(c) else b"")
    raw = b"".join(head + body)
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(memoryview(blob)[8:], struct.unpack_from("<Q", blob)[0], asbytes=True)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + 13 * n, []
    for i in range(n):
        kind, item, size = struct.unpack_from("<cIQ", raw, 4 + 13 * i)
        flat = np.frombuffer(raw, np.uint8, size * item, at).reshape(item, size)
        out.append(np.ascontiguousarray(flat.T).reshape(-1).view(f"{kind.decode()}{item}"))
        at += size * item
    return out


def _records(order: np.ndarray, text: np.ndarray, doc: np.ndarray, at: np.ndarray, *more: np.ndarray) -> bytes:
    """A blob of records (document, at, ...) with the documents that they stand in; order and text are sorted, records go by (doc, at)."""
    used, doc = np.unique(doc, return_inverse=True)
    steps = np.diff(order[used].astype(np.uint64), prepend=np.uint64(0))
    moved = np.diff(doc, prepend=0)
    near = np.where(moved == 0, np.diff(at, prepend=0), at)
    if len(near):
        near[0] = at[0]
    return squeeze(steps, text[used], moved.astype(np.uint32), near.astype(np.uint64), *more)


def _unrecord(blob: bytes) -> tuple[np.ndarray, ...]:
    """(order and text of the documents; document, at and the other columns of the records)."""
    steps, text, moved, near, *more = unsqueeze(blob)
    order = np.cumsum(steps, dtype=np.uint64).astype(np.int64)
    doc = np.cumsum(moved.astype(np.int64))
    at = np.cumsum(near.astype(np.int64))
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    at -= np.repeat(at[new] - near[new].astype(np.int64), np.diff(np.append(new, len(doc))))
    return order, text, doc, at, *more


def settled(order: np.ndarray, *key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorting by key, then order; for each in that sorting, whether an earlier document has the same key; and whether a key starts there)."""
    by = np.lexsort((order, *reversed(key)))
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = False
        for k in key:
            s = k[by]
            new[1:] |= s[1:] != s[:-1]
    held = order[by]
    first = held[np.flatnonzero(new)][np.cumsum(new) - 1]
    return by, held > first, new


def _parts(order: np.ndarray, text: np.ndarray, parts: int) -> np.ndarray:
    return (mix(order.astype(np.uint64) * _A + text) % np.uint64(parts)).astype(np.int64)


def _range(rank: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many equal ranges of ranks each lies in."""
    return ((rank >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kind, place, windows, blob = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(place, pa.int32()), pa.array(windows, pa.int64()), pa.array(blob, pa.binary())], ["kind", "place", "windows", "blob"]
    )


def _dealt(kind: int, place: np.ndarray, order: np.ndarray, text: np.ndarray, doc: np.ndarray, at: np.ndarray, windows: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Records as rows of this kind, one for each place that gets any."""
    by = np.lexsort((at, doc, place))
    ends = np.flatnonzero(np.diff(place[by], append=-1)) + 1
    begin = 0
    for end in ends.tolist():
        own = by[begin:end]
        yield _batch([(kind, int(place[own[0]]), int(windows[own].sum()), _records(order, text, doc[own], at[own], windows[own].astype(np.uint32), *(m[own] for m in more)))])
        begin = end


def _joined(doc: np.ndarray, at: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that follow one another in a document, as one."""
    by = np.lexsort((at, doc))
    doc, at, windows = doc[by], at[by], windows[by]
    new = np.ones(len(by), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + windows[:-1])
    start = np.flatnonzero(new)
    return doc[start], at[start], np.add.reduceat(windows, start) if len(start) else windows


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(data, start, size, order, text rank, no id) of about `most` bytes of documents each."""
    held, weight = [], 0

    def joined() -> tuple[np.ndarray, ...]:
        data, size, order, text, none = (np.concatenate(x) for x in zip(*held, strict=True))
        return data, np.cumsum(size) - size, size, order, text, none

    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("text")
        wide = np.dtype(np.int64 if pa.types.is_large_string(column.type) else np.int32)
        ends = np.frombuffer(column.buffers()[1], wide, len(column) + 1, wide.itemsize * column.offset).astype(np.int64)
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]].copy() if body is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
        ids = batch.column("id")
        none = ids.is_null().to_numpy(zero_copy_only=False)
        held.append((data, np.diff(ends), ids.fill_null(NO_ID).to_numpy(), batch.column("rank").to_numpy().view(np.uint64), none))
        weight += len(data)
        if weight >= most:
            yield joined()
            held, weight = [], 0
    if held:
        yield joined()


def _distinct(order: np.ndarray, text: np.ndarray, none: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one of every different document, by order; how often it occurs)."""
    by = np.lexsort((none, text, order))
    new = np.ones(len(by), bool)
    new[1:] = (order[by][1:] != order[by][:-1]) | (text[by][1:] != text[by][:-1]) | (none[by][1:] != none[by][:-1])
    start = np.flatnonzero(new)
    return by[start], np.diff(np.append(start, len(by)))


def _pieces(start: np.ndarray, size: np.ndarray, length: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents, as (document, start, size) of pieces, some `most` bytes at a time; a long one's pieces share length - 1 bytes."""
    n = np.maximum(1, -(-(size - length + 1) // most))
    doc = np.repeat(np.arange(len(size)), n)
    k = _spread(np.zeros(len(n), np.int64), n)
    begin = start[doc] + k * most
    own = np.minimum(start[doc] + size[doc] - begin, most + length - 1)
    keep = own >= length
    doc, begin, own = doc[keep], begin[keep], own[keep]
    group = np.cumsum(own) // most
    for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(group)) + 1):
        if len(part):
            yield doc[part], begin[part], own[part]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, spans (array of (start, size) of the removed runs), kept (the bytes left).

    Removed is each byte covered by a string of length bytes that also starts in a document with a smaller id; strings are judged on the input, overlaps
    count, none crosses documents. A null text counts as empty; ids are integers. A null id is larger than every other, and documents
    without an id, or with the same, take nothing from one another. A text shorter than length stays whole. Equal rows each have a
    row. An empty table gives an empty result; other columns are not read. gram is 1 at least and length at most.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must lie between 1 and length")
    spark = docs.sparkSession
    small_batches(spark)
    kind_of_id = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("rank"), text.alias("text"))
    total = own.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    ranges = max(1, math.ceil(total / RANGE_BYTES))
    bytes_at = lambda data, start, size: data[_spread(start, size)]

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, start, size, order, rank, none in _texts(batches, FLUSH_BYTES):
            one, _ = _distinct(order, rank, none)
            start, size, order, rank = start[one], size[one], order[one], rank[one]
            found = []
            for doc, begin, n in _pieces(start, size, length, PIECE):
                low, high = int(begin.min()), int((begin + n).max())
                if high - low > 4 * int(n.sum()):  # documents are in order of id, and may be scattered over data
                    flat, low, local = bytes_at(data, begin, n), 0, np.cumsum(n) - n
                else:
                    flat, local = data[low:high], begin - low
                by = np.argsort(local, kind="stable")
                piece, at, windows, key, content = runs_of(flat, local[by], n[by], length, gram)
                piece = by[piece]
                found.append((doc[piece], at - local[piece] + begin[piece] - start[doc[piece]], windows, key, content))
            if not found:
                continue
            doc, at, windows, key, content = (np.concatenate(x) for x in zip(*found, strict=True))
            by, later, _ = settled(order[doc], key, content)
            gone, left = by[later], by[~later]
            where = _parts(order, rank, ranges)
            d, a, w = _joined(doc[gone], at[gone], windows[gone])
            yield from _dealt(REMOVED, where[d], order, rank, d, a, w)
            yield from _dealt(RUNS, _range(key[left], ranges), order, rank, doc[left], at[left], windows[left], key[left], content[left])

    def gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        """All records of a range: (order, text rank, document, at, windows, ...), documents numbered through."""
        held, n = [], 0
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                order, rank, doc, *rest = _unrecord(blob)
                held.append((order, rank, doc + n, *rest))
                n += len(order)
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def sort_runs(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if group[0].as_py() == REMOVED:
            yield from (b.select(["kind", "place", "windows", "blob"]) for b in batches)
            return
        order, rank, doc, at, windows, key, content = gathered(batches)
        by, later, new = settled(order[doc], key, content)
        ranked = key[by]
        fresh = np.ones(len(by), bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        begin = np.flatnonzero(fresh)
        different = np.add.reduceat(new.astype(np.int64), begin)
        ids = order[doc][by]
        shared = np.maximum.reduceat(ids, begin) > np.minimum.reduceat(ids, begin)
        of = np.cumsum(fresh) - 1
        open_ = ~later & ((different > 1) & shared)[of]
        hot = open_ & (different > HOT_RUNS)[of]
        where = _parts(order, rank, ranges)
        for kind, mask in ((REMOVED, later), (CONTESTED, open_ & ~hot), (HOT, hot)):
            i = by[mask]
            yield from _dealt(kind, where[doc[i]], order, rank, doc[i], at[i], windows[i], *([key[i]] if kind != REMOVED else []))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, start, size, order, rank, none in _texts(batches, FLUSH_BYTES):
            one, many = _distinct(order, rank, none)
            where = _parts(order, rank, ranges)[one]
            by = np.argsort(where, kind="stable")
            begin = 0
            for end in (np.flatnonzero(np.diff(where[by], append=-1)) + 1).tolist():
                i = one[by[begin:end]]
                blob = squeeze(order[i], rank[i], none[i].astype(np.uint8), many[by[begin:end]], size[i], bytes_at(data, start[i], size[i]))
                yield _batch([(TEXT, int(where[by[begin]]), 0, blob)])
                begin = end

    def part_of(batches: Iterator[pa.RecordBatch]) -> tuple[tuple[np.ndarray, ...], list[tuple[int, bytes]]]:
        """((data, start, size, order, text rank, no id, how many) of a part's documents, by order; (kind, blob) of its records)."""
        texts, records = [], []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if kind == TEXT:
                    texts.append(unsqueeze(blob))
                else:
                    records.append((kind, blob))
        order, rank, none, many, size, data = (np.concatenate(x) for x in zip(*texts, strict=True))
        return (data, np.cumsum(size) - size, size, order, rank, none, many), records

    def found_in(part: tuple[np.ndarray, ...], records: list[bytes]) -> tuple[np.ndarray, ...]:
        """Records of a part, with the document as its number there; equal documents that came from several tasks all get them."""
        _, _, _, order, rank, _, _ = part
        known: dict[tuple[int, int], list[int]] = {}
        for i, key in enumerate(zip(order.tolist(), rank.tolist(), strict=True)):
            known.setdefault(key, []).append(i)
        held = []
        for blob in records:
            o, r, doc, *rest = _unrecord(blob)
            there = [known[key] for key in zip(o.tolist(), r.tolist(), strict=True)]
            n = np.array([len(x) for x in there])
            flat = np.array([i for x in there for i in x])
            ahead = np.cumsum(n) - n
            held.append((flat[_spread(ahead[doc], n[doc])], *(np.repeat(x, n[doc]) for x in rest)))
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    hot_ranges = 1

    def second_round(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, records = part_of(batches)
        data, start, _, order, rank, none, _ = part
        one, _ = _distinct(order, rank, np.zeros(len(order), bool))
        back = np.full(len(order), -1)
        back[one] = np.arange(len(one))  # equal documents are asked for once
        order, rank = order[one], rank[one]
        for kind in (CONTESTED, HOT):
            if not (blobs := [b for k, b in records if k == kind]):
                continue
            doc, at, windows, key = found_in(part, blobs)
            first = back[doc] >= 0
            doc, at, windows, key = doc[first], at[first], windows[first].astype(np.int64), key[first]
            begin, doc = start[doc] + at, back[doc]
            if kind == CONTESTED:
                place = _range(key, ranges)
                by = np.lexsort((at, doc, place))
                ahead = 0
                for end in (np.flatnonzero(np.diff(place[by], append=-1)) + 1).tolist():
                    i = by[ahead:end]
                    body = bytes_at(data, begin[i], windows[i] + length - 1)
                    yield _batch([(CONTESTED, int(place[i[0]]), 0, struct.pack("<Q", len(x := _records(order, rank, doc[i], at[i], windows[i].astype(np.uint32)))) + x + squeeze(body))])
                    ahead = end
                continue
            for some in np.array_split(np.arange(len(doc)), max(1, -(-int(windows.sum()) // PIECE))):
                w = windows[some]
                flat = bytes_at(data, begin[some], w + length - 1)
                ranks = window_ranks(flat, _spread(np.cumsum(w + length - 1) - (w + length - 1), w), length, gram)
                d, a = np.repeat(doc[some], w), _spread(at[some], w)
                by, later, _ = settled(order[d], *ranks)
                gone, left = by[later], by[~later]
                ones = np.ones(len(d), np.int64)
                gd, ga, gw = _joined(d[gone], a[gone], ones[gone])
                yield from _dealt(REMOVED, _parts(order, rank, ranges)[gd], order, rank, gd, ga, gw)
                yield from _dealt(HOT, _range(ranks[0][left], hot_ranges), order, rank, d[left], a[left], ones[left], ranks[0][left], ranks[1][left])

    def sort_windows(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = group[0].as_py()
        if kind == REMOVED:
            yield from (b.select(["kind", "place", "windows", "blob"]) for b in batches)
            return
        if kind == HOT:
            order, rank, doc, at, _, *ranks = gathered(batches)
        else:
            held, bodies, n = [], [], 0
            for batch in batches:
                for blob in batch.column("blob").to_pylist():
                    (size,) = struct.unpack_from("<Q", blob)
                    o, r, d, *rest = _unrecord(blob[8 : 8 + size])
                    held.append((o, r, d + n, *rest))
                    bodies.append(unsqueeze(blob[8 + size :])[0])
                    n += len(o)
            order, rank, doc, at, windows = (np.concatenate(x) for x in zip(*held, strict=True))
            windows, body = windows.astype(np.int64), np.concatenate(bodies)
            whole = windows + length - 1
            ranks = window_ranks(body, _spread(np.cumsum(whole) - whole, windows), length, gram)
            doc, at = np.repeat(doc, windows), _spread(at, windows)
        by, later, _ = settled(order[doc], *ranks)
        gone = by[later]
        d, a, w = _joined(doc[gone], at[gone], np.ones(len(gone), np.int64))
        yield from _dealt(REMOVED, _parts(order, rank, ranges)[d], order, rank, d, a, w)

    def remove(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, records = part_of(batches)
        data, start, size, order, _, none, many = part
        cover = np.zeros(len(data) + 1, np.int32)
        if records:
            doc, at, windows = found_in(part, [b for _, b in records])
            np.add.at(cover, start[doc] + at, 1)
            np.add.at(cover, start[doc] + at + windows.astype(np.int64) + length - 1, -1)
        gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
        out, weight = [], 0
        for i in range(len(order)):
            mask = gone[start[i] : start[i] + size[i]]
            body = data[start[i] : start[i] + size[i]]
            edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
            spans = [{"start": int(a), "size": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
            row = (None if none[i] else int(order[i]), int(size[i]), int(mask.sum()), spans, body[~mask].tobytes())
            for _ in range(int(many[i])):
                out.append(row)
                weight += len(row[-1]) + 100
                if weight >= PIECE:
                    yield _results(out)
                    out, weight = [], 0
        if out:
            yield _results(out)

    refs = cut(own.mapInArrow(first_round, ROWS).groupBy("kind", "place").applyInArrow(sort_runs, ROWS))
    hot_ranges = max(1, math.ceil((refs.filter(F.col("kind") == HOT).agg(F.sum("windows").alias("n")).first().n or 0) / HOT_WINDOWS))
    open_ = refs.filter(F.col("kind").isin(CONTESTED, HOT))
    asked = own.mapInArrow(pack, ROWS).union(open_).groupBy("place").applyInArrow(second_round, ROWS)
    more = cut(asked.groupBy("kind", "place").applyInArrow(sort_windows, ROWS))
    ranges_gone = refs.filter(F.col("kind") == REMOVED).union(more)
    out = own.mapInArrow(pack, ROWS).union(ranges_gone).groupBy("place").applyInArrow(remove, "id long, n_bytes long, n_removed long, spans array<struct<start:long,size:long>>, kept binary")
    return out.select(F.col("id").cast(kind_of_id).alias(id_col), "n_bytes", "n_removed", "spans", "kept")


def _results(rows: list[tuple]) -> pa.RecordBatch:
    ids, sizes, gone, spans, kept = zip(*rows, strict=True)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
        ["id", "n_bytes", "n_removed", "spans", "kept"],
    )
