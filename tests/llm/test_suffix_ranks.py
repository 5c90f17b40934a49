"""Substring dedup: against all strings of all documents, and odd tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import entry, suffix_ranks
from tallyloom.llm.suffix_ranks import _records, _unrecord, grams, least, remove_repeats, squeeze, unsqueeze

SCHEMA = "doc_id long, text string"


def plain(rows, length):
    """(id, n_bytes, spans, kept) of every row, from the least id of every string."""
    order = lambda i: (i is None, i or 0)
    data = [(order(i), i, (t or "").encode()) for i, t in rows]
    first = {}
    for o, _, b in data:
        for at in range(len(b) - length + 1):
            s = b[at : at + length]
            first[s] = min(first.get(s, o), o)
    out = []
    for o, i, b in data:
        gone = bytearray(len(b))
        for at in range(len(b) - length + 1):
            if first[b[at : at + length]] < o:
                gone[at : at + length] = b"\1" * length
        edges = [k for k in range(len(b) + 1) if (k < len(b) and gone[k]) != (k > 0 and gone[k - 1])]
        spans = tuple((a, b - a) for a, b in zip(edges[::2], edges[1::2], strict=True))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def found(df, **how):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, tuple((s.start, s.size) for s in r.spans), bytes(r.kept)) for r in remove_repeats(df, **how).collect()), key=str)


def rows_of(draw, n, letters, longest):
    passages = ["".join(draw.choice(letters) for _ in range(draw.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = "".join(draw.choice([draw.choice(passages), "".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))]) for _ in range(draw.randint(0, longest)))
        rows.append((draw.choice([i, i, i, draw.randrange(n), None]), draw.choice([text, text, text, text, None])))
    return rows + draw.sample(rows, n // 4) + [(3 * n + k, rows[5][1]) for k in range(n // 3)]


@pytest.mark.parametrize(("length", "gram", "letters"), [(12, 5, "abc é"), (9, 3, "ab"), (50, 20, "abcdefgh ü."), (6, 6, "xy"), (20, 8, "a")])
def test_against_all_strings(spark, length, gram, letters):
    rows = rows_of(random.Random(length), 60, letters, 6)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"kind": F.lit("own"), "place": F.lit(1), "blob": F.lit(None).cast("binary")}).repartition(7)
    assert found(df, length=length, gram=gram) == plain(rows, length)


def test_hot_ranks_small_ranges_and_cut_texts(spark, monkeypatch):
    """Every path at once: many ranges and flushes, texts cut into pieces, ranks hot from two runs on."""
    rows = rows_of(random.Random(2), 80, "abcd ", 8)
    want = plain(rows, 12)
    for name, value in (("RANGE_BYTES", 500), ("FLUSH_BYTES", 700), ("PIECE", 64), ("HOT_RUNS", 1), ("HOT_WINDOWS", 50)):
        monkeypatch.setattr(suffix_ranks, name, value)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5), length=12, gram=5) == want


def test_empty_and_short(spark):
    none = remove_repeats(spark.createDataFrame([], SCHEMA))
    assert none.columns == ["doc_id", "n_bytes", "n_removed", "spans", "kept"] and none.count() == 0
    short = spark.createDataFrame([(1, "x" * 49), (2, "x" * 49), (3, None), (4, "")], SCHEMA)
    assert [(r.doc_id, r.n_bytes, r.n_removed) for r in remove_repeats(short).orderBy("doc_id").collect()] == [(1, 49, 0), (2, 49, 0), (3, 0, 0), (4, 0, 0)]


def test_parts():
    data = np.frombuffer(bytes(range(60)) * 3, np.uint8)
    for k in (1, 3, 8, 13, 20):
        for ranks in (grams(data, k), grams(data, k, 1)):
            assert len(ranks) == 181 - k and all((ranks[i] == ranks[j]) == (data[i : i + k].tobytes() == data[j : j + k].tobytes()) for i in range(0, 70) for j in range(0, 120, 7))
    x = np.random.default_rng(1).integers(0, 99, 50)
    assert all(least(x, w).tolist() == [min(x[i : i + w]) for i in range(51 - w)] for w in (1, 2, 5, 31, 50))
    columns = [np.arange(5, dtype=np.uint64), np.empty(0, np.int64), np.array([1, 2], np.uint8)]
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(columns, unsqueeze(squeeze(*columns)), strict=True))
    order, text = np.array([-5, 7, 9, 2**63 - 1]), np.arange(4, dtype=np.uint64)
    doc, at = np.array([0, 0, 2, 2, 3]), np.array([3, 90, 0, 0, 5])
    o, t, d, a = _unrecord(_records(order, text, doc, at))
    assert (o[d] == order[doc]).all() and (t[d] == text[doc]).all() and (a == at).all()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in entry.queries()["op13_suffix_array"](spark, sf).collect()), key=str)
    assert got == sorted(((i, n, m, len(s), hashlib.sha256(k).hexdigest()) for i, n, m, s, k in plain(rows, 50)), key=str) and any(r[2] for r in got)
