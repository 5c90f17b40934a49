"""BPE, packing and token files against the public libraries."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import bpe, chunks, id_files, packing, pfor

ODD = [" ", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "​", "　", "a", "Bc", "é", "1", "²", "!", "'", "'s", "'LL", "漢", "\U0001f642", "<|endoftext|>", "ͅ", "İ", "Σ", "\x00", "٣"]


def texts():
    rnd = random.Random(5)
    made = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    return [None, "", *made, "word " * 5000, "x" * 3000, *made[:20]]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, "mine") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (7, "again", None), (None, "no id", None)], "doc_id long, text string, n_tokens string").repartition(5)


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(5000)) and all(keys[h.owner[h.slot(k)]] == k for k in keys)


def test_bpe_equals_tiktoken(spark, table):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_documents(table, path, P.PATTERN).collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in table.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.decoded).decode()) for r in got) == want
    for r in got:
        ids = library.encode_ordinary(bytes(r.decoded).decode())
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(bytes(r.decoded)).hexdigest()
    assert bpe.encode_documents(table.limit(0), path, P.PATTERN).collect() == []


@pytest.mark.parametrize(("name", "pattern"), [("byte_bpe_50k.json", chunks.SPACED), ("word_bpe_49k.json", chunks.WORDS)])
def test_chunks_equal_whole_texts(name, pattern):
    every = [f"a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}b \n{chr(c)}" for c in range(0, 0x3000)] + [x or "" for x in texts()]
    library = Tokenizer.from_file(P.path(name))
    library.encode_special_tokens = True
    got = chunks.library_encoder(P.path(name), pattern)(pa.array(every))
    for t, ids, want in zip(every, got, library.encode_batch(every, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, ascii(t)


def test_memo_may_overflow():
    encoder = chunks.library_encoder(P.path("byte_bpe_50k.json"), chunks.SPACED)
    small = chunks.ChunkEncoder(chunks.SPACED, encoder.encode_chunks, most=3)
    own = pa.array([x or "" for x in texts()])
    assert list(small(own)) == list(encoder(own)) and list(small(own)) == list(encoder(own))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.integers(1, 300), st.integers(0, 100))
def test_segments_round_trip(ids, block, percent):
    ids = np.array(ids, dtype=np.uint32)
    segment = pfor.Segment(pfor.pack(ids, block, percent))
    assert segment.read().tolist() == ids.tolist()
    for k in range(segment.blocks):
        assert segment.read_block(k).tolist() == ids[k * block : (k + 1) * block].tolist()


def test_outliers_do_not_widen_a_block():
    ids = np.arange(512, dtype=np.uint32) % 16
    ids[7] = 2**31
    assert len(pfor.pack(ids)) < 512
    with pytest.raises(ValueError):
        pfor.Segment(pfor.pack(ids)[:-1])


def test_token_files(spark, table, tmp_path):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    out = id_files.save_ids(pfor.segments_of(table, path, end_id=2, segment=900), f"file://{tmp_path}/ids")
    got = sorted(id_files.load_ids(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(r.doc_id if r.doc_id is not None else -1 for r in table.collect())
    start, own = 0, defaultdict(list)
    for r in table.collect():
        own[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 2])
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids in own[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        start += r.n_tokens
    none = id_files.save_ids(pfor.segments_of(table.limit(0), path, end_id=2), f"{tmp_path}/none")
    assert id_files.load_ids(spark, none, with_ids=False).collect() == []
    # The files stand for themselves: without Spark, in the order of their names, they hold the same.
    files = sorted((tmp_path / "ids").glob("*.pfr"))
    alone, at = [], 0
    for f in files:
        docs, lengths, first, ids = id_files.load(f.read_bytes())
        ends = np.cumsum(lengths)
        alone += [(d, at + int(a), ids[a:b].tolist()) for d, a, b in zip(docs, ends - lengths, ends, strict=True)]
        at += len(ids)
    assert len(files) > 5 and alone == [(r.doc_id, r.start, r.ids) for r in got]


def test_packing(spark, table):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rows = packing.pack_documents(table, path, capacity=64).collect()
    whole = defaultdict(list)
    for r in table.collect():
        whole[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 0])
    assert sum(len(r.ids) for r in rows) == sum(len(x) for xs in whole.values() for x in xs)
    for r in rows:
        assert any(x[r.start : r.start + r.length] == r.ids for x in whole[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        assert r.piece * 64 == r.start
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 64) + 1
    assert packing.pack_documents(table.limit(0), path).collect() == []


def test_packed_sequences_can_be_rebuilt(spark, tmp_path):
    import corpus_pipeline
    from tallyloom.llm import entry

    texts = [f"document {i} " + "some words of it " * (i % 7 * 150) for i in range(30)] + [None]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    rows = corpus_pipeline.packing(spark, df, None).collect()
    own, sequences = defaultdict(list), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        own[r.doc_id] += r.ids
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert len(sequences[r.sequence_id]) == r.offset
        sequences[r.sequence_id] += r.ids
    for i, t in enumerate(texts):
        assert own[i] == [*library.encode(t or "", add_special_tokens=False).ids, 0]
    df.write.parquet(f"{tmp_path}/documents.parquet")
    query = entry.op3_packing(spark, str(tmp_path))
    assert query.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    want = {(r.doc_id, r.piece, zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())) for r in rows}
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in query.collect()} == want
    spoilt = corpus_pipeline.packing(spark, df.limit(1), None).withColumn("ids", F.array(F.lit(7)))
    assert packing.digest_ids(spoilt).first().ids_crc32 == zlib.crc32(np.array([7], dtype="<u4").tobytes())


def fewest(lengths, capacity):
    """Brute force: the least number of bins."""
    best = [len(lengths)]

    def put(rest, bins):
        if len(bins) >= best[0]:
            return
        if not rest:
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + rest[0] <= capacity and bins[i] not in bins[:i]:
                put(rest[1:], [*bins[:i], bins[i] + rest[0], *bins[i + 1 :]])
        put(rest[1:], [*bins, rest[0]])

    put(sorted(lengths, reverse=True), [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=10))
def test_plan_is_best_on_small_cases(lengths):
    histogram = {x: lengths.count(x) for x in set(lengths)}
    plan = packing.plan(histogram, 20)
    assert sorted(x for n, p in plan for x in p * n) == sorted(lengths) and all(sum(p) <= 20 for _, p in plan)
    assert sum(n for n, _ in plan) == fewest(lengths, 20)


def test_plan_does_not_grow_with_counts():
    rnd = random.Random(3)
    small = {x: rnd.randint(1, 5) for x in range(1, 200)}
    few, many = packing.plan(small, 256), packing.plan({x: n * 10**6 for x, n in small.items()}, 256)
    assert len(many) <= 400 and sum(n for n, _ in many) <= sum(n for n, _ in few) * 10**6


def test_fillings_are_undominated():
    counts = {5: 1, 4: 2, 3: 1}
    for filling in packing.fillings(counts, 9):
        left = 9 - sum(filling)
        assert left >= 0 and not any(x <= left and filling.count(x) < n for x, n in counts.items())
    assert packing.fillings({9: 1, 4: 2}, 9) == [(9,)]


def test_dominated_fillings_are_pruned():
    assert packing.fillings({6: 1, 3: 2}, 7) == [(6,)]  # one piece of 6 may stand for two of 3
    assert packing.dominated({3: 2}, {6: 1, 3: 2}, 7) and not packing.dominated({6: 1}, {6: 1, 3: 2}, 7)
    assert packing.dominated({4: 1}, {4: 1, 2: 1}, 6)  # there is room for another
    assert packing.dominated({4: 1, 3: 1}, {5: 1, 4: 1, 3: 1}, 8) and not packing.dominated({5: 1, 3: 1}, {5: 1, 4: 1, 3: 1}, 8)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8), st.integers(1, 16))
def test_some_filling_is_undominated_and_all_fit(lengths, room):
    counts = {x: lengths.count(x) for x in set(lengths)}
    for filling in (found := packing.fillings(counts, room)):
        assert sum(filling) <= room and all(filling.count(x) <= counts[x] for x in filling)
        assert len(found) == 1 or not packing.dominated({x: filling.count(x) for x in filling}, counts, room)
    best = max((sum(x for i, x in enumerate(lengths) if bits >> i & 1) for bits in range(1 << len(lengths))), key=lambda s: s if s <= room else -1)
    assert sum(found[0]) == best


def plain_best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        own = min((b for b in bins if b[0] >= x), key=lambda b: b[0], default=None)
        if own is None:
            bins.append(own := [capacity])
        own[0] -= x
        own.append(x)
    return sorted(sum(b[1:]) for b in bins)  # of two with equal room, either may be taken, which changes no sum


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40))
def test_best_fit_by_groups_is_best_fit(lengths):
    groups = packing.best_fit({x: lengths.count(x) for x in set(lengths)}, 30)
    assert sorted(x for n, p in groups for x in p * n) == sorted(lengths)
    assert sorted(sum(p) for n, p in groups for _ in range(n)) == plain_best_fit(lengths, 30)


@pytest.mark.parametrize("histogram", [{1: 5000}, {1: 5000, 2048: 3}, {2: 5000, 1: 3000}, {1: 10**9, 512: 10**8, 3: 1}])
def test_plan_of_very_many_short_pieces(histogram):
    plan = packing.plan(histogram)
    total = sum(x * n for x, n in histogram.items())
    assert sum(n * sum(p) for n, p in plan) == total and sum(n for n, _ in plan) == -(-total // 2048)


def test_many_empty_documents(spark):
    df = spark.range(10_000).select(F.col("id").alias("length"), F.when(F.col("id") % 2 == 0, "").alias("text"))
    rows = packing.pack_documents(df, P.path("word_bpe_49k.json"), id_col="length").collect()
    assert list(rows[0].asDict()) == ["length", "piece", "start", "_length", "ids_crc32", "ids", "sequence_id", "offset"]
    assert sorted(r.length for r in rows) == list(range(10_000)) and all(r.ids == [0] for r in rows)
    assert len({r.sequence_id for r in rows}) == -(-10_000 // 2048)


def test_memo_keeps_to_its_bound():
    encoder = chunks.library_encoder(P.path("byte_bpe_50k.json"), chunks.SPACED, most=20_000)
    for k in range(5):
        list(encoder(pa.array([" ".join(f"w{i}" for i in range(1000 * k, 1000 * k + 50)), "a b  c"])))
        assert 0 < encoder.held <= 20_000 and encoder.held == sum(chunks.ENTRY + len(x) + len(y) for x, y in encoder.memo.items())
