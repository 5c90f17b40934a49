"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is a vocabulary entry as a whole is resolved by one probe of a minimal perfect hash. The others are
merged bottom up: their bytes form a linked list, and a heap holds the adjacent pairs whose union is in the
vocabulary, by rank and then place.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .chunks import SPACED, ChunkEncoder, packed
from .shared import enter, memo, small_batches

BUCKET = 4
TRIES = 512
# Odd 64-bit multipliers: any would do.
SPREAD, MIX, MASK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1
_loaded: dict = {}
memo("bpe", _loaded.clear)


class PerfectHash:
    """Minimal perfect hash of distinct byte strings by hash and displace: n keys in n slots, one probe each.

    Keys fall into buckets by one part of a 64-bit hash; from the largest bucket down, a displacement is sought that
    sends the bucket's keys to free slots. Buckets of one key name their slot (as -1 - slot).
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // BUCKET)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) < n:
            raise ValueError("the keys are not distinct")
        by: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            by[h % self.buckets].append(i)
        shift, taken, owner = [0] * self.buckets, np.zeros(n, dtype=bool), [0] * n
        order = sorted(range(self.buckets), key=lambda b: -len(by[b]))
        free = None
        for b in order:
            own = by[b]
            if not own:
                break
            if len(own) == 1:
                free = free or iter([s for s in range(n) if not taken[s]])
                slot = next(free)
                shift[b], owner[slot] = -1 - slot, own[0]
                continue
            own_hashes = np.array([hashes[i] for i in own], dtype=np.uint64)
            for at in range(0, 50 * n, TRIES):
                d = np.arange(at, at + TRIES, dtype=np.uint64)[:, None]
                slots = ((own_hashes ^ d * np.uint64(SPREAD)) * np.uint64(MIX) >> np.uint64(32)) % np.uint64(n)
                good = ~taken[slots].any(axis=1)
                if len(own) > 1:
                    ordered = np.sort(slots, axis=1)
                    good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    break
            else:
                raise ValueError("no displacement found")
            k = int(good.argmax())
            d, slots = at + k, slots[k].tolist()
            shift[b] = d
            for i, s in zip(own, slots, strict=True):
                taken[s], owner[s] = 1, i
        self.shift, self.owner = shift, owner

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return -1 - d if d < 0 else (((h ^ d * SPREAD & MASK) * MIX & MASK) >> 32) % self.n


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        keys, self.ranks = list(ranks), ranks
        self.hash = PerfectHash(keys)
        self.keys = [keys[i] for i in self.hash.owner]
        self.ids = [ranks[k] for k in self.keys]
        self.split = regex.compile(pattern).findall
        self.token = dict(zip(self.ids, self.keys, strict=True))

    def rank(self, piece: bytes) -> int | None:
        """The id of piece, or None if it isn't in the vocabulary."""
        slot = self.hash.slot(piece)
        return self.ids[slot] if self.keys[slot] == piece else None

    def merge(self, piece: bytes) -> list[int]:
        """Merges the adjacent pair of least rank, leftmost first, until no pair is in the vocabulary."""
        n, rank, push, pop = len(piece), self.ranks.get, heapq.heappush, heapq.heappop
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it has been merged into the one before
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = pop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of its sides has been merged since
            end[i], end[j], before[stop] = stop, 0, i
            if stop < n and (r := rank(piece[i : end[stop]])) is not None:
                push(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := rank(piece[h:stop])) is not None:
                push(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i : end[i]]))
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        out = []
        for piece in self.split(text):
            data = piece.encode()
            if (found := self.rank(data)) is not None:
                out.append(found)
            else:
                out += self.merge(data)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def load(path: str, pattern: str) -> tuple[ByteBPE, ChunkEncoder]:
    """One for each process: the vocabulary is read and hashed once, and its memo outlives a task."""
    enter("bpe")
    if (path, pattern) not in _loaded:
        with open(path, "rb") as f:
            bpe = ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)
        _loaded[path, pattern] = bpe, ChunkEncoder(SPACED, lambda chunks: (packed(bpe.encode(x)) for x in chunks))
    return _loaded[path, pattern]


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per row of docs: id, ids array<int>, decoded (binary), n_tokens, ids_sha256, decoded_sha256.

    path: a vocabulary in the tiktoken form, pattern: its pre-token pattern; every match is encoded by itself, without special
    tokens. decoded comes from ids alone and is the text in UTF-8. A null text is empty and has no ids; repeated rows each
    give their row; other columns are not read. with_ids=False leaves ids and decoded out. A map without a shuffle.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"`{id_col}` {kind}, " + "ids array<int>, decoded binary, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = load(path, pattern)
        decimal = [str(i) for i in range(max(bpe.token) + 1)]
        for batch in batches:
            out = {x: [] for x in ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")}
            for coded in encoder(batch.column("text")):
                ids = np.frombuffer(coded, dtype="<u4").tolist()
                decoded = bpe.decode(ids)
                if with_ids:
                    out["ids"].append(ids)
                    out["decoded"].append(decoded)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            columns = [batch.column("id")] + ([pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["decoded"], pa.binary())] if with_ids else [])
            columns += [pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, *["ids", "decoded"] * with_ids, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, fields)
