"""Quality classifier with hierarchical empirical Bayes over sites.

A document's own evidence comes from a ridge logistic model over the presence of hashed words and of a few shape features:
those FEATURES whose shares in the two classes differ most, by Z_LEAST standard errors or more. Every document's probability then feeds grouped sums by host and by path within host. A host's rate is
shrunk toward the global one and a path's toward its host's, the more so the fewer documents it has and the less
sites differ at that level. A document's posterior log odds are its site's log odds plus its own evidence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard, enter, memo, small_batches, without

SAMPLE = 20_000
BITS = 18
Z_LEAST = 4.0
ALPHA = 0.5
FEATURES = 400
RIDGE = 0.3
TARGETS = ("quality", "toxic")
MEMO = 300_000
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_PUNCT = bytes(i for i in range(33, 127) if not chr(i).isalnum())
_SPACED = bytes(32 if i in _PUNCT else i for i in range(256))


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word) >> (64 - BITS)
        return found


_buckets = _Buckets()
memo("quality", _buckets.clear)


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of a text's words (punctuation aside, without case) and of its shape."""
    text = text or ""
    raw = text.encode()
    words = text.lower().encode().translate(_SPACED).split()
    distinct = set(words)
    n, size = len(words), max(1, len(raw))
    share = round(10 * len(distinct) / n) if n else -1
    shape = (
        ("distinct", share),
        ("distinct of words", f"{share} {n.bit_length()}"),
        ("again", round(20 * sum(map(bytes.__eq__, words, words[1:])) / n) if n else -1),
        ("upper", round(20 * (len(raw) - len(raw.translate(None, _UPPER))) / size)),
        ("digit", round(20 * (len(raw) - len(raw.translate(None, _DIGIT))) / size)),
        ("punct", round(20 * (len(raw) - len(raw.translate(None, _PUNCT))) / size)),
        ("words", n.bit_length()),
        ("length", round(size / n) if n and size < 40 * n else 40),
    )
    distinct.update(f"\0{a}{b}".encode() for a, b in shape)
    return np.unique(np.fromiter(map(_buckets.__getitem__, distinct), dtype=np.int64, count=len(distinct)))


@dataclass(frozen=True)
class Model:
    """weights: for each target, log odds per bucket; offset: log odds of no features; base: log odds of the label."""

    weights: np.ndarray
    offset: tuple[float, ...]
    base: tuple[float, ...]

    def evidence(self, text: str | None) -> np.ndarray:
        """Log likelihood ratio of each target, given the text alone."""
        return self.weights[:, features(text)].sum(axis=1) + np.array(self.offset) - np.array(self.base)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of a ridge logistic fit by Newton's method; the last one, which belongs to a column of ones, isn't penalised."""
    x = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None].astype(x.dtype)).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, x.T @ (p - y) + pull * w)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled rows, those of the least id hashes.

    A document with several labels counts as good only if all say so, and as toxic if any does. Null labels are left out; with
    no label of either class, a target has no evidence and its base comes from what was seen, with ALPHA added to each class.
    """
    chosen = (
        labels.filter(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
        .withColumn("h", F.xxhash64("id"))
        .orderBy("h", "id")
        .limit(sample)
    )
    rows = cut(
        docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        .join(F.broadcast(chosen), "id")  # at most `sample` rows of three numbers
        .select(*TARGETS, "text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        total = np.zeros((4, 1 << BITS), dtype=np.int64)
        for batch in batches:
            for text, *label in zip(*(batch.column(c).to_pylist() for c in ("text", *TARGETS)), strict=True):
                own = features(text)
                for k, x in enumerate(label):
                    if x is not None:
                        total[2 * k + (x > 0), own] += 1
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[k, some]) for k in range(4))], ["bucket", "q0", "q1", "t0", "t1"])

    counts = np.zeros((4, 1 << BITS))
    counted = rows.mapInArrow(count, "bucket long, q0 long, q1 long, t0 long, t1 long")
    for r in counted.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("q0", "q1", "t0", "t1"))).collect():  # 2**BITS rows at most
        counts[:, r.bucket] = r.q0, r.q1, r.t0, r.t1
    n = np.array(rows.agg(*(F.count_if(F.col(t) == v).alias(f"{t}{v}") for t in TARGETS for v in (0, 1))).first(), dtype=float)
    told = []
    for k in range(2):
        (c0, c1), (n0, n1) = counts[2 * k : 2 * k + 2], np.maximum(n[2 * k : 2 * k + 2], 1)
        pooled = (c0 + c1) / (n0 + n1)
        z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n0 + 1 / n1))
        z[c0 + c1 == 0] = 0
        best = np.argsort(-z, kind="stable")[:FEATURES]
        told.append(np.sort(best[z[best] >= Z_LEAST]))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        for batch in batches:
            own = [features(x) for x in batch.column("text").to_pylist()]
            held = [pa.array([np.packbits(np.isin(t, x, assume_unique=True)).tobytes() for x in own], pa.binary()) for t in told]
            yield pa.RecordBatch.from_arrays([*(batch.column(t) for t in TARGETS), *held], [*TARGETS, "f0", "f1"])

    matrix = rows.mapInArrow(hold, "quality int, toxic int, f0 binary, f1 binary").collect()  # `sample` rows at most
    discard(rows)
    weights, offset, base = np.zeros((2, 1 << BITS), dtype=np.float32), [], []
    for k, t in enumerate(TARGETS):
        base.append(math.log((n[2 * k + 1] + ALPHA) / (n[2 * k] + ALPHA)))
        known = [r for r in matrix if r[t] is not None]
        bits = np.frombuffer(b"".join(bytes(r[2 + k]) for r in known), np.uint8).reshape(len(known), -(-len(told[k]) // 8))
        x, y = np.unpackbits(bits, axis=1, count=len(told[k])).astype(np.float32), np.array([r[t] > 0 for r in known], dtype=float)
        w = logistic(x, y) if 0 < y.sum() < len(y) else np.append(np.zeros(len(told[k])), base[k])
        weights[k, told[k]] = w[:-1]
        offset.append(float(w[-1]))
    return Model(weights, tuple(offset), tuple(base))


def _probability(log_odds):
    return 1 / (1 + F.exp(-log_odds))


def _log_odds(p):
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def shrink(groups: DataFrame, total: str, parent: str, out: str) -> DataFrame:
    """groups with out: (total + strength * parent) / (n + strength), a group's rate pulled toward parent.

    strength is the empirical Bayes estimate m (1 - m) / t - 1, where m is the overall rate and t the variance between groups:
    the spread of their rates about their parents less what chance alone gives them. Without such variance only the parent counts.
    """
    x = F.col(total) / F.col("n")
    chance = F.col(parent) * (1 - F.col(parent))
    moments = groups.agg(
        F.sum(total).alias("s"),
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.sum(F.col("n") * (x - F.col(parent)) * (x - F.col(parent))).alias("spread"),
        F.sum(chance).alias("chance"),
    ).select(
        (F.col("s") / F.col("n")).alias("m"), F.greatest(F.lit(0.0), (F.col("spread") - F.col("chance")) / F.col("n")).alias("t")
    ).first()
    m, t = moments.m or 0.0, moments.t or 0.0
    if t <= 1e-12:
        return groups.withColumn(out, F.col(parent))
    strength = max(1.0, m * (1 - m) / t - 1)
    return groups.withColumn(out, (F.col(total) + strength * F.col(parent)) / (F.col("n") + strength))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    least_quality: float = 0.5,
    most_toxic: float = 0.25,
    sample: int = SAMPLE,
) -> DataFrame:
    """One row per row of docs: id, p_quality, p_toxic (posterior probabilities), kept.

    kept: p_quality >= least_quality and p_toxic < most_toxic. Only (id, quality, toxic) of labels is read. A null text counts as
    empty, a null host or path as a site of its own; repeated rows each count and get the same result. Without labels nothing is known: both
    probabilities are 0.5 and, with that chance of being toxic, nothing is kept. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col, sample))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        for batch in batches:
            found = np.array([model.value.evidence(x) for x in batch.column("text").to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "host", "path")] + [pa.array(found[:, k].astype(float)) for k in range(2)], ["id", "host", "path", "e0", "e1"]
            )

    part = lambda c, o: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")).alias(o)
    scored = cut(
        docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), part(host_col, "host"), part(path_col, "path"))
        .mapInArrow(run, f"id {kind}, host string, path string, e0 double, e1 double")
    )
    base = model.value.base
    sums = [F.sum(_probability(F.col(f"e{k}") + F.lit(base[k]))).alias(f"s{k}") for k in range(2)]
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *sums))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))
    overall = paths.agg(F.sum("n").alias("n"), F.sum("s0").alias("s0"), F.sum("s1").alias("s1")).first()
    for k in range(2):
        rate = overall[f"s{k}"] / overall.n if overall.n else 0.5
        hosts = shrink(hosts.withColumn("g", F.lit(rate)), f"s{k}", "g", f"h{k}").drop("g")
    sites = paths.join(hosts.select("host", "h0", "h1"), "host")
    for k in range(2):
        sites = shrink(sites, f"s{k}", f"h{k}", f"p{k}")
    sites = sites.select("host", "path", *(_log_odds(F.col(f"p{k}")).alias(f"o{k}") for k in range(2)))
    out = scored.join(sites, ["host", "path"]).select(
        F.col("id").alias(id_col),
        _probability(F.col("e0") + F.col("o0")).alias("p_quality"),
        _probability(F.col("e1") + F.col("o1")).alias("p_toxic"),
    )
    return out.withColumn("kept", (F.col("p_quality") >= least_quality) & (F.col("p_toxic") < most_toxic))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """docs without what classify() rejects; where several rows share an id, one rejected row takes them all along."""
    return without(docs, id_col, classify(docs, labels, id_col, **more).filter("not kept").select(id_col))
