"""N-gram join, embedding near-dedup, components and the quality classifier against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import ngram_join, quality
from tallyloom.llm.near_vectors import near_groups
from tallyloom.llm.ngram_join import drop_near_copies, jaccard_groups, search_block
from tallyloom.llm.shared import connected_components, cut, may_hold, without


def components(nodes, links):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {n: find(n) for n in nodes}


def sets_of(texts, words):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def groups_of(texts, words, percent):
    own = sets_of(texts, words)
    links = [(i, j) for i in range(len(own)) for j in range(i) if own[i] and own[j] and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j])]
    return own, components(range(len(own)), links)


def family(rnd, words, n, edits):
    """A text and n copies with some words changed."""
    base = [rnd.choice(words) for _ in range(120)]
    yield " ".join(base)
    for _ in range(n):
        own = list(base)
        for _ in range(rnd.randint(0, edits)):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        yield " ".join(own)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t", "A b", "a  B", "one", "one two three", "one two three four", "x" * 40_000]
    for k in range(12):
        texts += family(rnd, words, 6, 4 + k)
    texts += family(rnd, words, 90, 9)  # lists longer than LIST
    passage = " ".join(rnd.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 90))) for _ in range(60)]
    texts += texts[20:40] * 3
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize(("words", "percent", "block"), [(4, 85, 512), (5, 80, 16), (2, 50, 16)])
def test_groups_against_brute_force(spark, corpus, words, percent, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    df = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string").withColumn("n_shingles", F.lit("mine"))
    got = {r.doc_id: r for r in jaccard_groups(df.repartition(6), words=words, percent=percent).collect()}
    own, want = groups_of(corpus, words, percent)
    assert len(set(want.values())) < len(corpus)
    for i in range(len(corpus)):
        assert (got[i].n_shingles, got[i].component_id) == (len(own[i]), want[i]), i


@pytest.mark.parametrize("least", [40, 1_000_000])
def test_waves_lose_no_link(spark, corpus, least, monkeypatch):
    waves, plain = [], ngram_join._in_waves
    monkeypatch.setattr(ngram_join, "_in_waves", lambda rows, by, n, *rest: waves.append(n) or plain(rows, by, n, *rest))
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "WAVE_LEAST", least)
    monkeypatch.setattr(ngram_join, "WAVE_SHARE", 1000)
    df = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_groups(df.repartition(3), words=2, percent=50).collect()}
    assert got == groups_of(corpus, 2, 50)[1]
    assert (max(waves) > 1) == (least == 40)


def test_sets_of_texts_that_share_nothing_are_not_written(spark, monkeypatch):
    written, plain = {}, ngram_join.cut

    def cut(df):
        out = plain(df)
        written.setdefault("set" in out.columns, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "cut", cut)
    texts = [" ".join(f"{i}w{k}" for k in range(50)) for i in range(40)] + ["a b c d e f g h"] * 2
    rows = jaccard_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.component_id for r in rows} == set(range(41))
    assert max(written[False]) >= 42 and written[True] == [0]


def test_what_is_cut_leaves_no_shuffle_files(spark):
    left = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses
    before = left().size()
    cut(spark.range(1000).repartition(7, "id"))
    assert left().size() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_one_of_each_group_stays(spark, corpus):
    df = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    kept = {r.doc_id for r in drop_near_copies(df).collect()}
    assert kept == set(groups_of(corpus, 5, 80)[1].values())


def test_groups_without_ids_repeated_ids_and_no_rows(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(None, t), (9, t), (9, t), (None, "z z z z z z"), (3, None)], "doc_id long, text string")
    rows = jaccard_groups(df).collect()
    assert sorted((r.n_shingles, r.component_id or -1) for r in rows) == [(0, 3), (1, -1), (4, 9), (4, 9), (4, 9)]
    assert jaccard_groups(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        jaccard_groups(df, words=0)


def test_search_block_reports_what_connects():
    rnd = random.Random(2)
    sets = [np.unique(np.array([rnd.randrange(60) for _ in range(40)], dtype=np.uint64)) for _ in range(40)]
    sets += [np.unique(np.append(s[:-1], np.uint64(1000 + i))) for i, s in enumerate(sets)]
    nodes = np.arange(len(sets))
    own = [set(s.tolist()) for s in sets]
    linked = lambda i, j: 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j])
    for first in (np.ones(len(sets), bool), np.arange(len(sets)) < 40):
        within = bool(first.all())
        found = search_block(nodes, sets, first, within, 80)
        assert all(linked(a, b) for a, b in found) and len(found) < len(sets)
        all_links = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and first[i] and (within or not first[j]) and linked(i, j)]
        assert components(nodes.tolist(), found) == components(nodes.tolist(), all_links)


def test_heap_merge_finds_what_occurs_often_enough():
    rnd = random.Random(7)
    for _ in range(200):
        runs = [sorted(rnd.sample(range(30), rnd.randint(0, 20))) for _ in range(rnd.randint(1, 9))]
        for need in (1, 2, 3, 5):
            times = Counter(x for run in runs for x in run)
            assert ngram_join.often_enough(runs, need) == sorted(x for x, n in times.items() if n >= need)


def test_search_block_passes_over_what_is_connected_already():
    sets = [np.arange(k, 40 + k, dtype=np.uint64) for k in range(6)]
    nodes, every = np.arange(6), np.ones(6, bool)
    assert search_block(nodes, sets, every, True, 80, np.zeros(6, dtype=np.int64)) == []
    two = search_block(nodes, sets, every, True, 80, np.array([0, 0, 0, 3, 3, 3]))
    assert len(two) == 1 and two[0][0] < 3 <= two[0][1]


def test_families_of_many_blocks(spark, monkeypatch):
    """Two large groups and many lone sets that one passage ties to them; sizes of several bands."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rnd = random.Random(12)
    words = [f"v{i}" for i in range(500)]
    passage = " ".join(rnd.choice(words) for _ in range(40))
    texts = [passage + " " + t for k in (0, 1) for t in family(rnd, words, 60, 5)]
    texts += [passage + " " + " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    texts += [passage + " " + " ".join(rnd.choice(words) for _ in range(rnd.randint(40, 400))) for _ in range(40)]
    rnd.shuffle(texts)
    got = {r.doc_id: r.component_id for r in jaccard_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert got == groups_of(texts, 5, 80)[1]


def test_components_of_chains_stars_and_rings(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 30) for i in range(30)]
    edges += [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)]
    rnd.shuffle(edges)
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    want = components(sorted(nodes), [e for e in edges if e[0] != e[1]])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + [(5, 5)], "a long, b long").repartition(5)).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_bitmap_never_loses_a_key(spark):
    keys = spark.range(0, 1000, 7).toDF("k")
    df = spark.range(5000).toDF("k").withColumn("__may_go", F.lit(1))
    held = {r.k for r in df.filter(may_hold(keys, "k")(F.col("k"))).collect()}
    assert held >= set(range(0, 1000, 7)) and len(held) < 1200
    assert {r.k for r in without(df, "k", keys).collect()} == set(range(5000)) - set(range(0, 1000, 7))


def vectors():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 16))
    rows = [*base, *(base[:20] + rng.normal(scale=0.12, size=(20, 16))), *(base[0] + rng.normal(scale=0.1, size=(50, 16))), *(base[5:8] * 3), *base[10:12], *base[10:12]]
    rows = [[float(x) for x in v] for v in rows]
    return rows + [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors_against_brute_force(spark, block, monkeypatch):
    from tallyloom.llm import near_vectors

    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, kept int")
    got = {r.vec_id: r for r in near_groups(df.repartition(4), shared=1).collect()}
    sound = [i for i, v in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    cosine = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    links = [(i, j) for i in sound for j in sound if i != j and len(rows[i]) == len(rows[j]) and cosine(rows[i], rows[j]) >= 0.95]
    want, count = components(range(len(rows)), links), defaultdict(int)
    for i, _ in links:
        count[i] += 1
    found = sum(r.n_links for r in got.values())
    assert 0.97 * len(links) <= found <= len(links)
    for i in range(len(rows)):
        assert got[i].n_links <= count[i] and got[i].kept == (got[i].component_id == i)
    assert sum(got[i].component_id != want[i] for i in range(len(rows))) <= 1


def test_vectors_of_a_dense_group_keep_their_links(spark):
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    group = unit(np.sqrt(0.97) * unit(rng.normal(size=(1, 64))) + np.sqrt(0.03) * unit(rng.normal(size=(1500, 64))))
    x = np.vstack([group, unit(rng.normal(size=(1500, 64)))])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in near_groups(df.repartition(4)).collect()}
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    assert [got[i].n_links for i in range(len(x))] == linked.sum(axis=1).tolist()
    assert {got[i].component_id for i in range(1500)} == {0}


def test_recall_of_groups_of_many_sizes_as_found(spark):
    """near_groups() itself, as it is by default, against every pair."""
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    sizes = [300, *[40] * 6, *[5] * 40, *[2] * 100]
    parts = [unit(np.sqrt(c) * unit(rng.normal(size=(1, 32))) + np.sqrt(1 - c) * unit(rng.normal(size=(n, 32)))) for n, c in zip(sizes, rng.uniform(0.94, 0.99, len(sizes)), strict=True)]
    x = np.vstack([*parts, unit(rng.normal(size=(1500, 32)))])
    got = {r.vec_id: r for r in near_groups(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)).collect()}
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    true = linked.sum(axis=1)
    assert all(got[i].n_links <= true[i] for i in range(len(x))) and sum(r.n_links for r in got.values()) >= 0.9 * true.sum() > 1000


def test_recall_of_the_index_with_its_own_parameters():
    """50,000 vectors, half of them in groups of 2 to 5,000; a group's links against what the index lets be compared."""
    from tallyloom.llm import near_vectors as nv

    rng = np.random.default_rng(21)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    sizes = [5000, 4000, *[500] * 10, *[50] * 100, *[5] * 800, *[2] * 1000]
    parts = [unit(np.sqrt(c) * unit(rng.normal(size=(1, 64))) + np.sqrt(1 - c) * unit(rng.normal(size=(n, 64)))) for n, c in zip(sizes, rng.uniform(0.94, 0.99, len(sizes)), strict=True)]
    x = np.vstack([*parts, unit(rng.normal(size=(50_000 - sum(sizes), 64)))])
    sample = x[rng.permutation(len(x))[: nv.pivots_for(len(x))]]
    named = nv.nearest(x, nv.spaced(sample, nv.THRESHOLD), nv.PREFIX)
    settled, links, found = named[:, -1] == nv.NONE, 0, 0
    for at, n in zip(np.cumsum([0, *sizes]), sizes, strict=False):
        own, names = x[at : at + n], named[at : at + n]
        for lo in range(0, n, 250):
            i, j = np.nonzero(own[lo : lo + 250] @ own.T >= nv.THRESHOLD)
            i, j = (i + lo)[i + lo < j], j[i + lo < j]
            links += len(i)
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                both = ((names[a][:, :, None] == names[b][:, None, :]) & (names[a] != nv.NONE)[:, :, None]).any(axis=2).sum(axis=1)
                found += int(((both >= nv.SHARED) | ((both >= 1) & (settled[at + a] | settled[at + b]))).sum())
    assert links > 1_000_000 and found >= 0.9 * links


def test_vectors_without_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.01]), (None, None)], "vec_id long, embedding array<float>")
    rows = near_groups(df).collect()
    assert sorted((r.n_links, r.component_id or -1, r.kept) for r in rows) == [(0, -1, False), (2, 4, False), (2, 4, True), (2, 4, True)]
    assert near_groups(df.limit(0)).collect() == []


LABELS = "doc_id long, quality int, toxic int"


def test_classifier_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter("doc_id % 2 = 0")
    held = quality.classify(docs, seen).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    r = held.select(
        F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("kept").cast("int"))).alias("clean"),
        F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("poor"),
        F.avg(F.when(F.col("toxic") == 1, F.col("kept").cast("int"))).alias("toxic"),
    ).first()
    assert r.clean > 0.98 and r.poor < 0.1 and r.toxic < 0.2


def test_posteriors_against_a_plain_version(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["good", "fine", "well"] if i % 3 else ["bad", "worse"]) for _ in range(8)) for i in range(300)]
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 5}", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)], LABELS)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    model = quality.fit(docs, labels)
    e = [model.evidence(t)[0] for t in texts]
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    p = [sigmoid(x + model.base[0]) for x in e]

    def shrunk(groups, parent):
        n = sum(len(v) for v in groups.values())
        m = sum(sum(v) for v in groups.values()) / n
        spread = sum(len(v) * (sum(v) / len(v) - parent[k]) ** 2 for k, v in groups.items())
        t = max(0.0, (spread - sum(parent[k] * (1 - parent[k]) for k in groups)) / n)
        if t <= 1e-12:
            return dict(parent)
        strength = max(1.0, m * (1 - m) / t - 1)
        return {k: (sum(v) + strength * parent[k]) / (len(v) + strength) for k, v in groups.items()}

    hosts, paths = defaultdict(list), defaultdict(list)
    for (_, _, lang, source, _), x in zip(rows, p, strict=True):
        hosts[source].append(x)
        paths[source, lang].append(x)
    overall = sum(p) / len(p)
    host = shrunk(hosts, dict.fromkeys(hosts, overall))
    path = shrunk(paths, {k: host[k[0]] for k in paths})
    for (i, _, lang, source, _), x in zip(rows, e, strict=True):
        rate = path[source, lang]
        assert got[i].p_quality == pytest.approx(sigmoid(x + math.log(rate / (1 - rate))), abs=1e-6)
        assert got[i].kept == (i % 3 > 0)


def test_classifier_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, "", None, "s", 0), (None, "x" * 30_000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], LABELS)
    rows = quality.classify(docs, none).collect()
    assert len(rows) == 3 and all(r.p_quality == pytest.approx(0.5) and not r.kept for r in rows)
    odd = spark.createDataFrame([(1, None, 0), (1, 1, None), (None, 0, 1), (77, 0, 1)], LABELS)
    assert quality.classify(docs, odd).count() == 3
    assert quality.classify(docs.limit(0), odd).collect() == []
    assert quality.keep_good(docs, none).count() == 1  # the row without an id can't be named, so it stays


def test_pipeline_against_a_plain_version(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    sentence = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    boiler = sentence(7)
    texts = ["\n".join([sentence(30), boiler, sentence(30)]) if i % 2 else sentence(60) for i in range(60)]
    texts += [t + " more" for t in texts[:10]] + ["spam! " * 30 + sentence(3) for _ in range(30)] + [boiler]
    labels = [(i, int(not 70 <= i < 100), 0) for i in range(101)]
    spark.createDataFrame([(i, t, "en", f"s{i % 15}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == set(range(101)) - set(range(70, 100))
    lined = {r.doc_id: r for r in stages["line dedup"](spark, good, str(tmp_path)).collect()}
    assert set(lined) == set(range(70)) and lined[1].text == texts[1] and lined[3].text == texts[3].replace("\n" + boiler, "") and lined[3].n_chars == len(lined[3].text)
    left = spark.createDataFrame(list(lined.values()), docs.schema)
    unlike = {r.doc_id for r in stages["n-gram Jaccard join"](spark, left, str(tmp_path)).collect()}
    order = sorted(lined)
    assert unlike == {order[c] for c in groups_of([lined[i].text for i in order], 5, 80)[1].values()}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == unlike and len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    """No rows give none; nulls, empty and equal texts, equal and missing ids go through, and every text that is left is packed once."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = "a plain sentence of some words " * 10
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, good, "en", "s", 300), (4, good, "en", "t", 300), (4, good + "and more", "en", "t", 1), (None, good * 3, "en", None, 2), (None, None, "en", "s", 3)]
    labels = [(3, 1, 0), (4, 1, 0), (None, 1, 1), (5, None, None), (77, 0, 1)]
    for name, docs in (("none", []), ("odd", rows)):
        spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    left = [r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()]
    assert 3 in left and left.count(4) <= 2 and None in left
