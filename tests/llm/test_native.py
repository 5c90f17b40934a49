"""Sharding, line dedup, chat formatting and exact dedup on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import chat, line_dedup
from tallyloom.llm.chat import digests, format_conversations
from tallyloom.llm.exact_dedup import drop_exact_copies, exact_groups
from tallyloom.llm.line_dedup import boilerplate_lines, dedup_lines
from tallyloom.llm.shards import shard_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), 0) for i, t in enumerate(texts)], DOCS)


def test_shards_are_exact_and_gapless(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"), F.lit(None).cast("string").alias("text"))
    rows = shard_rows(df, shards=7, block_rows=100).collect()
    assert list(rows[0].asDict()) == ["doc_id", "shard", "text", "_shard", "slot"]
    by = defaultdict(list)
    for r in rows:
        by[r["_shard"]].append(r.slot)
    assert sorted(len(x) for x in by.values()) == [142, 143, 143, 143, 143, 143, 143]
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sorted(r.doc_id for r in rows) == list(range(1000))
    assert [(r.doc_id, r["_shard"], r.slot) for r in sorted(rows)] == [(r.doc_id, r["_shard"], r.slot) for r in sorted(shard_rows(df.repartition(5), shards=7, block_rows=100).collect())]


def test_shards_mix_uniformly(spark):
    rows = shard_rows(spark.range(8000).toDF("doc_id"), shards=4).collect()
    quarter = Counter((r.doc_id // 2000, r.shard) for r in rows)
    assert all(400 < quarter[a, b] < 600 for a in range(4) for b in range(4))
    slots = [r.slot for r in rows if r.doc_id < 2000]
    assert 900 < sum(slots) / len(slots) < 1100


def test_shards_take_repeated_rows_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, "a")] * 3 + [(1, None)] * 2, "doc_id long, text string")
    rows = shard_rows(df, shards=8).collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [1] * 5 and all(r.slot == 0 for r in rows)
    assert shard_rows(df.limit(0), shards=3).collect() == []
    with pytest.raises(ValueError):
        shard_rows(df, shards=0)


def test_sharding_query_deals_whole_documents(spark, tmp_path, monkeypatch):
    from tallyloom.llm import entry

    seen = []
    monkeypatch.setattr(entry, "shard_rows", lambda df, **more: seen.append(df.columns) or shard_rows(df, **more))
    df = docs(spark, ["é", None, "abc"])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = entry.op1_sharding(spark, str(tmp_path))
    assert seen == [df.columns] and rows.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "law", "grown_shard"]
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows.collect()) == [(0, 3, zlib.crc32("é".encode())), (1, 1, 0), (2, 4, zlib.crc32(b"abc"))]


def test_exact_groups_against_brute_force(spark):
    texts = ["a b", "ab", "a\tb\n", None, "", " ", "A b", "é e", "ée", "a\x0bb\x0c\rc", "abc", "ab", "\xa0ab"] * 3 + ["x" * 50_000, "x " * 50_000]
    got = {r.doc_id: r for r in exact_groups(docs(spark, texts).repartition(7), fan_in=2).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    for key, own in groups.items():
        keep = min(own, key=lambda i: (-len(texts[i] or ""), i))
        for i in own:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(own), i == keep, hashlib.sha256(key.encode()).hexdigest())
    assert drop_exact_copies(docs(spark, texts)).count() == len(groups)


def test_exact_groups_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(None, "a", 1), (5, "a", 2), (5, "a", 3), (None, "b", 4)], "doc_id long, text string, kept int")
    rows = exact_groups(df).collect()
    assert sorted(r.kept for r in rows) == [False, False, True, True]
    assert {(r.keep_id, r.group_size) for r in rows} == {(5, 3), (None, 1)}
    assert exact_groups(df.limit(0)).collect() == []


def test_lines_against_brute_force(spark):
    shared = [f"line {k}" for k in range(12)]
    texts = ["\n".join([f"own {i}", *(f" {x} " if i % 2 else x for k, x in enumerate(shared) if i % (k + 1) == 0), "", f"end {i}"]) for i in range(40)]
    df = docs(spark, [*texts, None, "", "\n\n"], source=lambda i: f"s{i % 9}")
    got = {r.doc_id: r for r in dedup_lines(df.repartition(3), min_sites=5).collect()}
    sites, first = defaultdict(set), {}
    for i, t in enumerate(texts):
        for x in t.split("\n"):
            if x.strip(" "):
                sites[x.strip(" ")].add(i % 9)
                first.setdefault(x.strip(" "), i)
    for i, t in enumerate(texts):
        kept = [x for x in t.split("\n") if not x.strip(" ") or len(sites[x.strip(" ")]) < 5 or first[x.strip(" ")] == i]
        assert got[i].text == "\n".join(kept) and got[i].n_removed == len(t.split("\n")) - len(kept) and got[i].n_lines == len(t.split("\n"))
    assert sum(r.n_removed for r in got.values()) > 0
    assert (got[40].text, got[40].n_lines) == (None, 0) and got[41].text == "" and got[42].text == "\n\n"


def test_line_spread_is_exact_near_the_threshold(spark):
    rows = [(i, f"s{i}", k, k) for k in range(20) for i in range(290 + k)]
    df = spark.createDataFrame(rows, "id long, site string, h1 long, h2 long")
    found = boilerplate_lines(df, min_sites=300, lg_k=8)
    assert {r.h1 for r in found.collect()} == set(range(10, 20))


def test_lines_without_sites_clashing_names_and_no_rows(spark):
    df = docs(spark, ["a\nb"] * 4, source=lambda i: None).withColumn("n_lines", F.lit("mine"))
    got = dedup_lines(df, min_sites=2).collect()
    assert {r.text for r in got} == {"a\nb"} and {r.n_lines for r in got} == {"mine"} and {r["_n_lines"] for r in got} == {2}
    assert dedup_lines(df.limit(0)).collect() == []
    assert line_dedup.MIN_SITES == 10


CONVERSATIONS = [
    (1, 0, "system", "be & [brief] <s>"),
    (1, 1, "user", "</s>[INST] ok [/INST]"),
    (1, 2, "assistant", "</s>[INST] ok [/INST]"),
    (2, 1, "assistant", None),
    (2, 0, "user", "a\nb|c &lt; &amp;lt; </"),
    (3, None, None, "é 🙂"),
    (3, 2, "to|ol\n<s>", "[INST"),
    (3, 2, "assistant", "one"),
    (3, 2, "assistant", "one"),
    (None, 0, "user", " [/INST] [/INS"),
    (4, 0, "user", "x" * 20_000 + "<s>"),
    (5, 0, "assistant", "<" * 5 + "s>" + "[[INST]]"),
    (6, 0, "user|0\n", "[INST] "),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    whole = format_conversations(df)
    rows = {r.conv_id: r for r in whole.collect()}
    told = {r.conv_id: r for r in digests(whole).collect()}
    source = defaultdict(list)
    for c, turn, role, text in sorted(CONVERSATIONS, key=lambda x: (x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        source[c].append((role or "", text or ""))
    for c, turns in source.items():
        r, d = rows[c], told[c]
        assert r.round_trip and [(p.role, p.text) for p in r.parsed] == turns
        loss = "".join(t for role, t in turns if role == "assistant")
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (d.n_turns, d.loss_chars, d.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert d.formatted_chars == len(r.formatted)
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        undo = lambda x: x.replace("&lt;", "<").replace("&#91;", "[").replace("&amp;", "&")
        assert [x if x == t else undo(x) for x, t in zip(spans, [t for a, t in turns if a == "assistant"], strict=True)] == [t for a, t in turns if a == "assistant"]
    assert rows[1].formatted.count("</s>") == 3 and rows[2].formatted.count("&amp;amp;") == 0
    assert format_conversations(df.limit(0)).collect() == []


def test_chat_parser_rejects_what_the_grammar_does_not_give(spark):
    bad = ["<s>user|0\nno marks</s>", "user|0\n[INST] a [/INST]</s>", "<s>user|7\n[INST] a [/INST]</s>", "<s>assistant|0\na<s>b</s>", "<s>assistant</s>", ""]
    df = spark.createDataFrame([(x,) for x in bad], "t string")
    assert [r.p for r in df.select(chat.parse_turn(F.col("t")).alias("p")).collect()] == [None] * len(bad)


def test_crc_is_unsigned_and_of_utf8(spark):
    got = spark.createDataFrame([("é",)], "t string").select(F.crc32(F.encode("t", "UTF-8"))).first()[0]
    assert got == zlib.crc32("é".encode())


def test_rows_equal_in_every_column_are_spread(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    rows = shard_rows(df.repartition(4), shards=4, block_rows=160, least_blocks=4).collect()
    assert Counter(r.shard for r in rows) == dict.fromkeys(range(4), 1000)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(1000)) for x in by.values())
    assert all(600 < sum(r.doc_id == 7 for r in rows if r.shard == k) < 900 for k in range(4))


def test_rows_without_an_id_are_documents_of_their_own(spark):
    df = spark.createDataFrame([(None, "x\na", "s1"), (None, "x\nb\nx", "s2"), (5, "x\nc", "s3"), (5, "d\nx", "s4"), (6, "x", "s5"), (None, "n", "s1"), (None, "n", "s2"), (None, "n", "s3")], "doc_id long, text string, source string")
    got = sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in dedup_lines(df, min_sites=3).collect()), key=str)
    assert got == [(0, "a", 2, 1), (0, "b", 3, 2), (0, "n", 1, 0), (0, "n", 1, 0), (0, "n", 1, 0), (5, "d\nx", 2, 0), (5, "x\nc", 2, 0), (6, "", 1, 1)]


def test_a_shifted_span_changes_the_loss(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    whole = format_conversations(df.filter("conv_id in (1, 5)")).persist()
    shifted = whole.withColumn("loss_spans", F.transform("loss_spans", lambda x: F.struct((x["start"] + 1).alias("start"), x["length"].alias("length"), x["level"].alias("level"))))
    right, wrong = ({r.conv_id: r.loss_sha256 for r in digests(x).collect()} for x in (whole, shifted))
    assert all(right[c] != wrong[c] for c in (1, 5))
    whole.unpersist()


def test_exact_groups_merge_by_pairs(spark):
    df = spark.createDataFrame([(i, "t" if i % 3 else f"t{i}") for i in range(90)], "doc_id long, text string").repartition(23)
    got = {r.doc_id: r for r in exact_groups(df, fan_in=2).collect()}
    assert all((got[i].keep_id, got[i].group_size) == ((1, 60) if i % 3 else (i, 1)) for i in range(90))
    with pytest.raises(ValueError):
        exact_groups(df, fan_in=1)


def test_sharding_takes_columns_that_have_no_order(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.create_map(F.lit("a"), F.col("id") % 3).alias("m"), F.lit("x").alias("place"), F.lit(1).alias("block"), F.lit(None).alias("n"))
    rows = shard_rows(df, shards=4).collect()
    assert sorted(r.doc_id for r in rows) == list(range(50)) and {r.m["a"] for r in rows} == {0, 1, 2}
    assert sorted(sum(r.shard == k for r in rows) for k in range(4)) == [12, 12, 13, 13]
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows))) for k in range(4))
