"""Queries and oracles of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.lineage import shared_dir

from . import entry_more
from .bpe import encode_documents
from .chat import CONTROL, digests, format_conversations
from .exact_dedup import exact_groups
from .id_files import load_ids, save_ids
from .line_dedup import MIN_SITES, dedup_lines
from .near_vectors import near_groups
from .ngram_join import jaccard_groups
from .packing import END_ID, digest_ids, pack_documents
from .pfor import segments_of
from .quality import classify
from .shards import shard_rows
from .shared import table, text_or_empty


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty(F.col("text"))
    return shard_rows(table(spark, sf_dir, "documents"), shards=16).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        "shard",
        "slot",
        F.lit("rows").alias("law"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_ids(pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=END_ID, arrays=False))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256")
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), words=4, percent=85)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        f"select -7L as conv_id, turn, role, '{planted}' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_conversations(rows))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    segments = segments_of(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return load_ids(spark, save_ids(segments, f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"), with_ids=False)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_packing": op3_packing,
    "op4_near_vectors": op4_near_vectors,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_quality": op8_quality,
    "op9_token_files": op9_token_files,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES = {
    "op4_near_vectors": """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from v a, v b
  where a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_cosine_similarity(a.x, b.x) >= 0.95
), c as (
  select vec_id as node, vec_id as reach from embeddings
  union
  select c.node, l.b from c join l on c.reach = l.a
), m as (select node, min(reach) as component_id from c group by node)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) as n_links, m.component_id, e.vec_id = m.component_id as kept
from embeddings e join m on m.node = e.vec_id
""",
    "op5_line_dedup": f"""
with l as (
  select doc_id, source, generate_subscripts(x, 1) as pos, unnest(x) as line
  from (select doc_id, source, string_split(coalesce(text, ''), chr(10)) as x from documents)
), b as (
  select trim(line, ' ') as line, min(doc_id) as first_id from l where trim(line, ' ') <> ''
  group by 1 having count(distinct source) >= {MIN_SITES}
), m as (
  select l.*, b.line is not null and l.doc_id <> b.first_id as gone from l left join b on trim(l.line, ' ') = b.line
)
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as text_sha256
from m group by doc_id
""",
    "op7_chat_formatting": f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), u as (
  select *, {" or ".join(f"contains(text, '{c}')" for c in CONTROL)} as clash, replace(text, '&', '&amp;') as amp from t
), v as (
  select *, length(role) + 10 + case when role = 'user' then 15 else 0 end
    + case when clash then length({"replace(" * len(CONTROL)}amp{"".join(f", '{c}', '{dict([('<', '&lt;'), ('[', '&#91;')])[c[0]] + c[1:]}')" for c in CONTROL)}) else length(text) end as chars
  from u
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars, true as round_trip
from v group by conv_id
""",
    "op10_exact_dedup": r"""
with d as (
  select doc_id, length(coalesce(text, '')) as points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents
), r as (
  select *, count(*) over (partition by text_sha256) as group_size,
    first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id nulls last) as keep_id,
    row_number() over (partition by text_sha256 order by points desc, doc_id nulls last) = 1 as kept
  from d
)
select doc_id, keep_id, group_size, kept, text_sha256 from r
""",
}


def queries() -> dict:
    return QUERIES | entry_more.QUERIES


def oracle_sql() -> dict:
    return ORACLES | entry_more.ORACLES
