"""Queries and SQL of sort-means clustering, conversation repair and substring dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repair import damage, repair_conversations, repaired_digest
from .shared import table
from .sort_means import CLUSTERS, ROUNDS, SCALE, WIDTH, cluster_vectors
from .suffix_ranks import remove_repeats


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _centroid_sql() -> str:
    """Every round as two tables of a query: all distances, then floors of means."""
    parts = [
        f"""v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as x from embeddings
  where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)""",
        f"""c0 as (
  select cast(row_number() over (order by h) - 1 as integer) as c, x
  from (select x, sha256('2:' || vec_id) as h from v order by h limit {CLUSTERS})
)""",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} as materialized (
  select vec_id, any_value(x) as x, arg_min(c, [d, c]) as c, min(d) as d from (
    select v.vec_id, v.x, k.c, list_sum(list_transform(list_zip(v.x, k.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from v, c{r} k
  ) group by vec_id
)""")
        if r < ROUNDS:
            parts.append(f"""c{r + 1} as materialized (
  select k.c, coalesce(m.x, k.x) as x from c{r} k left join (
    select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as x
    from (select c, i, cast(sum(y) as hugeint) as s, count(*) as n from (select c, unnest(x) as y, generate_subscripts(x, 1) as i from a{r}) group by c, i)
    group by c
  ) m on m.c = k.c
)""")
    return (
        "with "
        + ", ".join(parts)
        + f"""
select a.vec_id, a.c as cluster, cast(a.d as bigint) as distance, cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia,
  cast(sum(a.d) over () as bigint) as inertia, sha256(array_to_string(k.x, ',')) as centroid_sha256
from a{ROUNDS} a join c{ROUNDS} k on k.c = a.c
"""
    )


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = damage(table(spark, sf_dir, "conversations"))
    return repair_conversations(damaged, gone_col="gone").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", repaired_digest(F.col("repaired")).alias("repaired_sha256")
    )


def _repair_sql() -> str:
    """Damage and faults by windows; the cheapest edits row by row from the end, as texts of a cost of 9 digits and an audit."""
    space = r"[\x20\x09-\x0D]"
    edit = lambda cost, letter, rest: f"(lpad(cast(cast(left({rest}, 9) as bigint) + {cost} as varchar), 9, '0') || '{letter}' || substr({rest}, 10))"

    def step(state: int, follows: dict[str, int], put: int) -> str:
        keep = "".join(f" when '{k}' then {edit('more', 'K', f'b{to}')}" for k, to in follows.items())
        gone = edit(4, "D", f"b{state}")
        return f"least({gone}, case when letter = 'x' then {gone} else {edit('3 + more', 'R', f'b{put}')} end, case kind{keep} else {gone} end) as g{state}"

    steps = ", ".join([step(0, {"s": 1, "u": 2}, 2), step(1, {"u": 2}, 2), step(2, {"a": 3}, 3), step(3, {"u": 2}, 2)])
    one, two = (lambda b: edit(3, "I", b)), (lambda b: edit(3, "I", edit(3, "I", b)))
    return f"""
with recursive bits as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, i)) as t
), own as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations
), ruled as (
  select conv_id, turn, role, text, xor(4294967295, list_reduce(list_transform(string_split(k, ''), lambda x: cast(ascii(x) as bigint)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) % 20 as rule from own, bits
), damaged as (
  select conv_id, turn, case when rule = 4 then 'user' else role end as role,
    case when rule = 1 then '' when rule = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when rule = 3 then [0, 1] else [0] end) as copy
  from ruled where rule <> 0
), placed as (
  select *, row_number() over w as place, left(role, 1) as kind, lag(left(role, 1)) over w || left(role, 1) as pair from damaged
  window w as (partition by conv_id order by turn nulls first, role, text, copy)
), faulty as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
    when row_number() over (partition by conv_id, role, text order by place) > 1 then 'duplicate'
    when not regexp_matches(text, '[.!?]{space}*\\z') then 'truncated' else '' end as fault
  from placed
), marked as (select *, case when fault in ('blank', 'duplicate') then 'x' else kind end as letter, case when fault = 'truncated' then 3 else 0 end as more from faulty),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from marked group by conv_id
), back as (
  select conv_id, n as i, '000000000' as b0, '000000006II' as b1, '000000003I' as b2, '000000000' as b3 from counted
  union all
  select conv_id, i - 1, least(g0, {one("g2")}, {two("g3")}), least(g1, {one("g2")}, {two("g3")}), least(g2, {one("g3")}), least(g3, {one("g2")})
  from (select b.conv_id, b.i, {steps} from back b join (
    select conv_id, place, letter, case when letter = 'x' then 'x' else kind end as kind, more from marked) m on m.conv_id = b.conv_id and m.place = b.i)
), solved as (select conv_id, cast(left(b0, 9) as bigint) as cost, substr(b0, 10) as audit from back where i = 0),
edits as (select conv_id, unnest(string_split(audit, '')) as e, generate_subscripts(string_split(audit, ''), 1) as j from solved where audit <> ''),
numbered as (
  select *, count(*) filter (e <> 'I') over w as place, count(*) filter (e <> 'D') over w as m from edits window w as (partition by conv_id order by j)
), said as (
  select n.*, f.role, f.text, max(case when n.e = 'K' and n.m = 1 and f.kind = 's' then 1 else 0 end) over (partition by n.conv_id) as led
  from numbered n left join marked f on f.conv_id = n.conv_id and f.place = n.place and n.e <> 'I'
), done as (
  select conv_id, sha256(string_agg(case when e = 'K' then role when (m - led) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by j)) as repaired_sha256
  from said where e <> 'D' group by conv_id
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join counted using (conv_id) left join solved using (conv_id) left join done using (conv_id)
"""


def op13_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op11_centroids": op11_centroids, "op12_repair": op12_repair, "op13_suffix_array": op13_suffix_array}
ORACLES = {"op11_centroids": _centroid_sql(), "op12_repair": _repair_sql()}
