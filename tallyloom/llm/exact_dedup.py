"""Exact dedup by a tree merge of sorted digest runs.

Every input partition becomes a run: its rows sorted by digest, one for each (digest, best row, size). In each binomial round FAN_IN neighbouring
runs meet: they are exchanged by the run that they make and by a range of digests, sorted again by digest where they arrive (what arrives is FAN_IN sorted
stretches), and a sort aggregate walks them, keeps the best row of every digest and adds up the sizes. The ranges are cut by the digest's first bytes,
so that a round has as many tasks as the one before, though it has fewer runs. A group of copies, however large, leaves one row per
run before anything is exchanged, and no merge sees more than FAN_IN rows of it. The digest is SHA-256; every level also holds the byte
length and a second, independent 64-bit hash against it, so rows merge only where all three agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, free_name, text_or_empty

FAN_IN = 16
RANGE_BYTES = 2
SPACE = "[\\x20\\x09-\\x0D]"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Equal are texts that are identical without the characters of SPACE; null counts as empty, and empty texts are
    equal to one another. The row with the most code points in its original text stays, then the smallest id,
    null ids last; of rows that are the same in both, exactly one is kept. keep_id is null only if all ids of the
    group are. Other columns are not read. An empty table gives an empty result. fan_in is 2 at least.
    """
    if fan_in < 2:
        raise ValueError("a round must merge two runs at least")
    text = text_or_empty(F.col(text_col))
    bare = F.regexp_replace(text, SPACE, "")
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            F.char_length(text).alias("points"),
            bare.alias("bare"),
        ).select(
            "id",
            "points",
            F.unhex(F.sha2("bare", 256)).alias("digest"),
            F.octet_length("bare").alias("bytes"),
            F.xxhash64("bare").alias("check"),
            F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    key = ["digest", "bytes", "check"]
    runs = (rows.agg(F.max("run").alias("r")).first().r or 0) + 1
    merged = lambda df, *by: df.groupBy(*by, *key).agg(F.min("best").alias("best"), F.sum("size").alias("size"))
    state = merged(
        rows.select(
            "run",
            *key,
            F.struct((-F.col("points")).alias("fewer"), F.col("id").isNull().alias("no_id"), "id", "row").alias("best"),
            F.lit(1).cast("long").alias("size"),
        ),
        "run",
    )
    first_bytes = F.conv(F.hex(F.substring("digest", 1, RANGE_BYTES)), 16, 10).cast("long")
    ranges = runs
    while runs > 1:
        runs = -(-runs // fan_in)
        # As many ranges to a run as keep the number of tasks: neighbouring digests lie in one range.
        range_of = F.shiftright(first_bytes * max(1, ranges // runs), 8 * RANGE_BYTES)
        state = merged(state.withColumns({"run": F.expr(f"cast(run div {fan_in} as int)"), "range": range_of}).repartition("run", "range"), "run", "range")
    groups = state.select(*key, F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "size")
    return rows.join(groups, key).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups() drops; ids must be unique here."""
    gone = exact_groups(docs, id_col, text_col).filter("not kept")
    name = free_name(docs, "gone_id")
    gone = gone.select(F.col(id_col).alias(name))
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")
