"""Line dedup by distinct-site spread.

Each line's hash carries a HyperLogLog sketch of the sites (sources) that hold it; sketches merge by aggregation.
Lines whose estimate lies clear of the threshold are settled by it; those within ERRORS standard errors
get an exact distinct count. A line on at least min_sites sites is boilerplate and stays only in the document with
the smallest id that holds it, so that of a text copied everywhere one whole copy remains.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard, free_name, text_or_empty

MIN_SITES = 10
LG_K = 12
ERRORS = 4


def _key(line: Column) -> Column:
    """128 bits: two xxHash64 values of different seeds."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"))


def boilerplate_lines(occurrences: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, made: list[DataFrame] | None = None) -> DataFrame:
    """(h1, h2, first_id) of every line in (id, site, h1, h2) that at least min_sites distinct sites hold.

    A null site counts as none. first_id is the smallest id, null if all are null. made gets the table that was cut on the way.
    """
    error = ERRORS * 1.04 / math.sqrt(2**lg_k)
    spread = occurrences.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.min("id").alias("first_id")
    )
    spread = cut(spread.filter(F.col("sites") >= math.floor(min_sites * (1 - error))))
    if made is not None:
        made.append(spread)
    sure = spread.filter(F.col("sites") > math.ceil(min_sites * (1 + error))).select("h1", "h2", "first_id")
    near = spread.filter(F.col("sites") <= math.ceil(min_sites * (1 + error))).select("h1", "h2", "first_id")
    exact = (
        occurrences.join(near, ["h1", "h2"])
        .groupBy("h1", "h2", "first_id", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2", "first_id")
        .agg(F.count("site").alias("sites"))
        .filter(F.col("sites") >= min_sites)
    )
    return sure.union(exact.select("h1", "h2", "first_id"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    site_col: str = "source",
    text_col: str = "text",
    min_sites: int = MIN_SITES,
    lg_k: int = LG_K,
) -> DataFrame:
    """docs with text_col cleaned, plus n_lines and n_removed (long).

    Lines end at a line feed and compare without spaces at their ends; blank lines are never removed and count in
    n_lines. A null text stays null, with 0 lines; a text that loses every line becomes the empty string. Rows that share an
    id are one document: a line that stays in one stays in all of them. Of a line that only rows without an id hold, all
    stay; beside a row with an id, those without lose it. Columns of docs named n_lines or n_removed stay, and the new ones get
    a leading underscore. An empty table gives an empty result.
    """
    row, gone, lines, kept = (free_name(docs, f"__{x}") for x in ("row", "gone", "lines", "kept"))
    text = F.col(f"`{text_col}`")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "zstd")
    occurrences = cut(
        rows.select(
            F.col(row).alias("row"),
            F.col(f"`{id_col}`").alias("id"),
            F.col(f"`{site_col}`").cast("string").alias("site"),
            F.posexplode(F.split(text_or_empty(text), "\n", -1)).alias("at", "line"),
        )
        .withColumn("line", F.trim("line"))
        .filter("line <> ''")
        .select("row", "id", "site", "at", _key(F.col("line")).alias("k"))
        .select("row", "id", "site", "at", "k.h1", "k.h2")
    )
    made = [occurrences]
    removed = cut(
        occurrences.join(boilerplate_lines(occurrences.select("id", "site", "h1", "h2"), min_sites, lg_k, made), ["h1", "h2"])
        .filter(~F.col("id").eqNullSafe(F.col("first_id")))
        .groupBy(F.col("row").alias(row))
        .agg(F.sort_array(F.collect_list("at")).alias(gone))  # no more than one row's lines
    )
    discard(*made)
    n_lines, n_removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    # What lies between two removed lines stays; each line is copied once.
    ends = F.arrays_zip(F.concat(F.array(F.lit(-1)), F.col(gone)).alias("a"), F.concat(F.col(gone), F.array(F.size(lines))).alias("b"))
    between = F.flatten(F.transform(ends, lambda x: F.slice(F.col(lines), x["a"] + 2, x["b"] - x["a"] - 1)))
    return (
        rows.join(removed.hint("merge"), row, "left")  # removed grows with the table: dealt out at any size
        .withColumn(lines, F.split(text, "\n", -1))
        .withColumn(kept, F.when(F.col(gone).isNull(), F.col(lines)).otherwise(between))
        .withColumn(n_lines, F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"))
        .withColumn(n_removed, F.when(text.isNull() | F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
        .withColumn(text_col, F.array_join(kept, "\n"))
        .select(*(F.col(f"`{c}`") for c in docs.columns), n_lines, n_removed)
    )
