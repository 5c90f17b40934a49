"""Conversation structure repair by signature deduplication.

What has to be done to a conversation hangs on its roles and faults alone. A row becomes one letter: the initial of its role (s, u, a, or o
for any other), as a capital if the text is truncated, or x if the row must go. The letters of a conversation are its signature. Every distinct signature
is solved once, by memoised recursion over (row, what came before); audits and steps are joined back by signature on narrow rows, and the
steps are replayed on the texts by Spark's array functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, free_name

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
STEP = "array<struct<at:int,role:string>>"
#: What may follow nothing, a system turn, a user turn and an assistant turn; a repaired conversation ends in nothing or an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDING = (START, ASSISTANT)
#: The one of user and assistant that may follow, as a role and the state that it leads to.
PUT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: More inserts in a row than two only go round.
MOST_INSERTS = 2
STRIDE = 128


def solve(signature: str) -> tuple[int, str, list[tuple[int | None, str | None]]]:
    """(cost, audit, steps) of the cheapest edits, of which the ASCII-least.

    From one place, edits that differ start with different letters, so that of equal costs the lesser letter decides. steps are the turns of
    the repaired conversation: (row, None) to keep, (row, role) to rerole, (None, role) to insert.
    """
    n = len(signature)
    costs: dict[tuple[int, int, int], float] = {}
    chosen = bytearray(4 * (MOST_INSERTS + 1) * (n + 1))
    slot = lambda i, state, put: (i * 4 + state) * (MOST_INSERTS + 1) + put

    def least(i: int, state: int, put: int) -> float:
        key = (i, state, put)
        if key in costs:
            return costs[key]
        found = []
        if i == n and state in ENDING:
            found.append((0, ""))
        if i < n:
            letter = signature[i]
            found.append((DELETE + least(i + 1, state, 0), "D"))
            if letter != "x":
                worse = TRUNCATED if letter.isupper() else 0
                if (follows := FOLLOWS[state].get(letter.lower())) is not None:
                    found.append((worse + least(i + 1, follows, 0), "K"))
                found.append((worse + REROLE + least(i + 1, PUT[state][1], 0), "R"))
        if put < MOST_INSERTS:
            found.append((INSERT + least(i, PUT[state][1], put + 1), "I"))
        cost, edit = min(found, default=(float("inf"), ""))
        costs[key], chosen[slot(*key)] = cost, ord(edit) if edit else 0
        return cost

    for i in range(n, 0, -STRIDE):  # from the end, so that the recursion stays shallow and only a stride's costs are kept
        kept = {(i, state, 0): least(i, state, 0) for state in FOLLOWS}
        costs.clear()
        costs.update(kept)
    total = least(0, START, 0)
    audit, steps, i, state, put = [], [], 0, START, 0
    while edit := chosen[slot(i, state, put)]:
        edit = chr(edit)
        audit.append(edit)
        if edit == "I":
            role, state = PUT[state]
            steps.append((None, role))
            put += 1
            continue
        if edit == "K":
            state = FOLLOWS[state][signature[i].lower()]
            steps.append((i, None))
        elif edit == "R":
            role, state = PUT[state]
            steps.append((i, role))
        i, put = i + 1, 0
    return int(total), "".join(audit), steps


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("at", pa.int32()), ("role", pa.string())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            own = batch.column("signature").slice(at, 256)
            cost, audit, steps = zip(*map(solve, own.to_pylist()), strict=True)
            steps = [[{"at": row, "role": role} for row, role in x] for x in steps]
            yield pa.RecordBatch.from_arrays([own, pa.array(cost, pa.int64()), pa.array(audit), pa.array(steps, kind)], ["signature", "cost", "audit", "steps"])


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: str = "gone") -> DataFrame:
    """rows as a fixed rule damages them, by crc32 of "conversation:turn" modulo 20; null counts as one space everywhere.

    0 drops a row, which stays as one whose column gone is true; 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it,
    4 sets its role to user. Other columns go.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rule_of = F.pmod(F.crc32(F.encode(F.concat(space(conv_col), F.lit(":"), space(turn_col)), "UTF-8")), F.lit(20))
    held = rows.select(F.col(f"`{conv_col}`").alias(conv_col), F.col(f"`{turn_col}`").alias(turn_col), space(role_col).alias(role_col), space(text_col).alias(text_col))
    mark, copy = free_name(held, "rule"), free_name(held, "copy")
    held = held.withColumn(mark, rule_of)
    return held.select(
        conv_col,
        turn_col,
        F.when(F.col(mark) == 4, F.lit("user")).otherwise(F.col(role_col)).alias(role_col),
        F.when(F.col(mark) == 1, F.lit("")).when(F.col(mark) == 2, F.translate(F.col(text_col), "".join(ENDS), "")).otherwise(F.col(text_col)).alias(text_col),
        (F.col(mark) == 0).alias(gone),
        F.explode(F.when(F.col(mark) == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias(copy),
    ).drop(copy)


def repair_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None
) -> DataFrame:
    """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (array of (role, text)).

    Turns go by turn_col, nulls first; those of one turn by role and text. A null role or text counts as one space. A row's first fault counts:
    blank (nothing but white space), duplicate (role and text seen earlier in its conversation), truncated (the last character that isn't
    white space is none of ENDS). gaps are the turn numbers missing between the least and the greatest, illegal the neighbours whose
    initials are not su, ua or au. Keep costs nothing; Rerole to user or assistant, Insert of one of them without text, and
    leaving a truncated row cost 3, Delete costs 4; blank and duplicate rows must be deleted. audit has the initials of the cheapest edits
    that leave (s?(ua)+)?, of which the ASCII-least. Rows whose gone_col is true count as absent, but their conversation has
    a row: zeros, an empty audit and no turns if nothing else is left. Rows without a conversation id are one conversation. Other columns are not
    read; an empty table gives an empty result. One conversation must fit in a task, as its repaired turns are one value.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    absent = F.coalesce(F.col(f"`{gone_col}`"), F.lit(False)) if gone_col else F.lit(False)
    own = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), (~absent).alias("here"))
    order = Window.partitionBy("conv").orderBy(F.col("here").desc(), F.col("turn").asc_nulls_first(), "role", "text")
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    placed = own.withColumns(
        {"place": F.row_number().over(order), "turn_before": F.lag("turn").over(order), "pair": F.concat(F.lag(initial).over(order), initial)}
    )
    seen = F.row_number().over(Window.partitionBy("conv", "here", "role", "text").orderBy("place")) > 1
    fault = F.when(bare == "", "blank").when(seen, "duplicate").when(~F.substring(bare, -1, 1).isin(*ENDS), "truncated")
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    marked = placed.withColumn("fault", fault).withColumn(
        "letter", F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    )
    here = F.col("here")
    turns = F.max(F.when(here, F.col("turn"))).cast("decimal(20,0)") - F.min(F.when(here, F.col("turn"))) + 1
    different = F.count_if(here & F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before")))
    many = lambda c: F.count_if(here & F.coalesce(c, F.lit(False)))
    whole = cut(
        marked.groupBy("conv")
        .agg(
            F.coalesce((turns - different).cast("long"), F.lit(0).cast("long")).alias("gaps"),
            *(many(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")),
            many(~F.col("pair").isin("su", "ua", "au")).alias("illegal"),
            F.sort_array(F.collect_list(F.when(here, F.struct("place", "letter", "role", "text")))).alias("rows"),
        )
        .withColumn("signature", F.array_join(F.transform("rows", lambda r: r["letter"]), ""))
        .withColumn("rows", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))))
        .withColumn("key", F.monotonically_increasing_id())
    )
    solved = whole.select("signature").distinct().mapInArrow(_solved, f"signature string, cost long, audit string, steps {STEP}")
    audits = whole.select("key", "signature").join(solved, "signature").select("key", "cost", "audit", "steps")

    def turn(step: Column) -> Column:
        row = F.get(F.col("rows"), step["at"])
        return F.struct(F.coalesce(step["role"], row["role"]).alias("role"), F.coalesce(row["text"], F.lit("")).alias("text"))

    return whole.join(audits, "key").select(
        F.col("conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.transform("steps", turn).alias("repaired")
    )


def repaired_digest(repaired: Column) -> Column:
    """sha256 of the repaired turns as role:text, one a line."""
    return F.sha2(F.array_join(F.transform(repaired, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"), 256)
