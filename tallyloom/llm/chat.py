"""Chat formatting with a grammar round trip.

    conversation = turn*
    turn         = "<s>" role "|" level LF body "</s>"
    body         = "[INST] " text " [/INST]"      if role is "user"
                 | text                           otherwise

text and role hold no control string (CONTROL). A turn is first rendered with its text as it is (level 0) and parsed;
where the parser does not give back the very role and text, the control strings in the text are escaped (level 1); where
that still fails, every "&", "<" and "[" is (level 2), which leaves nothing to misread. The level stands in the turn's header,
so that the parser knows whether to unescape. Finally the whole conversation is parsed from its formatted
string alone, and what comes out is held against the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_or_empty

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]
OPEN, CLOSE = "[INST] ", " [/INST]"
LEVELS = 3


def _escape(text: Column, level: int) -> Column:
    if level == 0:
        return text
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for found in CONTROL if level == 1 else ["<", "["]:
        text = F.replace(text, F.lit(found), F.lit({"<": "&lt;", "[": "&#91;"}[found[0]] + found[1:]))
    return text


def _unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&#91;", "["), ("&#124;", "|"), ("&#10;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _escaped_role(role: Column) -> Column:
    role = _escape(role, 2)
    return F.replace(F.replace(role, F.lit("|"), F.lit("&#124;")), F.lit("\n"), F.lit("&#10;"))


def render_turn(role: Column, text: Column, level: int) -> Column:
    body = _escape(text, level)
    body = F.when(role == "user", F.concat(F.lit(OPEN), body, F.lit(CLOSE))).otherwise(body)
    return F.concat(F.lit("<s>"), _escaped_role(role), F.lit(f"|{level}\n"), body, F.lit("</s>"))


def _rest(text: Column, n: Column | int) -> Column:
    """text without its first n code points."""
    return F.substr(text, F.lit(n) + 1 if isinstance(n, int) else n + 1)


def parse_turn(turn: Column) -> Column:
    """struct(role, text), or null if turn is not one turn of the grammar."""
    inner = F.substr(turn, F.lit(4), F.char_length(turn) - 7)
    header = F.substring_index(inner, "\n", 1)
    role = _unescape(F.substring_index(header, "|", 1))
    level = F.substring_index(header, "|", -1)
    body = _rest(inner, F.char_length(header) + 1)
    user = role == "user"
    text = F.when(user, F.substr(body, F.lit(len(OPEN) + 1), F.char_length(body) - len(OPEN) - len(CLOSE))).otherwise(body)
    clean = F.lit(True)
    for found in CONTROL:
        clean = clean & ~F.contains(text, F.lit(found)) & ~F.contains(header, F.lit(found))
    valid = (
        F.startswith(turn, F.lit("<s>"))
        & F.endswith(turn, F.lit("</s>"))
        & F.contains(inner, F.lit("\n"))
        & level.isin([str(x) for x in range(LEVELS)])
        & (~user | (F.startswith(body, F.lit(OPEN)) & F.endswith(body, F.lit(CLOSE)) & (F.char_length(body) >= len(OPEN) + len(CLOSE))))
        & clean
    )
    return F.when(valid, F.struct(role.alias("role"), F.when(level == "0", text).otherwise(_unescape(text)).alias("text")))


def parse_conversation(formatted: Column) -> Column:
    """array<struct(role, text)> of a formatted conversation; a null element where a turn breaks the grammar."""
    pieces = F.split(formatted, "</s>", -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(turns, lambda x: parse_turn(F.concat(x, F.lit("</s>"))))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conv_id of (conv_id, turn, role, text): what was formatted and what was read back from it.

    formatted; parsed array<struct(role, text)> from formatted alone; loss_spans array<struct(start, length, level)>, in code
    points of formatted, of the assistant texts as they stand there (escaped to their turn's level); round_trip, true: were
    parsed not the source, the query would fail rather than hand out what can't be read back. Rows go by turn, null turns first, then role and text, so ties and repeated rows all stay, in a
    fixed order. Null texts and roles are empty strings; rows without conv_id form one conversation. Other columns are not
    read. An empty table gives an empty result.
    """
    rows = turns.select(
        "conv_id", "turn", text_or_empty(F.col("role")).alias("role"), text_or_empty(F.col("text")).alias("text")
    )
    source = F.struct("role", "text")
    for level in range(LEVELS):
        rows = rows.withColumn(f"r{level}", render_turn(F.col("role"), F.col("text"), level))
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(parse_turn(F.col("r0")).eqNullSafe(source), F.struct(F.lit(0).alias("level"), F.col("r0").alias("turn")))
        .when(parse_turn(F.col("r1")).eqNullSafe(source), F.struct(F.lit(1).alias("level"), F.col("r1").alias("turn")))
        .otherwise(F.struct(F.lit(2).alias("level"), F.col("r2").alias("turn")))
        .alias("out"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.char_length("out.turn")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    user = F.col("role") == "user"
    around = F.when(user, len(OPEN)).otherwise(0)
    after = F.when(user, len(CLOSE)).otherwise(0) + len("</s>")
    head = F.lit(len("<s>")) + F.char_length(_escaped_role(F.col("role"))) + 3 + around
    placed = rows.select(
        "conv_id",
        F.row_number().over(order).alias("k"),
        source.alias("source"),
        F.col("out.turn").alias("formatted"),
        F.struct(
            (before + head).alias("start"), (F.char_length("out.turn") - head - after).cast("long").alias("length"), F.col("out.level").alias("level")
        ).alias("span"),
    )
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "source", "formatted", "span"))).alias("t"))
    read = whole.select(
        "conv_id",
        F.array_join("t.formatted", "").alias("formatted"),
        F.col("t.source").alias("source"),
        F.transform(F.filter("t", lambda x: x["source"]["role"] == "assistant"), lambda x: x["span"]).alias("loss_spans"),
    ).withColumn("parsed", parse_conversation(F.col("formatted")))
    return read.select(
        "conv_id",
        "formatted",
        "parsed",
        "loss_spans",
        F.when(F.col("parsed").eqNullSafe(F.col("source")), True).otherwise(F.raise_error("a conversation doesn't parse back").cast("boolean")).alias("round_trip"),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """What stands under spans (start, length, level) of formatted, unescaped, one after the other.

    The text is widened to four bytes a code point once, so that a span far in costs no walk from the start.
    """

    def cut_out(wide: Column) -> Column:
        def one(span: Column) -> Column:
            text = F.decode(F.substring(wide, (4 * span["start"] + 1).cast("int"), (4 * span["length"]).cast("int")), "UTF-32")
            return F.when(span["level"] == 0, text).otherwise(_unescape(text))

        return F.array_join(F.transform(spans, one), "")

    # A lambda's argument is evaluated once; a column might be put in its place again for every span.
    return F.get(F.transform(F.array(F.encode(formatted, "UTF-32")), cut_out), F.lit(0))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, round_trip.

    Turns are read back from parsed; the loss columns from what stands under loss_spans in formatted.
    """
    said = F.array_join(F.transform("parsed", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return formatted.withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans"))).select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
