r"""Chat formatting with a grammar round trip.

A conversation is turns, and a turn is ``<s>[INST] role``, a new line, the text, `` [/INST]</s>``; ``[INST*]``
instead of ``[INST]`` says that the text is escaped. The grammar is regular: ``</s>`` ends a turn, wherever it is, and
no other control string is in a text that is not escaped. Each conversation is rendered plainly and parsed again. Where the turns that come back are not those that went in,
the texts with control strings are escaped, and at last all texts, until the two are identical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, CLOSE, END, STAR = "<s>[INST", " [/INST]", "</s>", "*"
CONTROL = r"</?s>|\[/?INST"
TURN = r"(?s)^<s>\[INST(\*?)\] ([^\n]*)\n(.*) \[/INST\]$"
LOSS_ROLE = "assistant"

#: Escapes, in the order in which they are put in; they are taken out in the opposite order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
LEVELS = 3


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _role_back(text: Column) -> Column:
    return unescape(F.replace(text, F.lit("&#10;"), F.lit("\n")))


def _escaped(turn: Column, level: int) -> Column:
    return F.lit(level == 2) if level != 1 else turn["text"].rlike(CONTROL)


def _head(turn: Column, level: int) -> Column:
    star = F.when(_escaped(turn, level), F.lit(STAR)).otherwise(F.lit(""))
    return F.concat(F.lit(OPEN), star, F.lit("] "), _role(turn["role"]), F.lit("\n"))


def _body(turn: Column, level: int) -> Column:
    return F.when(_escaped(turn, level), escape(turn["text"])).otherwise(turn["text"])


def _render(turns: Column, level: int) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t, level), _body(t, level), F.lit(CLOSE + END))), "")


def _mask(turns: Column, level: int) -> Column:
    """For each turn where its loss starts, counted from the turn's start, and how many code points it has."""
    length = lambda t: F.when(t["role"] == LOSS_ROLE, F.char_length(_body(t, level))).otherwise(0)
    return F.transform(turns, lambda t: F.struct(F.char_length(_head(t, level)).alias("start"), length(t).alias("length")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text). What is no turn comes back as nulls."""
    pieces = F.split(formatted, END, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        text = F.regexp_extract(piece, TURN, 3)
        whole = F.struct(_role_back(F.regexp_extract(piece, TURN, 2)).alias("role"), F.when(F.regexp_extract(piece, TURN, 1) == STAR, unescape(text)).otherwise(text).alias("text"))
        # Control strings are structure: where one is in a text that is not escaped, this is no turn.
        raw = (F.regexp_extract(piece, TURN, 1) != STAR) & text.rlike(CONTROL)
        return F.when(piece.rlike(TURN) & ~raw, whole)

    return F.transform(pieces, turn)


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss, level, identical.

    loss has, for each turn, start (from the turn's first code point) and length of what is trained on: assistant
    texts. Turns go by turn, then role and text, nulls first; null roles and texts are empty. Repeated rows are
    turns of their own. Rows without conv_id are one conversation, so they must be as few as a conversation's. A
    conversation is one row, so it is in memory at once, texts of any length whole. identical tells that parsing gives the turns
    back; it is true for all. An empty table gives an empty result.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    one = one.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    # Each level is only tried where the one before failed.
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(parse(_render(F.col("turns"), k)).eqNullSafe(F.col("turns")), F.lit(k)).otherwise(level)
    one = one.withColumn("level", level)

    def at(make) -> Column:
        out = make(F.col("turns"), LEVELS - 1)
        for k in reversed(range(LEVELS - 1)):
            out = F.when(F.col("level") == k, make(F.col("turns"), k)).otherwise(out)
        return out

    made = one.withColumn("formatted", at(_render)).withColumn("loss", at(_mask))
    return made.select("conv_id", "formatted", "loss", "level", parse(F.col("formatted")).eqNullSafe(F.col("turns")).alias("identical"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations say: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    pieces = F.split("formatted", END, -1)
    df = formatted.withColumn("turns", parse(F.col("formatted"))).withColumn("pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.zip_with("pieces", "loss", lambda p, m: F.struct(p.startswith(OPEN + STAR).alias("escaped"), F.substring(p, m["start"] + 1, m["length"]).alias("text")))
    df = df.withColumn("under", F.array_join(F.transform(under, lambda x: F.when(x["escaped"], unescape(x["text"])).otherwise(x["text"])), ""))
    return df.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "level", "identical",
    )
