"""Chat formatting with a grammar round trip, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"  # the role whose texts are under the loss mask

# A control string, with any number of backslashes after its first character.
_CONTROL = r"<(\\*)\|im_(start|end)\|>"
_ESCAPED = r"<\\(\\*)\|im_(start|end)\|>"


def escape(text: Column) -> Column:
    """Control strings get one more backslash after the ``<``; all other text stays."""
    return F.regexp_replace(text, _CONTROL, r"<\\$1|im_$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"<$1|im_$2|>")


def _role_out(role: Column) -> Column:
    one_line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\e")), F.lit("\n"), F.lit("\\n"))
    return F.replace(one_line, F.lit("<"), F.lit("\\l"))


def _role_in(role: Column) -> Column:
    shown = F.replace(F.replace(role, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))
    return F.replace(shown, F.lit("\\e"), F.lit("\\"))


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from formatted text, still escaped.

    The grammar: a conversation is turns; a turn is START, a role, a line break, a text without
    START or END, END and a line break. What is not of this form is read as far as it goes, so
    that the comparison with the source fails.
    """
    pieces = F.split(formatted, r"<\|im_start\|>")
    return F.transform(
        F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            F.substring_index(p, "\n", 1).alias("role"),
            F.regexp_extract(p, r"(?s)^[^\n]*\n(.*?)<\|im_end\|>", 1).alias("text")))


def _rendered(turns: Column, escaped: bool = True) -> Column:
    """Array of (piece, loss): concatenated, the pieces are the formatted conversation."""
    def turn(t):
        body = escape(t["text"]) if escaped else t["text"]
        return F.array(
            F.struct(F.concat(F.lit(START), _role_out(t["role"]), F.lit("\n")).alias("piece"),
                     F.lit(False).alias("loss")),
            F.struct(body.alias("piece"), (t["role"] == LEARNED).alias("loss")),
            F.struct(F.lit(END + "\n").alias("piece"), F.lit(False).alias("loss")))
    return F.flatten(F.transform(turns, turn))


def _joined(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["piece"]), "")


def _read_back(formatted: Column, escaped: bool) -> Column:
    return F.transform(parse(formatted), lambda t: F.struct(
        _role_in(t["role"]).alias("role"),
        (unescape(t["text"]) if escaped else t["text"]).alias("text")))


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``id_col``, formatted, segments, escaped, recovered, identical.

    Conversations are rendered as they are and read back by the parser. Where the turns read back
    differ from the source, because texts hold control strings, those are escaped, and the
    conversation is rendered and read back again. A conversation that holds no control string but
    one with a backslash in it is escaped as well, so that reading back never has to guess.
    ``segments`` are the pieces of ``formatted`` with the loss mask, ``recovered`` the (role, text)
    read back from ``formatted``, and ``identical`` says that they equal the source.

    Rows are ordered by turn (null first), then role and text, so repeated rows and ties have one
    order. Null texts and roles count as empty. Rows with a null id form one conversation. An empty
    table gives no rows; other columns are ignored. A conversation is held by one task, since its
    formatted text is one value.
    """
    rows = turns.select(F.col(id_col).alias("id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    source = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    first = (source.select("id", plain.alias("turns"))
             .withColumn("segments", _rendered(F.col("turns"), escaped=False))
             .withColumn("formatted", _joined(F.col("segments")))
             .withColumn("recovered", _read_back(F.col("formatted"), False))
             .withColumn("escaped", ~(F.col("recovered") == F.col("turns"))
                         | F.exists("turns", lambda t: t["text"].rlike(_ESCAPED))))
    final = (first
             .withColumn("segments", F.when(F.col("escaped"), _rendered(F.col("turns")))
                         .otherwise(F.col("segments")))
             .withColumn("formatted", F.when(F.col("escaped"), _joined(F.col("segments")))
                         .otherwise(F.col("formatted")))
             .withColumn("recovered", F.when(F.col("escaped"), _read_back(F.col("formatted"), True))
                         .otherwise(F.col("recovered"))))
    return final.select(F.col("id").alias(id_col), "formatted", "segments", "escaped", "recovered",
                        (F.col("recovered") == F.col("turns")).alias("identical"))
