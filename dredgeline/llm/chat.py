"""Chat formatting with a grammar round trip, in built-in functions only.

Grammar of a rendered conversation (turns in order)::

    conversation := turn*
    turn         := "<s>" form role "\\n" text "</s>\\n"
    form         := "=" (role and text as they are) | "~" (role and text escaped)

A turn is first rendered as it is. The parser cuts the rendering at the control strings and the
recovered turns are compared with the source; a turn that contains what the parser would cut at is
escaped, and if the whole still does not come back the same, every turn is. The escape puts a mark
in front of itself and into each control string, so it is undone exactly and no control string is
left in the text. Only turns in conflict change; all others stay as people wrote them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END, MARK = "<s>", "</s>", "\\"
PLAIN, ESCAPED = "=", "~"
LEARNED = "assistant"


def escape(x: Column) -> Column:
    """Doubles every mark and puts one into each control string, so that none is left."""
    x = F.replace(x, F.lit(MARK), F.lit(MARK * 2))
    for c in (TURN, END):
        x = F.replace(x, F.lit(c), F.lit(c[0] + MARK + c[1:]))
    return x


def _undo(p: Column) -> Column:
    for c in (TURN, END):
        p = F.replace(p, F.lit(c[0] + MARK + c[1:]), F.lit(c))
    return p


def unescape(x: Column) -> Column:
    # Pairs of marks are set aside first: a mark that is left stands in a control string.
    return F.array_join(F.transform(F.split(x, r"\\\\", -1), _undo), MARK)


def _role(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit(MARK + "n"))


def _unrole(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, r"\\\\", -1), lambda p: _undo(F.replace(p, F.lit(MARK + "n"), F.lit("\n")))), MARK)


def render(turns: Column, escaped: Column | None = None) -> Column:
    """One string from an array of (role, text); ``escaped`` is an array of booleans of the same length."""

    def one(t: Column, e: Column) -> Column:
        return F.concat(F.lit(TURN), F.when(e, F.concat(F.lit(ESCAPED), _role(t["role"]), F.lit("\n"), escape(t["text"]))).otherwise(F.concat(F.lit(PLAIN), t["role"], F.lit("\n"), t["text"])), F.lit(END + "\n"))

    body = F.transform(turns, lambda t: one(t, F.lit(False))) if escaped is None else F.zip_with(turns, escaped, one)
    return F.array_join(body, "")


def parse(rendered: Column) -> Column:
    """Array of (role, text, first, size) of a rendering: first and size are the place of the written text, from 1."""
    pieces = F.transform(F.filter(F.split(rendered, TURN, -1), lambda p, i: i > 0), lambda p: F.struct(
        F.substring_index(p, "\n", 1).alias("head"), F.length(p).alias("size"), p.alias("all")))

    def turn(p: Column, before: Column) -> Column:
        first = F.length(p["head"]) + 1  # of the written text in the piece
        written = F.substring_index(F.substr(p["all"], first + 1), END, 1)
        role = F.substr(p["head"], F.lit(2))
        plain = F.startswith(p["head"], F.lit(PLAIN))
        return F.struct(
            F.when(plain, role).otherwise(_unrole(role)).alias("role"), F.when(plain, written).otherwise(unescape(written)).alias("text"),
            (before + first + 1).alias("first"), F.length(written).alias("size"), (~plain).alias("escaped"),
        )

    # The pieces' places: running sums of their sizes.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    places = F.aggregate(F.transform(pieces, lambda p: p["size"]), start, lambda a, n: F.struct((a["at"] + len(TURN) + n).alias("at"), F.concat(a["all"], F.array(a["at"] + len(TURN))).alias("all")), lambda a: a["all"])
    return F.zip_with(pieces, places, turn)


def _same(parsed: Column, turns: Column) -> Column:
    return F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == turns


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, parsed, mask and attempts of every conversation.

    ``turns`` has conv_id, turn, role and text. ``parsed`` is what the parser reads back from
    ``formatted`` and equals the source: null roles and texts count as empty, rows go by turn (null
    first), rows of one turn by role and text, so repeated rows are repeated turns. Rows with a null
    conv_id form one conversation. ``mask`` has the places (first, size; from 1, in code points) of
    the assistant's written texts. ``attempts`` tells how many renderings were needed. An empty
    table gives an empty table; other columns are ignored.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # A conversation is one rendered string, so its turns meet in one row; nothing else is gathered.
    source = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    source = source.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    first = source.withColumn("r0", render(F.col("turns"))).withColumn("ok0", _same(parse(F.col("r0")), F.col("turns")))
    conflicts = F.transform("turns", lambda t: ~_same(parse(render(F.array(t))), F.array(t)))
    second = first.withColumn("r1", F.when(~F.col("ok0"), render(F.col("turns"), conflicts)))
    second = second.withColumn("ok1", F.col("ok0") | _same(parse(F.col("r1")), F.col("turns")))
    third = second.withColumn("r2", F.when(~F.col("ok1"), render(F.col("turns"), F.transform("turns", lambda t: F.lit(True)))))
    out = third.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.when(F.col("ok0"), F.col("r0")).when(F.col("ok1"), F.col("r1")).otherwise(F.col("r2")).alias("formatted"), F.when(F.col("ok0"), 1).when(F.col("ok1"), 2).otherwise(3).alias("attempts"))
    out = out.withColumn("parsed", parse(F.col("formatted")))
    mask = F.transform(F.filter("parsed", lambda t: t["role"] == LEARNED), lambda t: F.struct(t["first"].alias("first"), t["size"].alias("size"), t["escaped"].alias("escaped")))
    return out.withColumn("mask", mask)


def chat_report(turns: DataFrame) -> DataFrame:
    """Digests of every formatted conversation, all read back from the rendering."""
    read = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")

    def under(m: Column) -> Column:
        written = F.substr(F.col("formatted"), m["first"], m["size"])
        return F.when(m["escaped"], unescape(written)).otherwise(written)

    loss = F.array_join(F.transform("mask", under), "")
    return format_conversations(turns).withColumn("loss", loss).select(
        "conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(read, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
