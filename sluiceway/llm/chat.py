"""Chat formatting with column expressions only.

Every turn is a list of typed parts. A visitor flattens them, in order, into one
text with a placeholder for each attachment, and records the attachments and the
tokens they expand to. A template joins the turns of a conversation; control
strings inside texts are escaped so that reading back gives the same texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the template, and strings that chat templates give a meaning
OPEN, CLOSE = "<|turn|>", "<|end|>"
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]")

# kinds of attachments, each with the letter that stands for it while a turn is escaped; any
# other kind is unknown
KINDS = {"image": "i", "audio": "a", "document": "d", "unknown": "u"}
_PLACEHOLDER = r"<\|(" + "|".join(KINDS) + r")\|>"

PART = "struct<kind: string, text: string, ref: string, amount: double, width: int, height: int>"

# tokens of attachments: pixels of a side that make an image token, audio tokens per
# second, document tokens per page
PATCH = 28
PER_SECOND = 25
PER_PAGE = 500


def escape(text: Column) -> Column:
    """Backslashes doubled, and one put after the first character of each control string.

    Runs of backslashes that come from the text are even afterwards, so an odd one marks
    an escape and nothing is ambiguous.
    """
    return _escape_controls(_double(text))


def _double(text: Column) -> Column:
    return F.replace(text, F.lit("\\"), F.lit("\\\\"))


def _escape_controls(text: Column) -> Column:
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescape(text: Column) -> Column:
    for control in CONTROLS:
        text = F.replace(text, F.lit(control[0] + "\\" + control[1:]), F.lit(control))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """A role is one line: percent signs, line feeds and control strings in percent form."""
    out = F.replace(role, F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("%0A")), F.lit("<|"), F.lit("%3C|"))


def unescape_role(role: Column) -> Column:
    out = F.replace(F.replace(role, F.lit("%3C|"), F.lit("<|")), F.lit("%0A"), F.lit("\n"))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def text_part(text: Column) -> Column:
    """A list of one text part."""
    nothing = {"ref": "string", "amount": "double", "width": "int", "height": "int"}
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            text.alias("text"),
            *(F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()),
        )
    )


def part_tokens(part: Column) -> Column:
    """Tokens that an attachment expands to; text parts have none of their own here."""
    width, height = F.coalesce(part["width"], F.lit(0)), F.coalesce(part["height"], F.lit(0))
    amount = F.coalesce(part["amount"], F.lit(0.0))
    return (
        F.when(part["kind"] == "image", F.ceil(width / PATCH) * F.ceil(height / PATCH))
        .when(part["kind"] == "audio", F.ceil(amount * PER_SECOND))
        .when(part["kind"] == "document", F.ceil(amount * PER_PAGE))
        .otherwise(F.lit(0))
        .cast("long")
    )


def _kind(part: Column) -> Column:
    """The kind of a part; what is none of KINDS or text is unknown."""
    return F.when(part["kind"].isin("text", *KINDS), part["kind"]).otherwise(F.lit("unknown"))


def _visit(part: Column) -> Column:
    """A text with backslashes doubled, or a backslash and the letter of an attachment's kind."""
    letters = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return F.when(_kind(part) == "text", _double(F.coalesce(part["text"], F.lit("")))).otherwise(
        F.concat(F.lit("\\"), letters[_kind(part)])
    )


def flatten_parts(parts: Column) -> Column:
    """The escaped text of a turn, a placeholder ``<|kind|>`` where an attachment stands.

    Control strings are escaped in the joined text, so that neighbouring parts cannot make one. Until then an
    attachment is an odd run of backslashes before its letter, which no text can be.
    """
    joined = _escape_controls(
        F.array_join(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), _visit), "")
    )
    for kind, letter in KINDS.items():
        joined = F.regexp_replace(joined, rf"(?<!\\)((?:\\\\)*+)\\{letter}", f"$1<|{kind}|>")
    return joined


def attachments(parts: Column) -> Column:
    """Structs ``place`` (from 0), ``kind``, ``ref``, ``tokens`` of the attachments of a turn, in order."""
    marked = F.transform(
        F.coalesce(parts, F.array().cast(f"array<{PART}>")),
        lambda p, i: F.struct(
            i.alias("place"), _kind(p).alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")
        ),
    )
    return F.filter(marked, lambda p: p["kind"] != "text")


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """``conv_id``, ``formatted``, ``loss_mask``, ``attachments``, ``expanded_tokens``.

    One row per conversation, its turns in the order of ``turn_col`` (nulls first, ties
    by role, then by text). ``loss_mask`` has a struct ``start``, ``stop`` for each
    turn of a loss role: code points of its text in ``formatted``, end exclusive.
    Null roles and texts are empty. Repeated rows are repeated turns. Rows without
    a conversation id form one conversation. Attachments carry the number of
    their turn.

    A conversation is one row of the output, so its turns meet in one task; only they do.
    """
    row = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        flatten_parts(F.col(parts_col)).alias("text"),
        attachments(F.col(parts_col)).alias("files"),
    ).withColumn("head", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")))
    # where each turn begins in its conversation: a running sum, so that the spans need no fold
    size = F.length("head") + F.length("text") + len(CLOSE) + 1
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "files").rowsBetween(
        Window.unboundedPreceding, -1
    )
    begins = F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0).cast("long"))
    starts = begins + F.length("head")
    shaped = row.withColumn("at", begins).withColumn("start", starts).select(
        "conv_id",
        F.struct(
            "at",
            F.concat("head", "text", F.lit(CLOSE), F.lit("\n")).alias("whole"),
            F.col("role").isin(*loss_roles).alias("loss"),
            "start",
            (F.col("start") + F.length("text")).alias("stop"),
            "files",
        ).alias("turn"),
    )
    framed = shaped.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    spans = F.transform(
        F.filter("turns", lambda t: t["loss"]),
        lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop")),
    )
    files = F.flatten(
        F.transform(
            "turns",
            lambda t, i: F.transform(
                t["files"],
                lambda f: F.struct(
                    i.alias("turn"), f["place"].alias("place"), f["kind"].alias("kind"),
                    f["ref"].alias("ref"), f["tokens"].alias("tokens"),
                ),
            ),
        )
    )
    return framed.select(
        "conv_id",
        F.array_join("turns.whole", "").alias("formatted"),
        spans.alias("loss_mask"),
        files.alias("attachments"),
    ).withColumn(
        "expanded_tokens",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, f: n + f["tokens"]),
    )


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """``formatted`` read back: adds ``turns``, an array of structs ``role``, ``text``, ``parts``, and ``loss_texts``.

    Texts are unescaped. ``text`` has placeholders of attachments as they are, ``parts`` tells them from text that looks
    the same: structs ``kind``, ``text`` in order, where text parts that stood side by side are one, and empty ones none.
    """
    # a turn's opening string is never part of an escaped text
    chunks = F.slice(F.split("formatted", r"<\|turn\|>", -1), 2, 1 << 30)
    head = lambda c: F.substring_index(c, "\n", 1)
    body = lambda c: F.substring(
        c, F.length(head(c)) + 2, F.length(c) - F.length(head(c)) - 2 - len(CLOSE)
    )
    nothing = F.lit(None).cast("string")
    part = lambda kind, text: F.struct(kind.alias("kind"), text.alias("text"))

    def parts(text: Column) -> Column:
        kinds = F.regexp_extract_all(text, F.lit(_PLACEHOLDER), F.lit(1))
        pieces = F.transform(
            F.split(text, _PLACEHOLDER, -1),
            lambda piece, i: F.array(part(F.lit("text"), unescape(piece)), part(F.get(kinds, i), nothing)),
        )
        return F.filter(F.flatten(pieces), lambda p: p["kind"].isNotNull() & ~p["text"].eqNullSafe(""))

    turns = F.transform(
        chunks,
        lambda c: F.struct(
            unescape_role(head(c)).alias("role"), unescape(body(c)).alias("text"), parts(body(c)).alias("parts")
        ),
    )
    masked = F.transform(
        "loss_mask",
        lambda s: unescape(
            F.substring(
                F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")
            )
        ),
    )
    return formatted.withColumn("turns", turns).withColumn("loss_texts", masked)
