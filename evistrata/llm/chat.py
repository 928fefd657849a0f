"""Chat formatting of turns made of typed content parts.

A turn is an ordered list of parts.  Each kind of part has a visitor, a function of the part
that returns the text it leaves in the turn and the attachment it records:

* ``text`` leaves its text, escaped;
* ``image``, ``audio`` and ``document`` leave one placeholder each and record the reference
  and the number of tokens the placeholder expands to;
* any other kind leaves nothing and is counted in ``n_unknown_parts``.

Turns are marked by control strings.  A text cannot forge one: each ``<``, backslashes, ``|``
gets one more backslash, so that ``<|`` occurs in the output only where the template put it;
taking one backslash away restores the text exactly.

Everything is a Column expression.  A conversation is by definition one output row; its turns
meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>\n", "<|newline|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class Expansion:
    """How many tokens a placeholder stands for."""

    image_patch: int = 28
    audio_per_second: int = 25
    document_per_page: int = 576


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role ends at its line's end, so its own line ends become a control string."""
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A list of one text part."""
    part = F.struct(
        F.lit("text"), text, F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int"),
        F.lit(None).cast("double"), F.lit(None).cast("int"),
    )
    return F.array(part.cast(PART))


def _patches(side: Column, patch: int) -> Column:
    return F.ceil(F.greatest(F.coalesce(side, F.lit(0)), F.lit(0)) / F.lit(patch))


def _visitors(part: Column, expansion: Expansion) -> dict[str, tuple[Column, Column | None]]:
    """Per kind: the text left in the turn, and the tokens of its placeholder."""
    image = _patches(part["width"], expansion.image_patch) * _patches(part["height"], expansion.image_patch)
    audio = F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * expansion.audio_per_second)
    document = F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(0)) * expansion.document_per_page
    return {
        "text": (escape(F.coalesce(part["text"], F.lit(""))), None),
        "image": (F.lit("<|image|>"), image),
        "audio": (F.lit("<|audio|>"), audio),
        "document": (F.lit("<|document|>"), document),
    }


def visit(part: Column, expansion: Expansion) -> Column:
    """The piece of text and the attachment (null for none) of one part."""
    piece, tokens = F.lit(""), F.lit(None).cast("long")
    visitors = _visitors(part, expansion)
    for kind, (text, count) in visitors.items():
        piece = F.when(part["kind"] == kind, text).otherwise(piece)
        if count is not None:
            tokens = F.when(part["kind"] == kind, count.cast("long")).otherwise(tokens)
    attachment = F.when(
        tokens.isNotNull(), F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))
    )
    unknown = ~F.coalesce(part["kind"].isin(*visitors), F.lit(False))
    return F.struct(piece.alias("piece"), attachment.alias("attachment"), unknown.alias("unknown"))


def format_conversations(turns: DataFrame, expansion: Expansion | None = None, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``parts`` (array of :data:`PART`).
    Returns ``conv_id``, ``n_turns``, ``formatted``, ``turns`` (per turn, in code points of
    ``formatted``: ``start``, ``text_start``, ``text_end``, and ``loss``, whether the text is
    trained on), ``attachments`` (``turn_index``, ``kind``, ``ref``, ``tokens`` in order of
    their placeholders), ``attachment_tokens`` and ``n_unknown_parts``.

    Turns go by ``turn``; equal numbers go by role, then content, nulls first.  A null role is
    an empty one, a null or empty ``parts`` an empty text; repeated rows are repeated turns.
    """
    expansion = expansion or Expansion()
    role = escape_role(F.coalesce(F.col("role"), F.lit("")))
    visited = F.transform(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")), lambda p: visit(p, expansion))
    lines = (
        turns.select("conv_id", "turn", role.alias("role"), visited.alias("visited"))
        .select(
            "conv_id",
            "turn",
            "role",
            F.array_join(F.col("visited.piece"), "").alias("content"),
            F.filter(F.col("visited.attachment"), lambda a: a.isNotNull()).alias("attached"),
            F.size(F.filter(F.col("visited.unknown"), lambda u: u)).alias("unknown"),
        )
    )
    head = F.length(F.lit(START)) + F.length("role") + 1
    along = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    whole = (head + F.length("content") + F.length(F.lit(END))).cast("long")
    placed = lines.withColumn("number", F.row_number().over(along)).withColumn(
        "start", F.sum(whole).over(along.rowsBetween(Window.unboundedPreceding, 0)) - whole
    )
    record = F.struct(
        "number",
        F.concat(F.lit(START), "role", F.lit("\n"), "content", F.lit(END)).alias("marked"),
        F.struct(
            F.col("start").alias("start"),
            (F.col("start") + head).alias("text_start"),
            (F.col("start") + head + F.length("content")).alias("text_end"),
            F.col("role").isin(*trained_roles).alias("loss"),
        ).alias("span"),
        F.transform(
            "attached", lambda a: F.struct(F.col("number").alias("turn_index"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))
        ).alias("attached"),
        "unknown",
    )
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(record)).alias("all"))
    return grouped.select(
        "conv_id",
        F.size("all").cast("long").alias("n_turns"),
        F.array_join(F.col("all.marked"), "").alias("formatted"),
        F.col("all.span").alias("turns"),
        F.flatten(F.col("all.attached")).alias("attachments"),
        F.aggregate(F.flatten(F.col("all.attached")), F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"),
        F.aggregate(F.col("all.unknown"), F.lit(0).cast("long"), lambda s, u: s + u).alias("n_unknown_parts"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` again: adds ``parsed``, an array of ``role``, ``text`` (unescaped;
    placeholders stay) and ``loss_text`` (the unescaped text under the loss mask, null outside).
    """
    marked = F.slice(F.split("formatted", r"<\|im_end\|>\n", -1), F.lit(1), F.col("n_turns").cast("int"))

    def parse(segment: Column, span: Column) -> Column:
        body = F.substring(segment, F.lit(len(START) + 1), F.length(segment))
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        masked = F.substring(segment, (span["text_start"] - span["start"] + 1).cast("int"), (span["text_end"] - span["text_start"]).cast("int"))
        return F.struct(
            unescape_role(role).alias("role"), unescape(text).alias("text"), F.when(span["loss"], unescape(masked)).alias("loss_text")
        )

    return formatted.withColumn("parsed", F.zip_with(marked, "turns", parse))
