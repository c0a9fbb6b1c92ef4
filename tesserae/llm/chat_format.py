"""Chat transcripts from a declarative template, with a loss flag per segment.

A finite-state machine over roles checks the order of turns: its state is the role of the
last turn, and a table says which roles may follow. A template says what text opens and
closes a turn of a role and which roles carry loss. Every turn gives a segment for its
opening, its text and its closing; the formatted transcript is their concatenation.

Texts and roles are escaped so that no control string can occur in them: a backslash, ``<``
and ``>`` become a backslash and a letter. Every marker of a template must hold a ``<`` or
``>``; then reading back is a split at markers. Both directions are SQL functions only.

A transcript is one row, as its digest covers it whole; ``segments`` gives the same as one
row per segment without gathering a conversation.

Defined cases: a null text is empty, a null role is the role ``""``; turns order by turn
(null first), then role, then text, so ties and repeated rows have one order; a conversation
of unknown roles or wrong order is formatted all the same and marked by ``valid`` and by
``error_turn``, the number from 0 of its first wrong turn; a null conversation id is a
conversation of its own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``open`` holds the place ``{role}``; ``follows`` maps a state to the roles that may come next."""

    open: str = "<turn {role}>\n"
    close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )


CHAT = Template()


def escape(text: Column) -> Column:
    """No ``<`` or ``>`` is left, and a backslash is always followed by b, l or g."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.replace(text, F.lit("<"), F.lit("\\l"))
    return F.replace(text, F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\g"), F.lit(">"))
    text = F.replace(text, F.lit("\\l"), F.lit("<"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def _opening(role: Column, template: Template) -> Column:
    head, tail = template.open.split("{role}")
    return F.concat(F.lit(head), escape(role), F.lit(tail))


def allowed(state: Column, role: Column, template: Template = CHAT) -> Column:
    """Whether ``role`` may follow ``state``; false from a state the table does not have."""
    out = F.lit(False)
    for before, roles in template.follows.items():
        out = out | ((state == before) & role.isin(*roles))
    return out


def _turns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )


def segments(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, turn, number, part, text, loss, allowed): one row per segment in order of ``number`` and ``part``."""
    window = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = _turns(rows).withColumn("number", F.row_number().over(window) - 1)
    turns = turns.withColumn("allowed", allowed(F.lag("role", 1, "").over(window), F.col("role"), template))
    loss = F.col("role").isin(*template.loss_roles)
    parts = F.array(
        F.struct(F.lit(0).alias("part"), _opening(F.col("role"), template).alias("text"), F.lit(False).alias("loss")),
        F.struct(F.lit(1).alias("part"), escape(F.col("text")).alias("text"), loss.alias("loss")),
        F.struct(F.lit(2).alias("part"), F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
    )
    return turns.select("conv_id", "turn", "number", "allowed", F.inline(parts))


def transcripts(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, formatted, loss, valid, error_turn), one row per conversation.

    ``loss`` is an array of (start, length) in characters of ``formatted``, 1-based.
    """
    turns = _turns(rows).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            _opening(t["role"], template).alias("head"),
            escape(t["text"]).alias("body"),
            t["role"].isin(*template.loss_roles).alias("loss"),
        ),
    )
    out = turns.select("conv_id", "turns", pieces.alias("pieces"))
    tail = len(template.close)
    # Where each body starts: a running sum of lengths.
    starts = F.aggregate(
        "pieces",
        F.struct(F.lit(1).cast("bigint").alias("next"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["next"] + F.length(p["head"]) + F.length(p["body"]) + tail).cast("bigint").alias("next"),
            F.when(
                p["loss"],
                F.array_append(
                    acc["spans"],
                    F.struct(
                        (acc["next"] + F.length(p["head"])).cast("bigint").alias("start"),
                        F.length(p["body"]).cast("bigint").alias("length"),
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    checked = F.aggregate(
        "turns",
        F.struct(F.lit("").alias("state"), F.lit(0).alias("number"), F.lit(None).cast("int").alias("wrong")),
        lambda acc, t: F.struct(
            t["role"].alias("state"),
            (acc["number"] + 1).alias("number"),
            F.when(acc["wrong"].isNull() & ~allowed(acc["state"], t["role"], template), acc["number"])
            .otherwise(acc["wrong"])
            .alias("wrong"),
        ),
    )
    body = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(template.close))), "")
    return out.select(
        "conv_id",
        body.alias("formatted"),
        starts["spans"].alias("loss"),
        checked["wrong"].isNull().alias("valid"),
        checked["wrong"].alias("error_turn"),
    )


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """Array of (role, text) read back from a transcript."""
    head, tail = template.open.split("{role}")
    parts = F.split(formatted, _literal(template.close), -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def one(turn: Column) -> Column:
        inner = F.substr(turn, F.lit(len(head) + 1))
        role = F.substring_index(inner, tail, 1)
        return F.struct(
            unescape(role).alias("role"), unescape(F.substr(inner, F.length(role) + len(tail) + 1)).alias("text")
        )

    return F.transform(turns, one)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))), "")


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"
