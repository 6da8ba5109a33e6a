"""Chat formatting of typed content parts (DataFrame functions only).

A message is an array of parts ``struct(kind, text, uri, units)``: ``text`` carries
words; ``image``, ``audio`` and ``document`` carry a reference and a size in units
(image patches, audio seconds, document pages).  One visitor - a CASE over ``kind``
inside ``transform`` - turns each part into text: escaped words, or an ordered
placeholder ``<image>`` ... whose attachment is recorded with its expanded token count; a
text that such a part has (a caption) follows its placeholder.  A part of any other kind
becomes ``<part:KIND>`` and an attachment of as many tokens as it has units.

Template, one turn:   ``<turn:ROLE>BODY</turn>\\n``
Escaping, reversible: ``\\`` -> ``\\s``, ``<`` -> ``\\l``, and in roles also ``>`` -> ``\\g``.
After it no control string can occur inside a text, since each begins with ``<``.

The loss mask is kept as one run per turn (``chars`` of the turn, ``skip`` before the
body, ``take`` under the mask), so reading it back is linear in the length.

Turns are ordered by ``turn``, then role, then parts (kind, text, reference, size), as they
are before escaping; a null turn comes first.  A null text, role, kind or part is empty (a
part without a kind is text); a null conversation id is a conversation of its own; repeated
rows are repeated turns; extra columns are ignored; an empty table gives no rows.  A
conversation is one row of output, so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "</turn>\n"
#: Tokens that one unit of an attachment expands to.
UNIT_TOKENS = {"image": 1, "audio": 25, "document": 700}
PART = "struct<kind:string,text:string,uri:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def text_part(text: Column) -> Column:
    """A message that is one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("bigint").alias("units")))


def is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def visit(part: Column) -> Column:
    """What one part becomes in the formatted text."""
    said = escape(F.coalesce(part["text"], F.lit("")))
    named = F.when(part["kind"].isin(*UNIT_TOKENS), part["kind"]).otherwise(F.concat(F.lit("part:"), escape_role(part["kind"])))
    return F.when(is_text(part), said).otherwise(F.concat(F.lit("<"), named, F.lit(">"), said))


def expanded(part: Column) -> Column:
    """Tokens that an attachment stands for (0 for text)."""
    per = F.when(is_text(part), F.lit(0)).otherwise(F.lit(1))
    for kind, n in UNIT_TOKENS.items():
        per = F.when(part["kind"] == kind, F.lit(n)).otherwise(per)
    return (F.coalesce(part["units"], F.lit(0)) * per).cast("bigint")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Format rows (conv_id, turn, role, parts), one output row per conversation.

    Returns conv_id, formatted, loss_runs array<struct<chars, skip, take>>, attachments
    array<struct<turn, ord, kind, uri, tokens>> in reading order, n_turns, expanded_tokens.
    """
    parts = F.filter(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    one = turns.select("conv_id", F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), parts.alias("parts")).alias("t"))

    def written(t: Column) -> Column:
        return F.struct(
            F.concat(F.lit("<turn:"), escape_role(t["role"]), F.lit(">")).alias("head"),
            F.array_join(F.transform(t["parts"], visit), "").alias("body"),
            (t["role"] == loss_role).alias("learn"),
            F.transform(
                F.filter(t["parts"], lambda p: ~is_text(p)),
                lambda p, i: F.struct(t["turn"].alias("turn"), i.alias("ord"), p["kind"].alias("kind"), p["uri"].alias("uri"), expanded(p).alias("tokens")),
            ).alias("files"),
        )

    return (
        one.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t")).alias("ts"))
        .select("conv_id", F.transform("ts", written).alias("ws"))
        .select(
            "conv_id",
            F.array_join(F.transform("ws", lambda w: F.concat(w["head"], w["body"], F.lit(END))), "").alias("formatted"),
            F.transform("ws", lambda w: F.struct((F.length(w["head"]) + F.length(w["body"]) + len(END)).alias("chars"), F.length(w["head"]).alias("skip"), F.when(w["learn"], F.length(w["body"])).otherwise(0).alias("take"))).alias("loss_runs"),
            F.flatten(F.transform("ws", lambda w: w["files"])).alias("attachments"),
            F.size("ws").cast("bigint").alias("n_turns"),
        )
        .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]))
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns array<struct<role, text>> and loss_text, parsed from ``formatted`` and ``loss_runs`` alone."""
    pieces = F.slice(F.split("formatted", F.lit("</turn>\n")), 1, F.size("loss_runs"))
    return (
        formatted.withColumn("pieces", pieces)
        .withColumn(
            "turns",
            F.transform(
                "pieces",
                lambda p: F.struct(
                    unescape_role(F.substring_index(F.substring(p, len("<turn:") + 1, 1 << 30), ">", 1)).alias("role"),
                    unescape(F.substring(p, F.instr(p, ">") + 1, F.length(p))).alias("text"),
                ),
            ),
        )
        .withColumn(
            "loss_text",
            F.array_join(F.transform(F.arrays_zip("pieces", "loss_runs"), lambda z: unescape(F.substring(z["pieces"], z["loss_runs"]["skip"] + 1, z["loss_runs"]["take"]))), ""),
        )
        .drop("pieces")
    )


def probe_conversation(spark: SparkSession) -> DataFrame:
    """A conversation whose texts hold control strings."""
    said = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")


def formatted_digests(conversations: DataFrame) -> DataFrame:
    """The digests of what :func:`read_back` finds, per conversation of (conv_id, turn, role, text)."""
    parts = conversations.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    back = read_back(format_chats(parts))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def illustrated(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, parts): each text with a part of another kind, by turn."""
    kind = F.element_at(F.array(*(F.lit(k) for k in ("image", "audio", "document", "video"))), (F.pmod(F.coalesce("turn", F.lit(0)), F.lit(4)) + 1).cast("int"))
    part = F.struct(kind.alias("kind"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("store/"), F.col("conv_id").cast("string")).alias("uri"), (F.coalesce("turn", F.lit(0)) + 1).cast("bigint").alias("units"))
    return conversations.select("conv_id", "turn", "role", F.concat(text_part(F.col("text")), F.array(part)).alias("parts"))


def part_digests(turns: DataFrame) -> DataFrame:
    """What :func:`format_chats` makes of typed parts, per conversation: digest of the text, attachments, expanded tokens."""
    out = format_chats(turns)
    listed = F.array_join(F.transform("attachments", lambda a: F.concat_ws(" ", a["turn"], a["ord"], a["kind"], a["uri"], a["tokens"])), "\n")
    return out.select("conv_id", F.sha2(F.col("formatted").cast("binary"), 256).alias("formatted_sha256"), F.size("attachments").cast("bigint").alias("n_attachments"), "expanded_tokens", F.sha2(listed.cast("binary"), 256).alias("attachments_sha256"))
