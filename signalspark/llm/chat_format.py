"""Chat formatting with typed content parts.

A turn's content is an array of parts. The visitor turns them, in order, into one string: text is escaped, an
image, audio or document part becomes a placeholder and is recorded as an attachment with its reference and
the number of tokens that the placeholder stands for. Turns are then marked by the template and joined into
one string per conversation, with the spans that training takes a loss on.

Every mark of the template and every placeholder starts with ``<|``. In texts and roles a backslash is doubled
and ``<|`` becomes ``<\\|``, also where two text parts meet in it, so no content can hold a mark, and reading it
back undoes exactly that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The template's marks, and tokens for each unit (image tile, second of audio, page) of a part.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
TOKENS_A_UNIT = {"image": 256, "audio": 50, "document": 512}
CHARACTERS_A_TOKEN = 4

PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as an array of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def placeholder(part: Column, after: Column) -> Column:
    """What a part becomes in the string: escaped text, or the mark of its type (an unknown type counts as a
    document). Where a text ends in ``<`` and the text ``after`` it starts with ``|``, the sign between goes in here."""
    marks = F.create_map(*[F.lit(x) for pair in PLACEHOLDERS.items() for x in pair])
    text = escaped(part["text"])
    split = part["text"].endswith("<") & F.coalesce((after["type"] == "text") & after["text"].startswith("|"), F.lit(False))
    return F.when(part["type"] == "text", F.when(split, F.concat(text, F.lit("\\"))).otherwise(text)).otherwise(F.coalesce(marks[part["type"]], F.lit(PLACEHOLDERS["document"])))


def content_of(parts: Column) -> Column:
    """All parts of a turn as one string; a text part without text stands for nothing, one of a null type for a document."""
    shown = F.filter(parts, lambda p: (F.coalesce(p["type"], F.lit("")) != "text") | (p["text"] != ""))
    return F.array_join(F.get(F.transform(F.array(shown), lambda own: F.transform(own, lambda p, i: placeholder(p, F.get(own, i + 1)))), F.lit(0)), "")


def expanded(part: Column) -> Column:
    """Tokens that a part stands for; a part without units has one."""
    per = F.create_map(*[F.lit(x) for pair in TOKENS_A_UNIT.items() for x in pair])
    text = F.ceil(F.length(F.coalesce(part["text"], F.lit(""))) / CHARACTERS_A_TOKEN)
    return F.when(part["type"] == "text", text).otherwise(F.coalesce(per[part["type"]], F.lit(TOKENS_A_UNIT["document"])) * F.coalesce(part["units"], F.lit(1))).cast("bigint")


def format_conversations(messages: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``messages``: conv_id, turn, role and parts (an array of :data:`PART`), a row per turn. One row per
    conversation: ``formatted``; ``loss_spans``, the start and end (code points, end exclusive) of each
    non-empty content of a role in ``learned``; ``attachments`` in the order of their placeholders (turn, type,
    ref, tokens); ``n_tokens``, the tokens of all parts.

    Turns stand in the order of ``turn`` (null first), equal ones by role and content; repeated rows are
    repeated turns. A null role or text counts as empty, null parts as none, and rows with a null conv_id as one
    conversation. An empty table gives an empty result; other columns are not read. The rows of one
    conversation meet in one task, since its string is one value; nothing else gathers there, and positions are
    running sums over the sorted rows.
    """
    role = F.coalesce("role", F.lit(""))
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    turns = messages.select(
        "conv_id",
        "turn",
        role.alias("role"),
        escaped(role).alias("mark"),
        content_of(parts).alias("content"),
        F.transform(F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("")) != "text"), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded(p).alias("tokens"))).alias("attachments"),
        F.aggregate(F.transform(parts, expanded), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("tokens"),
    )
    turns = turns.withColumn("head", F.concat(F.lit(START), "mark", F.lit(SEPARATOR))).withColumn("chars", F.length("head") + F.length("content") + len(END))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    placed = turns.select(
        "conv_id",
        "turn",
        F.row_number().over(order).alias("k"),
        F.concat("head", "content", F.lit(END)).alias("piece"),
        (F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("content") - len(END)).alias("start"),
        F.when(F.col("role").isin(*learned), F.length("content")).otherwise(0).alias("loss"),
        "attachments",
        "tokens",
    )
    rows = F.array_sort(F.collect_list(F.struct("k", "turn", "piece", "start", "loss", "attachments")))
    grouped = placed.groupBy("conv_id").agg(rows.alias("rows"), F.sum("tokens").alias("n_tokens"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.transform(F.filter("rows", lambda r: r["loss"] > 0), lambda r: F.struct(r["start"].alias("start"), (r["start"] + r["loss"]).alias("end"))).alias("loss_spans"),
        F.flatten(F.transform("rows", lambda r: F.transform(r["attachments"], lambda a: F.struct(r["turn"].alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        "n_tokens",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns (role and text, unescaped; placeholders stay) and the text under the loss mask, read from the
    string and the spans of :func:`format_conversations`, beside its own columns. An empty string has no turns; an
    empty table gives an empty result; repeated rows are read alike."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda x: x != "")
    turn = lambda x: F.struct(
        unescaped(F.substring_index(x, SEPARATOR, 1)).alias("role"),
        unescaped(F.substring_index(F.substring_index(x, SEPARATOR, -1), END, 1)).alias("text"),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), "")
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", unescaped(loss))


def digests(read: DataFrame) -> DataFrame:
    """The digest columns of a table from :func:`read_back`, a row for each of its rows. Without turns, or without text under
    the mask, the digest is that of the empty text."""
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "n_tokens",
        F.size("attachments").cast("bigint").alias("n_attachments"),
    )
