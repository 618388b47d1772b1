"""Chat formatting with typed content parts.

A message holds an array of parts.  A visitor flattens them in order: text is
escaped, an image, audio or document part becomes a placeholder, and its
reference and expanded token count are recorded.  Control strings inside texts
are escaped reversibly, so the formatted string can be read back.
DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchline.llm.common import let

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
# Strings with a meaning in this or other common templates.
CONTROL = (OPEN, CLOSE, *PLACEHOLDER.values(), "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_REST = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))

#: One content part; fields that a type does not use are null.
PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """One backslash more behind the first character of each control string,
    however many stand there already; nothing else changes."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({_REST})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_REST})", "$1$2$3")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    pieces = F.split(role, r"\\\\", -1)  # at doubled backslashes, which stand for one
    return unescape(F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\"))


def text_part(text: Column) -> Column:
    none = lambda t: F.lit(None).cast(t)
    return F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), none("string").alias("uri"), none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages"))


def part_tokens(part: Column, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 256) -> Column:
    """Tokens that a placeholder stands for once expanded; 0 for text and unknown sizes."""
    size = F.when(part["type"] == "image", F.ceil(part["width"] / F.lit(patch)) * F.ceil(part["height"] / F.lit(patch)))
    size = size.when(part["type"] == "audio", F.ceil(part["seconds"] * F.lit(audio_rate))).when(part["type"] == "document", part["pages"] * F.lit(page_tokens))
    return F.coalesce(size, F.lit(0)).cast("long")


def visit(parts: Column) -> Column:
    """struct<body, attachments>: a message's parts flattened in order.

    Parts of an unknown type are kept as escaped text; null parts and null
    texts are empty.  Texts without a placeholder between them are escaped as one.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    mark = F.create_map(*(F.lit(x) for kv in PLACEHOLDER.items() for x in kv))

    def flat(p: Column) -> Column:
        media = lambda x: F.coalesce(x["type"].isin(*PLACEHOLDER), F.lit(False))
        at = F.filter(F.transform(p, lambda x, i: F.when(media(x), i)), lambda i: i.isNotNull())

        def between(borders: Column) -> Column:
            # texts that stand side by side are one text before anything is escaped
            text = lambda i, j: F.array_join(F.transform(F.slice(p, i + 2, j - i - 1), lambda x: F.coalesce(x["text"], F.lit(""))), "")
            last = F.size(borders) - 1
            piece = lambda b, i: F.when(i < last, F.concat(escape(text(b, F.get(borders, i + 1))), F.coalesce(F.try_element_at(mark, F.get(p, F.get(borders, i + 1))["type"]), F.lit(""))))
            return F.array_join(F.transform(borders, piece), "")

        body = let(F.concat(F.array(F.lit(-1)), at, F.array(F.size(p))), between)
        return F.struct(body.alias("body"), F.transform(F.filter(p, media), lambda x: F.struct(x["type"].alias("type"), x["uri"].alias("uri"), part_tokens(x).alias("tokens"))).alias("attachments"))

    return let(parts, flat)


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``(conv_id, formatted, loss_spans, attachments, expanded_tokens)`` by conversation.

    Rows are ordered by turn, null turns first, equal turns by role and body.
    ``loss_spans`` are [start, end) code points of the trained roles' bodies;
    ``attachments`` are numbered in the order of their placeholders.  A null
    role is empty; an empty table gives no rows.
    """
    seen = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), visit(F.col(parts)).alias("v"))
    head = F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n"))
    rows = seen.select("conv_id", "turn", "role", "v.body", "v.attachments", head.alias("head"), F.length(head).cast("long").alias("h"), F.length("v.body").cast("long").alias("n"))
    # one shuffle by conversation serves the running length, the order and the gathering
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body", F.to_json("attachments"))
    before = F.sum(F.col("h") + F.col("n") + len(CLOSE) + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n") - len(CLOSE) - 1
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("start", before)
    message = F.struct("at", "start", (F.col("start") + F.col("n")).alias("end"), F.col("role").isin(*trained).alias("loss"), F.concat("head", "body", F.lit(CLOSE + "\n")).alias("whole"), "attachments")
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    attached = F.flatten(F.transform("m", lambda m: m["attachments"]))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("m", lambda m: m["whole"]), "").alias("formatted"),
        F.transform(F.filter("m", lambda m: m["loss"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias("loss_spans"),
        F.transform(attached, lambda a, i: F.struct(i.alias("ordinal"), a["type"].alias("type"), a["uri"].alias("uri"), a["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns`` (role, text) and ``loss_text``, parsed from ``formatted``."""
    pieces = F.split("formatted", re.escape(OPEN).replace("<", r"\<").replace(">", r"\>"))
    pieces = F.filter(pieces, lambda p: p != "")

    def turn(p: Column) -> Column:
        cut = F.locate("\n", p)
        body = F.substring(p, cut + 1, F.length(p) - cut - len(CLOSE) - 1)
        return F.struct(_unescape_role(F.substring(p, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    # four bytes a code point, so that a span is found without counting from the start
    part = lambda b, s: F.decode(F.substring(b, (4 * s["start"] + 1).cast("int"), (4 * (s["end"] - s["start"])).cast("int")), "UTF-32")
    loss = let(F.encode("formatted", "UTF-32"), lambda b: F.transform("loss_spans", lambda s: unescape(part(b, s))))
    return chats.select("*", F.transform(pieces, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"))
