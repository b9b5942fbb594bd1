"""Chat formatting with typed content parts, in DataFrame functions alone.

A turn's content is an ordered list of parts: text, image, audio or document.
The visitor flattens them: a text is escaped, any other part becomes a
placeholder `<|image|>`, `<|audio|>` or `<|document|>`, its reference is
recorded as an attachment in the same order, and its expanded token count is
computed from its size. Turns are marked
`<|im_start|>role<|im_sep|>content<|im_end|>` and a line feed.

Escaping is reversible: `\\` becomes `\\\\`, then `|` becomes `\\|`. Every bar of a
text is escaped, so no text or role can hold a control string, nor can parts
that stand next to each other form one. Reading back splits at the control
strings and undoes both in one pass from left to right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
KINDS = ("image", "audio", "document")
PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens of a part: one for each image patch of this many pixels a side, for each second of audio, for each page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def text_part(text: Column) -> Column:
    """A content of one text part; null text is empty."""
    none = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages")))


def expanded_tokens(part: Column) -> Column:
    """Tokens that a non-text part stands for; at least one."""
    side = lambda x: F.ceil(F.coalesce(x, F.lit(0)) / PATCH)
    count = F.when(part["type"] == "image", side(part["width"]) * side(part["height"])).when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND)).otherwise(F.coalesce(part["pages"], F.lit(0)) * PER_PAGE)
    return F.greatest(count.cast("long"), F.lit(1))


def visit(parts: Column) -> Column:
    """The parts as one string: texts escaped, others as placeholders; a part of another type is text."""
    one = lambda p: F.when(p["type"].isin(*KINDS), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))
    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>")), one), "")


def attachments(parts: Column) -> Column:
    """The non-text parts in order: kind, reference and expanded tokens."""
    held = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>")), lambda p: F.coalesce(p["type"].isin(*KINDS), F.lit(False)))
    return F.transform(held, lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))


def format_chat(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (start and length of each span under the loss mask), attachments and expanded_tokens.

    turns has conv_id, turn, role and parts. Turns stand in order of turn, null
    first; equal turns by role, then content. A null role is empty. The loss
    mask covers the content of each turn with a role in trained. Repeated rows
    are repeated turns. A null conv_id is a conversation. An empty table gives
    no rows; other columns are ignored.
    """
    body = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), visit(F.col("parts")).alias("body"), attachments(F.col("parts")).alias("attached")).alias("t"))
    grouped = body.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["body"].alias("body"), t["role"].isin(*trained).alias("on")))
    tail = len(END) + 1
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        span = F.struct(start.alias("start"), F.length(p["body"]).alias("chars"))
        return F.struct((start + F.length(p["body"]) + tail).alias("at"), F.when(p["on"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    out = grouped.withColumn("pieces", pieces)
    return out.select("conv_id", whole.alias("formatted"), F.aggregate("pieces", zero, step)["spans"].alias("loss"), F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments")).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation, as role and text, unescaped; placeholders stay as they are."""
    found = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: F.length(x) > 0)

    def turn(x: Column) -> Column:
        sep = F.instr(x, SEP)
        body = F.substring(x, sep + len(SEP), F.length(x) - sep - len(SEP) + 1 - len(END) - 1)
        return F.struct(unescape(F.substring(x, F.lit(1), sep - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(found, turn)


def chat_digest(turns: DataFrame) -> DataFrame:
    """What reading back the formatted conversations gives: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, expanded_tokens."""
    out = format_chat(turns)
    back = out.withColumn("back", read_chat(F.col("formatted"))).withColumn("taught", F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["chars"]))), ""))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("taught").cast("long").alias("loss_chars"), F.sha2(F.col("taught").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "expanded_tokens")
