r"""Chat formatting with typed content parts, in DataFrame functions only.

Messages are rows (conversation, turn, role, parts); a part is a struct (type, text, ref, tokens) with type
text, image, audio or document. The visitor flattens a turn's parts in order: text is escaped, any other part
becomes a numbered placeholder `<|type:k|>`, its reference is recorded as an attachment and its token count is
what the placeholder expands to. A turn is written

    <|turn|>role\n body <|end|>\n        (without the blanks)

Escapes keep control strings out of texts: `\` is written `\\` and `<|` is written `<\|`, also where one part ends in `<` and
the next begins with `|`; in types every `|` is escaped. So `<|` in the output always starts a control string, whatever parts, types and
roles hold, and reading back takes the escapes off again. Line feeds of a role are written `<|nl|>`. The loss mask is an array of spans in code
points, one for each assistant body, with the number of its turn and where it starts in it.

Work is linear in the turns of a conversation, written and read; within one turn it grows with parts times the body's length.

Defined results: a null text or role counts as empty; null turns come first; equal turns are ordered by role
and parts; equal rows all stay; a null conversation id is one conversation; no rows give no rows; further
columns are ignored. A part of unknown type is treated as an attachment of that type; a null type means text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
PART = "struct<type:string,text:string,ref:string,tokens:int>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_type(kind: Column) -> Column:
    """A type inside a placeholder, which it can't end."""
    return F.replace(F.replace(kind, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("tokens")))


def _is_text(p: Column) -> Column:
    return F.coalesce(p["type"], F.lit("text")) == "text"


def formatted(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans (start, length, turn, offset), attachments and n_extra_tokens.

    messages: conv_id, turn, role, parts (array of PART). attachments: (place, type, ref, tokens, start),
    numbered through the conversation, with the code point where the placeholder starts in its turn's body. Numbers
    and offsets are running sums over the turns, which lie together for the collecting anyway.
    """
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts"))
    turns = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = turns.rowsBetween(Window.unboundedPreceding, -1)
    attached = F.size(F.filter("parts", lambda p: ~_is_text(p)))
    rows = rows.withColumns({"i": F.row_number().over(turns), "first": F.coalesce(F.sum(attached).over(before), F.lit(0)).cast("int")})
    begin = F.struct(F.lit("").alias("body"), F.col("first").alias("k"), F.array().cast("array<struct<place:int,type:string,ref:string,tokens:int,start:int>>").alias("found"))

    def part(acc, p):
        kind = F.coalesce(p["type"], F.lit("text"))
        mark = F.concat(F.lit("<|"), escaped_type(kind), F.lit(":"), acc["k"].cast("string"), F.lit("|>"))
        one = F.struct(acc["k"].alias("place"), kind.alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens"), F.char_length(acc["body"]).alias("start"))
        # Two parts must not make a control string that neither of them holds.
        apart = F.when(F.endswith(acc["body"], F.lit("<")) & F.startswith(p["text"], F.lit("|")), "\\").otherwise("")
        return F.struct(
            F.concat(acc["body"], F.when(_is_text(p), F.concat(F.coalesce(apart, F.lit("")), escaped(p["text"]))).otherwise(mark)).alias("body"),
            F.when(_is_text(p), acc["k"]).otherwise(acc["k"] + 1).alias("k"),
            F.when(_is_text(p), acc["found"]).otherwise(F.concat(acc["found"], F.array(one))).alias("found"),
        )

    # One text part is the common case and needs no accumulator.
    only = F.get("parts", F.lit(0))
    alone = (F.size("parts") == 1) & _is_text(only)
    seen = F.when(alone, F.struct(escaped(only["text"]).alias("body"), F.col("first").alias("k"), begin["found"].alias("found"))).otherwise(F.aggregate("parts", begin, part))
    head = F.concat(F.lit(TURN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("<|nl|>")), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", "parts", "i", head.alias("head"), seen.alias("seen"))
    size = F.char_length("head") + F.char_length("seen.body") + len(END)
    rows = rows.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int"))
    span = F.when(F.col("role").isin(*loss_roles), F.struct((F.col("at") + F.char_length("head")).alias("start"), F.char_length("seen.body").alias("length"), F.col("i").alias("turn"), F.char_length("head").alias("offset")))
    pieces = rows.select("conv_id", F.struct("i", F.concat("head", "seen.body", F.lit(END)).alias("piece"), span.alias("span"), F.col("seen.found").alias("found")).alias("t"))
    chats = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    attachments = F.flatten(F.col("t.found"))
    return chats.select(
        "conv_id",
        F.array_join("t.piece", "").alias("formatted"),
        F.filter("t.span", lambda s: s.isNotNull()).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda acc, x: acc + x["tokens"]).alias("n_extra_tokens"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """chats with turns (role, body, text) parsed from `formatted`, and loss_text: the unescaped text under the mask."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda x: x != "")

    def turn(x: Column) -> Column:
        cut = F.instr(x, "\n")
        role = unescaped(F.replace(F.substring(x, F.lit(len(TURN) + 1), cut - len(TURN) - 1), F.lit("<|nl|>"), F.lit("\n")))
        body = F.substring(x, cut + 1, F.char_length(x))
        return F.struct(role.alias("role"), body.alias("body"), unescaped(body).alias("text"))

    def both(x: Column) -> Column:
        # A span is cut from its own turn, at the place that the mask gives.
        loss = F.transform(x["spans"], lambda s: unescaped(F.substring(F.element_at(x["pieces"], s["turn"]), s["offset"] + 1, s["length"])))
        return F.struct(F.transform(x["pieces"], turn).alias("turns"), F.array_join(loss, "").alias("loss_text"))

    # Pieces and spans are the value of a lambda's variable: worked out once a conversation, however the plan is collapsed.
    read = F.get(F.transform(F.array(F.struct(pieces.alias("pieces"), F.col("loss_spans").alias("spans"))), both), F.lit(0))
    return chats.withColumn("_read", read).select(*chats.columns, "_read.turns", "_read.loss_text")
