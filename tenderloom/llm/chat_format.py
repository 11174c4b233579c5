"""Chat formatting of typed content parts, with DataFrame functions only.

A visitor per part type turns text, image, audio and document parts into one string with ordered placeholders, and
records what they stand for: the attachment's reference and the tokens that it will expand to. Turns are marked,
control strings inside texts are escaped so that they can be restored exactly, and the loss mask is a list of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native_spans import running

#: The template: marks around each turn's role and content.
TURN, CONTENT, END = "<|turn|>", "<|content|>", "<|end|>"
#: A control string begins with "<" or "[" and goes on with one of these. One backslash more between both parts
#: escapes it; one less restores it. Openers never occur in a tail, so occurrences cannot overlap.
_TAIL = r"(\||/?s>|/?INST\])"
_ESCAPE = rf"([<\[])(\\*){_TAIL}"
_RESTORE = rf"([<\[])\\(\\*){_TAIL}"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def restored(text: Column) -> Column:
    return F.regexp_replace(text, _RESTORE, "$1$2$3")


def text_part(text: Column) -> Column:
    """A part that is plain text; null is empty."""
    names = {x.split(":")[0]: x.split(":")[1] for x in PART[7:-1].split(",")}
    return F.struct(*[{"type": F.lit("text"), "text": F.coalesce(text, F.lit(""))}.get(k, F.lit(None)).cast(t).alias(k) for k, t in names.items()])


#: Visitors: a part's expanded tokens, by type (patches of 28 x 28; 25 frames a second; 600 tokens a page).
TOKENS = {
    "image": lambda p: F.ceil(F.coalesce(p["width"], F.lit(0)) / 28) * F.ceil(F.coalesce(p["height"], F.lit(0)) / 28),
    "audio": lambda p: F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * 25),
    "document": lambda p: F.coalesce(p["pages"], F.lit(0)) * 600,
}


def _tokens(p: Column) -> Column:
    out = F.lit(0).cast("long")
    for kind, visit in TOKENS.items():
        out = F.when(p["type"] == kind, visit(p).cast("long")).otherwise(out)
    return out


def _is_attachment(p: Column) -> Column:
    return F.coalesce(p["type"].isin(*TOKENS), F.lit(False))


def formatted(turns: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, parts): conv_id, text, n_turns, loss (array of s, e), attachments.

    loss lists the code points (end exclusive) of assistant content. attachments: place (from 1, as in the placeholder
    ``<|type:place|>``), type, ref, tokens. Turns go by number, ties by role, then content, so repeated rows are
    repeated turns; a null turn comes first, a null role is empty, null parts have no content; a part of unknown type
    counts as text; rows without conv_id form one conversation. Other columns are not read; an empty table
    has no conversations. A conversation is one row of the result, so its turns meet in one task, and only there.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"))
    convs = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    attached = F.filter(F.flatten(F.transform("turns", lambda t: t["parts"])), _is_attachment)
    listed = F.transform(attached, lambda p, i: F.struct((i + 1).alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    convs = convs.withColumn("attachments", listed)
    # attachments before each turn number its placeholders
    convs = convs.withColumn("_before", running(F.transform("turns", lambda t: F.size(F.filter(t["parts"], _is_attachment)))))

    def content(t: Column, before: Column) -> Column:
        # neighbouring texts are escaped as one, so no control string can arise where two parts meet
        empty = F.struct(F.lit("").alias("out"), F.lit("").alias("text"), before.alias("place"))

        def visit(acc: Column, p: Column) -> Column:
            mark = F.concat(F.lit("<|"), p["type"], F.lit(":"), (acc["place"] + 1).cast("string"), F.lit("|>"))
            attachment = F.struct(F.concat(acc["out"], escaped(acc["text"]), mark).alias("out"), F.lit("").alias("text"), (acc["place"] + 1).alias("place"))
            more = F.struct(acc["out"].alias("out"), F.concat(acc["text"], F.coalesce(p["text"], F.lit(""))).alias("text"), acc["place"].alias("place"))
            return F.when(_is_attachment(p), attachment).otherwise(more)

        return F.aggregate(t["parts"], empty, visit, lambda acc: F.concat(acc["out"], escaped(acc["text"])))

    convs = convs.withColumn("_c", F.zip_with("turns", "_before", lambda t, b: F.struct(escaped(t["role"]).alias("role"), content(t, b).alias("content"))))
    head = lambda c: F.concat(F.lit(TURN), c["role"], F.lit(CONTENT))
    convs = convs.withColumn("_p", F.transform("_c", lambda c: F.struct(F.concat(head(c), c["content"], F.lit(END)).alias("whole"), F.length(head(c)).alias("head"), F.length(c["content"]).alias("size"), (c["role"] == "assistant").alias("loss"))))
    convs = convs.withColumn("_at", running(F.transform("_p", lambda p: F.length(p["whole"]))))
    loss = F.transform(F.filter(F.arrays_zip(F.col("_p").alias("p"), F.col("_at").alias("at")), lambda x: x["p"]["loss"]), lambda x: F.struct((x["at"] + x["p"]["head"]).alias("s"), (x["at"] + x["p"]["head"] + x["p"]["size"]).alias("e")))
    return convs.select("conv_id", F.array_join(F.transform("_p", lambda p: p["whole"]), "").alias("text"), F.size("turns").cast("long").alias("n_turns"), loss.alias("loss"), "attachments")


def _halves(text: str) -> Column:
    """Escaped role and content of each turn of a formatted text."""
    marked = F.filter(F.split(text, r"<\|turn\|>", -1), lambda x: x != "")
    return F.transform(marked, lambda x: F.split(F.substring_index(x, END, 1), r"<\|content\|>", -1))


def read_parts(convs: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, parts) of formatted texts: neighbouring texts are one part, and attachments have their type and
    place. A text that says what a placeholder says is escaped, so it stays a text."""
    mark = rf"<\|(?:{'|'.join(TOKENS)}):[0-9]+\|>"

    def parts(content: Column) -> Column:
        texts = F.transform(F.split(content, mark, -1), lambda x: F.struct(F.lit("text").alias("type"), restored(x).alias("text"), F.lit(None).cast("int").alias("place")))
        part = lambda m: F.struct(F.regexp_extract(m, "[a-z]+", 0).alias("type"), F.lit(None).cast("string").alias("text"), F.regexp_extract(m, "[0-9]+", 0).cast("int").alias("place"))
        marks = F.transform(F.regexp_extract_all(content, F.lit(mark), F.lit(0)), part)
        return F.filter(F.flatten(F.zip_with(texts, marks, lambda t, m: F.array_compact(F.array(t, m)))), lambda p: (p["type"] != "text") | (p["text"] != ""))

    turns = F.transform(_halves("text"), lambda h: F.struct(restored(F.get(h, F.lit(0))).alias("role"), parts(F.get(h, F.lit(1))).alias("parts")))
    return convs.select("conv_id", turns.alias("turns"))


def read_back(convs: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) and loss_text, from the formatted text and its loss places alone."""
    turns = F.transform(_halves("text"), lambda h: F.struct(restored(F.get(h, F.lit(0))).alias("role"), restored(F.get(h, F.lit(1))).alias("text")))
    under = F.transform("loss", lambda x: restored(F.substring(F.col("text"), x["s"] + 1, x["e"] - x["s"])))
    return convs.select("conv_id", turns.alias("turns"), F.array_join(under, "").alias("loss_text"), F.length("text").cast("long").alias("formatted_chars"))


def report(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of (conv_id, turn, role, text) rows."""
    turns = conversations.select("conv_id", "turn", "role", F.array(text_part(F.col("text"))).alias("parts"))
    back = read_back(formatted(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
