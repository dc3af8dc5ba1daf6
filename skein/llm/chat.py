r"""Chat formatting, with DataFrame functions only.

A message is an ordered array of typed parts: struct<kind, text, uri, units>. A visitor goes over the parts: text parts
up to the next attachment are joined and then escaped, so that nothing can form across their borders; image, audio and
document parts become placeholders numbered through the conversation, and each attachment's uri, number and expanded
token count are recorded.

The template marks turns as ``[INST]role\ntext[/INST]`` and assistant turns as ``<s>text</s>``. Wherever a text
or a role holds a control string, its first character gets a backslash behind it (one more if some are there
already), so no text contains a control string and removing one backslash gives the text back.

Defined results: null text, role, kind and parts are empty or no text; a null units counts as 1; unknown kinds are
text; rows of equal turn are ordered by role, then text, and repeated rows are repeated turns; a null conversation id
is one conversation; texts of any length are formatted whole; only the named columns are read, so other columns cannot
clash; an empty table gives no rows. A conversation becomes one string, so its rows meet in one task; there they are
ordered by Spark's external sort, and no other rows are needed with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Control strings of the template, as the part after their first character.
_TAILS = r"(?:INST\]|/INST\]|s>|/s>|image:|audio:|document:)"
#: Tokens that one unit stands for: image tiles, seconds of audio, document pages.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 768}

#: A placeholder; texts hold none unescaped.
_MARK = r"<(?:image|audio|document):\d+>"

PARTS = "array<struct<kind:string,text:string,uri:string,units:long>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])(\\*)(?={_TAILS})", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])(\\*)\\(?={_TAILS})", r"$1$2")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # a line feed was written as backslash n and a backslash as two; U+0000 holds the latter meanwhile
    twos = F.replace(unescape(role), F.lit("\\\\"), F.lit("\\\x00"))
    return F.replace(F.replace(twos, F.lit("\\n"), F.lit("\n")), F.lit("\\\x00"), F.lit("\\"))


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*TOKENS_PER_UNIT), F.lit(False))


def _units(part: Column) -> Column:
    return F.coalesce(part["units"], F.lit(1).cast("long"))


def _tokens(part: Column) -> Column:
    rate = F.lit(0)
    for kind, tokens in TOKENS_PER_UNIT.items():
        rate = F.when(part["kind"] == kind, F.lit(tokens)).otherwise(rate)
    return rate.cast("long") * _units(part)


def format_turns(messages: DataFrame) -> DataFrame:
    """One row per message of ``messages`` (conv_id, turn, role, parts): its segment of the formatted text with
    offsets in code points, and its attachments."""
    parts = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    base = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    base = base.withColumn("attached", F.size(F.filter("parts", _is_attachment)))
    tie = F.to_json("parts")
    ordered = W.partitionBy("conv_id").orderBy("turn", "role", tie)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    numbered = base.withColumn("position", F.row_number().over(ordered) - 1).withColumn("first", F.coalesce(F.sum("attached").over(before), F.lit(0)))

    # places of the attachments, with one before and one behind all parts: a run of text lies between two of them
    places = F.filter(F.transform("parts", lambda p, n: F.when(_is_attachment(p), n)), lambda n: n.isNotNull())
    numbered = numbered.withColumn("edges", F.concat(F.array(F.lit(-1)), places, F.array(F.size("parts"))))
    texts = F.transform("parts", lambda p: F.coalesce(p["text"], F.lit("")))

    def visit(k):
        low, high = F.element_at("edges", k + 1), F.element_at("edges", k + 2)
        run = escape(F.array_join(F.slice(texts, low + 2, high - low - 1), ""))
        mark = F.concat(F.lit("<"), F.element_at("parts", high + 1)["kind"], F.lit(":"), (F.col("first") + k).cast("string"), F.lit(">"))
        return F.when(k < F.col("attached"), F.concat(run, mark)).otherwise(run)

    body = F.array_join(F.transform(F.sequence(F.lit(0), F.col("attached")), visit), "")
    assistant = F.col("role") == "assistant"
    head = F.when(assistant, F.lit("<s>")).otherwise(F.concat(F.lit("[INST]"), _escape_role(F.col("role")), F.lit("\n")))
    tail = F.when(assistant, F.lit("</s>")).otherwise(F.lit("[/INST]"))
    attachments = F.transform(
        F.filter("parts", _is_attachment),
        lambda p, n: F.struct((F.col("first") + n).alias("number"), p["kind"].alias("kind"), p["uri"].alias("uri"), _tokens(p).alias("tokens")),
    )
    segments = numbered.select("conv_id", "position", assistant.alias("in_loss"), head.alias("head"), body.alias("body"), tail.alias("tail"), attachments.alias("attachments"))
    segments = segments.withColumn("segment", F.concat("head", "body", "tail")).withColumn("chars", F.length("segment"))
    start = F.coalesce(F.sum("chars").over(W.partitionBy("conv_id").orderBy("position").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return segments.select("conv_id", "position", "in_loss", "segment", "attachments", "chars", (start + F.length("head")).alias("loss_start"), (start + F.length("head") + F.length("body")).alias("loss_end"))


def format_chat(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code points, end exclusive, over the escaped text
    of assistant turns), attachments (number, kind, uri, tokens) in order."""
    turn = F.struct("position", "segment", "in_loss", "loss_start", "loss_end", "attachments")
    turns = F.array_sort(F.collect_list(turn))
    gathered = format_turns(messages).groupBy("conv_id").agg(turns.alias("turns"))
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["in_loss"]), lambda t: F.struct(t["loss_start"].alias("start"), t["loss_end"].alias("stop"))).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array<struct<role, text, marks>>: the text parts as one text, and the
    placeholders between them."""
    found = F.regexp_extract_all(formatted, F.lit(r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>"), F.lit(0))

    def turn(segment):
        assistant = segment.startswith("<s>")
        inner = F.when(assistant, F.substr(segment, F.lit(4), F.length(segment) - 7)).otherwise(F.substr(segment, F.lit(7), F.length(segment) - 13))
        cut = F.locate("\n", inner)
        role = F.when(assistant, F.lit("assistant")).otherwise(_unescape_role(F.substr(inner, F.lit(1), cut - 1)))
        body = F.when(assistant, inner).otherwise(F.substr(inner, cut + 1))
        text = F.array_join(F.transform(F.split(body, _MARK), unescape), "")
        return F.struct(role.alias("role"), text.alias("text"), F.regexp_extract_all(body, F.lit(_MARK), F.lit(0)).alias("marks"))

    return F.transform(found, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(1).cast("long").alias("units"))


def attachment_part(kind: Column, uri: Column, units: Column) -> Column:
    return F.struct(kind.alias("kind"), F.lit(None).cast("string").alias("text"), uri.alias("uri"), units.cast("long").alias("units"))


def text_messages(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Plain conversation rows as messages of one text part."""
    return rows.select("conv_id", "turn", "role", F.array(text_part(F.col(text_col))).alias("parts"))
