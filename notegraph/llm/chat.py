"""Chat formatting with typed content parts.

A visitor has one method for each type of part. Each turns a part into its placeholder or its escaped text, the
reference of its attachment and the count of tokens that it expands to; the parts of a turn are flattened in order.
Turns are formatted one by one by column expressions, and a conversation is its turns' strings in order,
which read_back() streams, so no task holds a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm.common import small_batches

#: The marks of the template, and the letter that stands, after a backslash, for each character that could make one up in a text.
OPEN, CLOSE, AFTER_ROLE = "<turn>### ", "</turn>\n", ": "
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
PART = "struct<type:string,text:string,ref:string,units:double>"
ATTACHMENT = "struct<ordinal:int,type:string,ref:string,tokens:long>"


def escape(text: Column, role: bool = False) -> Column:
    """text without the characters of marks; unescape() is its inverse. In a role, colons are escaped as well."""
    for raw, code in ESCAPES[: 4 if role else 3]:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: str) -> str:
    for raw, code in ESCAPES[::-1]:
        text = text.replace(code, raw)
    return text


class PartVisitor:
    """Column expressions for each type of part. Subclass it, or change its rates, for other models.

    A part's units are pixels for an image, seconds for audio and pages for a document; null or
    negative units count as 0, and every attachment takes one token at least. A text's tokens are
    counted at chars_per_token. A part of another or no type is handled as text.
    """

    pixels_per_token, tokens_per_second, tokens_per_page, chars_per_token = 784.0, 25.0, 600.0, 4.0

    def visit_text(self, part: Column) -> Column:
        return F.ceil(F.char_length(F.coalesce(part["text"], F.lit(""))) / F.lit(self.chars_per_token))

    def visit_image(self, part: Column) -> Column:
        return F.ceil(self.units(part) / F.lit(self.pixels_per_token))

    def visit_audio(self, part: Column) -> Column:
        return F.ceil(self.units(part) * F.lit(self.tokens_per_second))

    def visit_document(self, part: Column) -> Column:
        return F.ceil(self.units(part) * F.lit(self.tokens_per_page))

    def units(self, part: Column) -> Column:
        return F.greatest(F.coalesce(part["units"], F.lit(0.0)), F.lit(0.0))

    def accept(self, part: Column, ordinal: Column) -> Column:
        """The visited part: what stands in the output, its attachment (null for a text) and its tokens."""
        kinds = ("image", "audio", "document")
        kind = F.lower(F.coalesce(part["type"], F.lit("text")))
        tokens = self.visit_text(part)
        for k in kinds:
            tokens = F.when(kind == k, F.greatest(getattr(self, f"visit_{k}")(part), F.lit(1))).otherwise(tokens)
        tokens = tokens.cast("long")
        attached = kind.isin(*kinds)
        shown = F.when(attached, F.concat(F.lit("<|"), kind, F.lit(":"), (ordinal + 1).cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))
        attachment = F.when(attached, F.struct((ordinal + 1).cast("int").alias("ordinal"), kind.alias("type"), part["ref"].alias("ref"), tokens.alias("tokens")))
        return F.struct(shown.alias("shown"), attachment.cast(ATTACHMENT).alias("attachment"), tokens.alias("tokens"))


def text_part(text: Column) -> Column:
    """A turn's parts where all it has is a text."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), none.alias("ref"), none.alias("units"))).cast(f"array<{PART}>")


def format_turns(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", visitor: PartVisitor | None = None) -> DataFrame:
    """One row a turn: conv_id, turn, formatted, attachments, expanded_tokens. No shuffle.

    Null parts, or none: an empty turn. Null role: an empty one. Ordinals count a turn's attachments'
    places among its parts, from 1. Repeated rows stay. Further columns are dropped.
    """
    visitor = visitor or PartVisitor()
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))
    seen = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.transform(F.filter(parts, lambda p: p.isNotNull()), visitor.accept).alias("seen"),
    )
    body = F.array_join(F.col("seen.shown"), "")
    return seen.select(
        "conv_id", "turn",
        F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(AFTER_ROLE), body, F.lit(CLOSE)).alias("formatted"),
        F.filter(F.col("seen.attachment"), lambda a: a.isNotNull()).alias("attachments"),
        F.aggregate(F.col("seen.tokens"), F.lit(0).cast("long"), lambda a, x: a + x).alias("expanded_tokens"),
    )


BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachments long, expanded_tokens long"


class _Reader:
    """Parses one conversation's output as it streams by: a turn ends at its closing mark, which no text can hold."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.attachments = self.tokens = 0
        self.rest = ""

    def feed(self, formatted: str, learn: str) -> None:
        self.chars += len(formatted)
        *ended, self.rest = (self.rest + formatted).split(CLOSE)
        for turn in ended:
            assert turn.startswith(OPEN), "not the output of format_turns()"
            role, _, body = turn[len(OPEN) :].partition(AFTER_ROLE)
            role, text = unescape(role), unescape(body)
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == learn:
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self, conv_id) -> tuple:
        return conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.attachments, self.tokens


def read_back(formatted: DataFrame, learn: str = "assistant") -> DataFrame:
    """Parses what format_turns() put out: one row a conversation, with digests of its turns and of the text under the loss mask (that of role learn).

    Turns go by turn, ties by their strings. A conversation's rows are sorted into one task and
    streamed; only hash states are held. A null conv_id is a conversation of its own. No rows: none.
    """
    small_batches(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, rows = None, None, []

        def out():
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(cols)], [x.split()[0] for x in BACK.split(",")])

        for batch in batches:
            for conv_id, text, n, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader is None or conv_id != now:
                    if reader is not None:
                        rows.append(reader.row(now))
                    now, reader = conv_id, _Reader()
                reader.feed(text, learn)
                reader.attachments += n
                reader.tokens += tokens
            if len(rows) >= 10_000:
                yield out()
                rows = []
        if reader is not None:
            rows.append(reader.row(now))
        if rows:
            yield out()

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return dealt.select(F.col("conv_id").cast("long"), "formatted", F.size("attachments"), "expanded_tokens").mapInArrow(run, BACK)


def probe(spark: SparkSession, conv_id: int, text: str) -> DataFrame:
    """A conversation of a user's and an assistant's turn that both say text."""
    return spark.createDataFrame([(conv_id, 0, "user", text), (conv_id, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
