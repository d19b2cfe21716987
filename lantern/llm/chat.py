"""Chat formatting with typed content parts.

A turn is written as ``<|turn|>`` role, a line feed, its content and ``<|end|>``. A visitor flattens the content parts:
text is escaped, and an image, audio clip, document or other attachment becomes a placeholder such as ``<|image|>``.
The k-th placeholder belongs to the k-th attachment of the conversation. Every control string, here or in other
templates, begins with ``<`` or ``[``; these two and ``&`` are escaped in texts, so a text never holds a control string
and the escaping can be undone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, END = "<|turn|>", "<|end|>\n"
#: Tokens of one unit of an attachment: an image patch, a second of audio, a page of a document.
RATES = {"image": 1.0, "audio": 25.0, "document": 512.0}

PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("units", T.DoubleType())])
ATTACHMENT = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("turn", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("tokens", T.LongType())])
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&lsqb;")


def unescape(text: str) -> str:
    return text.replace("&lsqb;", "[").replace("&lt;", "<").replace("&amp;", "&")


class Flattener:
    """Visits the parts of one conversation in order."""

    def __init__(self, rates: Mapping[str, float]):
        self.rates, self.attachments, self.tokens = rates, [], 0

    def visit(self, turn: int, part: Mapping) -> str:
        return getattr(self, f"visit_{part['type']}", self.visit_other)(turn, part)

    def visit_text(self, turn: int, part: Mapping) -> str:
        text = part["text"] or ""
        self.tokens += len(text.encode().split())  # bytes split at ASCII white space only
        return escape(text)

    def visit_image(self, turn: int, part: Mapping) -> str:
        return self.attach(turn, "image", part)

    def visit_audio(self, turn: int, part: Mapping) -> str:
        return self.attach(turn, "audio", part)

    def visit_document(self, turn: int, part: Mapping) -> str:
        return self.attach(turn, "document", part)

    def visit_other(self, turn: int, part: Mapping) -> str:
        return self.attach(turn, "attachment", part)

    def attach(self, turn: int, kind: str, part: Mapping) -> str:
        tokens = max(1, math.ceil((part["units"] or 0) * self.rates.get(kind, 0)))
        self.tokens += tokens
        self.attachments.append({"position": len(self.attachments), "turn": turn, "type": kind, "ref": part["ref"], "tokens": tokens})
        return f"<|{kind}|>"


def _format(turns: list[dict], rates: Mapping[str, float]) -> dict:
    flat, out, at, spans = Flattener(rates), [], 0, []
    for number, turn in enumerate(turns):
        role = turn["role"] or ""
        head = TURN + escape(role).replace("\n", "&NewLine;") + "\n"
        body = "".join(flat.visit(number, part) for part in turn["content"] or [] if part)
        if role == "assistant":
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return {"n_turns": len(turns), "formatted": "".join(out), "loss_spans": spans, "attachments": flat.attachments, "n_tokens": flat.tokens}


def text_parts(rows: DataFrame, column: str = "text") -> DataFrame:
    """``rows`` with ``content``: one text part from a plain text column (null: empty)."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(rows[column], F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"))
    return rows.withColumn("content", F.array(part))


def format_conversations(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", rates: Mapping[str, float] = RATES) -> DataFrame:
    """One row per conversation: (conversation, n_turns, formatted, loss_spans, attachments, n_tokens).

    ``content`` holds an array of parts (type, text, ref, units); a null array or part is nothing, a null role is
    empty. Turns go by ``turn``, nulls first, ties by role and content; repeated rows are repeated turns. Rows with a
    null conversation form one. ``loss_spans`` are half-open code-point spans of the assistants' contents.
    ``n_tokens`` counts words of text and the expanded tokens of attachments. Other columns are not read.

    One shuffle by conversation; only a conversation's own rows meet in a task, as its output is one value.
    """
    schema = T.StructType([T.StructField(conversation, rows.schema[conversation].dataType), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(SPAN)), T.StructField("attachments", T.ArrayType(ATTACHMENT)), T.StructField("n_tokens", T.LongType())])
    one = F.struct(rows[turn].alias("turn"), rows[role].cast("string").alias("role"), rows[content].cast(T.ArrayType(PART)).alias("content"))
    grouped = rows.select(rows[conversation].alias("conversation"), one.alias("one")).groupBy("conversation").agg(F.array_sort(F.collect_list("one")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = [_format(x.as_py(), rates) for x in part.column(1)]
                columns = [part.column(0)] + [pa.array([m[f.name] for m in made], f.type) for f in list(arrow)[1:]]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return grouped.mapInArrow(run, schema)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, content) of each turn of a formatted conversation; placeholders stay as they are."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        head, _, body = piece.removeprefix(TURN).partition("\n")
        turns.append((unescape(head.replace("&NewLine;", "\n")), unescape(body)))
    return turns


def read_back(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Digests of the turns and of the text under the loss mask, taken from the formatted text alone."""
    schema = T.StructType(
        [T.StructField(conversation, formatted.schema[conversation].dataType)]
        + [T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()), ("n_tokens", T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, chars, loss, size = [], [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                text = text.as_py()
                turns = parse(text)
                under = "".join(unescape(text[s["start"] : s["end"]]) for s in spans.as_py())
                n.append(len(turns))
                digests.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                chars.append(len(under))
                loss.append(hashlib.sha256(under.encode()).hexdigest())
                size.append(len(text))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(size, pa.int64()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return formatted.select(conversation, "formatted", "loss_spans", "n_tokens").mapInArrow(run, schema)
