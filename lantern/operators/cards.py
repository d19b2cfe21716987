"""Authority cards: what a ruling or interpretation holds, from one segmentation of its text.

Headings and set phrases cut a text into labelled segments. All fields of a card are taken from segments and carry their
half-open code-point spans, so that every quotation can be held against its source.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.functions.text import CITATION, normalize_citation
from lantern.operators import ranking
from lantern.operators.concepts import first_rule
from lantern.operators.temporal import effective_on

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("quote", T.StringType())])
SEGMENT = T.StructType([T.StructField("label", T.StringType()), *SPAN.fields])


def segments(text: Column, labels: Sequence[tuple[str, str]]) -> Column:
    """(label, start, end, quote) of a text's segments: each goes from where a label's pattern fits to the next fit of any.

    Of patterns that fit at one place the first of ``labels`` counts. What stands before the first fit has the label
    ``opening``. Segments without anything but white space are left out, and spans don't begin or end with any.
    """
    find = re.compile("|".join(f"(?P<l{i}>{p})" for i, (_, p) in enumerate(labels)), re.I | re.M) if labels else None
    names = [name for name, _ in labels]

    @F.pandas_udf(T.ArrayType(SEGMENT))
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            t = t or ""
            starts = [(m.start(), names[int(m.lastgroup[1:])]) for m in find.finditer(t) if m.end() > m.start()] if find else []
            out = []
            for (lo, label), (hi, _) in zip([(0, "opening"), *starts], [*starts, (len(t), "")]):
                body = t[lo:hi]
                if body.strip():
                    out.append({"label": label, "start": lo + len(body) - len(body.lstrip()), "end": lo + len(body.rstrip()), "quote": body.strip()})
            return out

        return texts.map(one)

    return cut(text.cast("string"))


def _of(found: Column, labels: Sequence[str]) -> Column:
    """The first segment with one of the labels, as a span; null without any."""
    own = F.filter(found, lambda s: s["label"].isin(*labels))
    first = F.get(own, F.lit(0))
    return F.when(F.size(own) > 0, F.struct(first["start"].alias("start"), first["end"].alias("end"), first["quote"].alias("quote")))


def cited(found: Column, pattern: str = CITATION) -> Column:
    """Distinct normalised references of the segments, in order of first mention."""
    every = F.flatten(F.transform(found, lambda s: F.regexp_extract_all(F.lower(s["quote"]), F.lit(pattern), F.lit(0))))
    return F.array_distinct(F.filter(F.transform(every, normalize_citation), lambda x: x != ""))


def extracted(
    documents: DataFrame,
    labels: Sequence[tuple[str, str]],
    fields: Mapping[str, Sequence[str]],
    outcomes: Sequence[tuple[str, str, str]],
    holding: Sequence[str] = ("court_holding", "authority_holding"),
    key: str = "doc_id",
    column: str = "text",
    pattern: str = CITATION,
) -> DataFrame:
    """(key, card): a struct with a span for each field, ``provisions``, ``outcome`` and ``favourability``.

    ``labels`` are (label, pattern) in order of priority, ``fields`` names for each field the labels of the segments that
    it may come from, in a text's order. The outcome follows the first rule (pattern, outcome, favourability) that the
    first of the ``holding`` fields that is there fits; without a holding the whole text counts. A null or blank text has a
    card of nulls. Repeated rows repeat their card. One narrow pass.
    """
    rows = documents.select(key, F.col(column).cast("string").alias("_text"), segments(F.col(column), labels).alias("_s"))
    spans = {name: _of(F.col("_s"), own) for name, own in fields.items()}
    held = F.coalesce(*[spans[h]["quote"] for h in holding if h in spans], F.col("_text"), F.lit(""))
    parts = [
        *[span.alias(name) for name, span in spans.items()],
        cited(F.col("_s"), pattern).alias("provisions"),
        first_rule(held, [(p, o) for p, o, _ in outcomes]).alias("outcome"),
        first_rule(held, [(p, f) for p, _, f in outcomes]).alias("favourability"),
    ]
    return rows.select(key, F.struct(*parts).alias("card"))


def spans(cards: DataFrame, fields: Sequence[str], key: str = "doc_id") -> DataFrame:
    """(key, field, start, end, quote): every span of the cards, for a check against the texts."""
    every = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"card.{f}.start").alias("start"), F.col(f"card.{f}.end").alias("end"), F.col(f"card.{f}.quote").alias("quote")) for f in fields])
    return cards.select(key, F.explode(F.filter(every, lambda x: x["quote"].isNotNull())).alias("x")).select(key, "x.*")


def temporal_status(start: Column, end: Column, target: Column) -> Column:
    """``current`` if a card's law holds on the date, ``historical`` if it doesn't, ``uncertain`` without any date."""
    return F.when(start.isNull() & end.isNull(), "uncertain").when(effective_on(start, end, target), "current").otherwise("historical")


def dimensions(card: Column, kind: Column, status: Column, asked: Mapping[str, Column], words: Column, family: Column) -> dict[str, Column]:
    """The parts of ``ranking.card_score`` that a card gives for a query.

    ``asked`` has arrays of the query's ``issues``, ``facts``, ``provisions``, ``payments``, ``transactions`` and ``special_rules``, and its
    ``tax`` as a boolean column; ``words`` are the distinct tokens of the card's segments.
    """
    holding = F.coalesce(card["court_holding"]["quote"], card["authority_holding"]["quote"])
    return {
        "family": family,
        "tax_match": F.when(asked["tax"], 1.0).otherwise(0.0),
        "issue_match": ranking.overlap(asked["issues"], words, 2.5),
        "material_fact_match": ranking.overlap(asked["facts"], words, 2.0),
        "provision_match": ranking.overlap(asked["provisions"], card["provisions"], 1.5),
        "payment_type_match": ranking.overlap(asked["payments"], words, 1.0),
        "transaction_match": ranking.overlap(asked["transactions"], words, 1.0),
        "temporal_match": ranking.temporal_match(status),
        "holding_relevance": F.when(holding.isNotNull(), 1.0).otherwise(0.0),
        "document_authority_weight": ranking.document_weight(kind),
        "current_special_rule_match": F.when(status == "current", ranking.overlap(asked["special_rules"], card["provisions"], 1.0)).otherwise(0.0),
    }
