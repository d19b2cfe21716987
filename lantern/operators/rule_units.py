"""Rules of a provision in three levels: paragraphs, their points, and the points' letters, with spans and lead sentences.

A point or letter is seldom a rule by itself: what it applies to stands in the sentence before the list. So each unit has
the ``lead`` that it inherits from the levels above, and what is inferred from a rule is read from both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.operators.concepts import first_rule

# What opens an article's text, a paragraph on a line or in it, a point and a letter.
ARTICLE = r"^\s*Art\.\s*\d+[a-z]*\.\s*"
PARAGRAPH, INLINE_PARAGRAPH = r"(?:^|\n)\s*(\d+[a-z]?)\.\s+", r"(?:^|(?<=\s))(\d+[a-z]?)\.\s+"
POINT, LETTER = r"(?:^|(?<=\s))(\d+[a-z]?)\)\s+", r"(?:^|(?<=\s))([a-z])\)\s+"

_UNIT = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("paragraph", "point", "letter", "lead")] + [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _cut(text: str, lo: int, hi: int, pattern: re.Pattern) -> tuple[int, list[tuple[str, int, int]]]:
    """Where what precedes the first marker ends, and (label, start of the body, end) of what each marker opens."""
    found = list(pattern.finditer(text, lo, hi))
    ends = [*[m.start() for m in found[1:]], hi]
    parts = [(m[1].lower(), m.end(), end) for m, end in zip(found, ends) if text[m.end() : end].strip()]
    return (found[0].start() if found else hi), parts


def _units(text: str, patterns: dict[str, re.Pattern]) -> Iterator[dict]:
    _, blocks = _cut(text, 0, len(text), patterns["paragraph"])
    if not blocks:
        article = patterns["article"].search(text)
        lo = article.end() if article else 0
        _, blocks = _cut(text, lo, len(text), patterns["inline"])
        if not blocks and text[lo:].strip():
            blocks = [(None, lo, len(text))]
    for paragraph, lo, hi in blocks:
        head, points = _cut(text, lo, hi, patterns["point"])
        if not points:
            yield {"paragraph": paragraph, "point": None, "letter": None, "lead": "", "start": lo, "end": hi}
            continue
        lead = " ".join(text[lo:head].split())
        for point, a, b in points:
            inner, letters = _cut(text, a, b, patterns["letter"])
            if not letters:
                yield {"paragraph": paragraph, "point": point, "letter": None, "lead": lead, "start": a, "end": b}
                continue
            both = " ".join(x for x in (lead, " ".join(text[a:inner].split())) if x)
            for letter, start, end in letters:
                yield {"paragraph": paragraph, "point": point, "letter": letter, "lead": both, "start": start, "end": end}


def nested(provisions: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, unit, paragraph, point, letter, citation, lead, text, start, end): the lowest units of each provision, in order.

    ``text`` is the unit's body with single spaces, ``start`` and ``end`` its half-open code-point span without white space at
    the ends. Paragraphs are sought at the beginnings of lines; without any, after the article's heading, wherever they
    stand; without those, the whole text is one unit. Null and blank texts have none; repeated rows repeat theirs.
    """
    patterns = {"paragraph": re.compile(PARAGRAPH, re.I), "inline": re.compile(INLINE_PARAGRAPH, re.I), "point": re.compile(POINT, re.I), "letter": re.compile(LETTER, re.I), "article": re.compile(ARTICLE, re.I)}

    @F.pandas_udf(_UNIT)
    def split(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            out = []
            for u in _units(text or "", patterns):
                body = text[u["start"] : u["end"]]
                out.append(u | {"start": u["start"] + len(body) - len(body.lstrip()), "end": u["start"] + len(body.rstrip())})
            return out

        return texts.map(one)

    text = F.col(column).cast("string")
    rows = provisions.select(key, text.alias("_text"), F.posexplode(split(text)).alias("unit", "u")).select(key, "_text", "unit", "u.*")
    body = F.trim(F.regexp_replace(F.substring("_text", F.col("start") + 1, F.col("end") - F.col("start")), r"\s+", " "))
    citation = F.concat_ws(" ", F.concat(F.lit("ust. "), "paragraph"), F.concat(F.lit("pkt "), "point"), F.concat(F.lit("lit. "), "letter"))
    return rows.select(key, "unit", "paragraph", "point", "letter", citation.alias("citation"), "lead", body.alias("text"), "start", "end")


def whole(lead: str = "lead", text: str = "text") -> Column:
    """What a rule says: its lead and its own text."""
    return F.concat_ws(" ", F.nullif(F.col(lead), F.lit("")), F.col(text))


def typed(units: DataFrame, conditions: Sequence[str], kinds: Sequence[tuple[str, str]], requirements: Sequence[tuple[str, str]], known: Column | None = None) -> DataFrame:
    """``units`` with ``condition``, ``rule_type``, ``required_facts`` and ``missing_facts``, each read from lead and text.

    ``condition`` is the first group of the first pattern that fits; ``kinds`` are rules (pattern, type) in order of
    priority, for which the unit's own text counts before its lead; ``requirements`` are (pattern, fact).
    """
    said = F.lower(whole())
    found = [F.nullif(F.trim(F.regexp_extract(said, p, 1)), F.lit("")) for p in conditions]
    own, inherited = first_rule(F.col("text"), kinds), first_rule(F.col("lead"), kinds, "general")
    asked = F.array_compact(F.array(*[F.when(F.rlike(said, F.lit(p)), F.lit(fact)) for p, fact in requirements]).cast("array<string>"))
    facts = F.array_sort(F.array_distinct(asked))
    out = units.withColumn("condition", F.coalesce(*found, F.lit(None).cast("string"))).withColumn("rule_type", F.coalesce(own, inherited)).withColumn("required_facts", facts)
    return out.withColumn("missing_facts", F.col("required_facts") if known is None else F.array_except("required_facts", known))
