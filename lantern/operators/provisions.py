"""Units of a structured text and the references between them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.functions.text import CITATION, citations, normalize_citation

#: A line that opens a unit, by level; the deepest level stands last.
LEVELS = (
    ("article", r"^ *Art\. ?([0-9]+[a-z]*)\."),
    ("paragraph", r"^ *§ ?([0-9]+[a-z]*)\."),
    ("section", r"^ *([0-9]+[a-z]*)\. "),
    ("point", r"^ *([0-9]+[a-z]*)\) "),
    ("letter", r"^ *([a-z])\) "),
)


def units(documents: DataFrame, key: str = "doc_id", column: str = "text", levels=LEVELS) -> DataFrame:
    """(key, unit_id, citation, unit_type, start, end, text) of each unit, with half-open code-point spans.

    Lines are exploded with their offsets; each level's label holds until a line of the same or a higher level. Text
    before the first unit is none. A document's lines are its own group, in order of position.
    """
    lines = documents.select(key, F.posexplode(F.split(column, "\n")).alias("line", "text"))
    by = Window.partitionBy(key).orderBy("line")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int"))
    level = F.lit(None).cast("int")
    for i, (_, pattern) in reversed(list(enumerate(levels))):
        level = F.when(F.rlike("text", F.lit(pattern)), i).otherwise(level)
    lines = lines.withColumn("level", level)
    lines = lines.withColumn("unit", F.sum(F.col("level").isNotNull().cast("int")).over(by))
    heads = lines.filter("level is not null")
    order = Window.partitionBy(key).orderBy("line")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    for i, (name, pattern) in enumerate(levels):
        label = F.when(F.col("level") == i, F.regexp_extract("text", pattern, 1))
        # The latest head of this level, unless a higher level has begun since.
        latest = F.last(F.when(F.col("level") <= i, F.struct(label.alias("label"), F.col("line").alias("line"))), ignorenulls=True).over(upto)
        heads = heads.withColumn(name, latest["label"])
    names = [n for n, _ in levels]
    prefix = dict(zip(names, ("art. ", "§ ", "ust. ", "pkt ", "lit. ")))
    heads = heads.withColumn("citation", F.concat_ws(" ", *[F.concat(F.lit(prefix.get(n, "")), n) for n in names]))
    heads = heads.withColumn("unit_type", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("level") + 1))
    spans = lines.filter("unit > 0").groupBy(key, "unit").agg(F.min("start").alias("start"), F.max(F.col("start") + F.length("text")).alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("unit_text"))
    return heads.select(key, "unit", "citation", "unit_type", *names).join(spans, [key, "unit"]).select(key, "unit", "citation", "unit_type", *names, "start", "end", F.col("unit_text").alias("text"))


def sibling_edges(rows: DataFrame, group: list[str], order: str, node: str) -> DataFrame:
    """(source, target, relation): each node and the next of its group, both ways."""
    follows = rows.select(F.col(node).alias("source"), F.lead(node).over(Window.partitionBy(*group).orderBy(order, node)).alias("target")).filter("target is not null")
    return follows.withColumn("relation", F.lit("neighbor")).union(follows.select("target", "source", F.lit("neighbor")))


def spans_hold(rows: DataFrame, text: str, start: str, end: str, quote: str) -> DataFrame:
    """``rows`` with ``valid``: whether the text between the offsets is the quote."""
    return rows.withColumn("valid", F.substring(F.col(text), F.col(start) + 1, F.col(end) - F.col(start)).eqNullSafe(F.col(quote)))


MENTION = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("reference", T.StringType())]))
# Words around a reference that tell what it is for, in order of priority.
RELATIONS = {
    "transitional_rule_for": r"przepisy? przejściow|do spraw wszczętych|do okresów rozpoczętych",
    "exception_to": r"z wyjątkiem|nie stosuje się|wyłącza się|chyba że",
    "special_rule_for": r"z zastrzeżeniem|przepis szczególny|na zasadach określonych|stosuje się również|stosuje się odpowiednio|obejmuj[a-ząę]* także|także gdy",
    "overrides": r"stosuje się zamiast|ma pierwszeństwo|bez względu na",
    "defines": r"w rozumieniu|rozumie się przez|oznacza",
}


def mentions(rows: DataFrame, pattern: str = CITATION, key: str = "doc_id", column: str = "text", before: int = 120, after: int = 80) -> DataFrame:
    """(key, start, end, reference, relation): references with half-open code-point spans.

    The relation is read from the text around; one without any of the words is a plain reference.
    """
    find = re.compile(pattern, re.I)

    @F.pandas_udf(MENTION)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": m.start(), "end": m.end(), "reference": m[0]} for m in find.finditer(t or "")])

    found = rows.select(key, column, F.explode(spans(F.col(column))).alias("m")).select(key, column, "m.*")
    left = F.greatest(F.col("start") - before, F.lit(0))
    context = F.lower(F.substring(F.col(column), left + 1, F.col("end") + after - left))
    relation = F.lit("references")
    for name, words in reversed(RELATIONS.items()):
        relation = F.when(F.rlike(context, F.lit(words)), name).otherwise(relation)
    return found.select(key, "start", "end", normalize_citation(F.col("reference")).alias("reference"), relation.alias("relation"))


def unsupported(answer: Column, allowed: Column, pattern: str = CITATION) -> Column:
    """References of an answer that its evidence doesn't have."""
    return F.array_except(citations(answer, pattern), F.transform(allowed, normalize_citation))


def excerpt(text: Column, headings: str, limit: int = 18_000, ends: int = 3_500, lead: int = 1_000, tail: int = 9_000, gap: str = "\n\n[...]\n\n") -> Column:
    """A long text's beginning, what stands around the headings, and its end, within a number of characters."""
    find = re.compile(headings, re.I | re.M)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None or len(t) <= limit:
                return t
            wanted = [(0, ends), *((max(0, m.start() - lead), m.start() + tail) for m in find.finditer(t)), (len(t) - ends, len(t))]
            kept, left = [], limit
            for start, end in wanted:
                for a, b in kept:
                    start = b if a <= start < b else start
                end = min(end, len(t), start + left)
                if start < end:
                    kept.append((start, end))
                    left -= end - start
            return gap.join(t[a:b] for a, b in sorted(kept))

        return texts.map(one)

    return cut(text)
