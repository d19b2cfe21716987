"""Editorial units of acts that are stored in chunks, and the references between them.

A marker opens a unit: an article, a paragraph (§), a section, a point or a letter. What a bare ``1.``, ``1)`` or ``a)`` means
depends on the units before it, which may stand in earlier chunks. So the markers of all chunks are read in
tasks, and windows over a document's markers, without its texts, carry the state from chunk to chunk: the last label of
each level holds until one of the same or a higher level begins.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.operators.lineage import small, stored
from lantern.operators.provisions import RELATIONS, sibling_edges

BROADCAST_ROWS = 500_000
# Levels from the highest, what stands before a label in a citation, and the lines that open a unit.
LEVELS = ("article", "paragraph", "section", "point", "letter")
PREFIXES = ("art. ", "§ ", "ust. ", "pkt ", "lit. ")
STATED = (r"\s*art\.\s*(\d+[a-z]*)\.?\s*(.*)$", r"\s*§\s*(\d+[a-z]*)\.?\s*(.*)$", r"\s*ust\.\s*(\d+[a-z]*)\.?\s*(.*)$", r"\s*pkt\s*(\d+[a-z]*)\.?\s*(.*)$", r"\s*lit\.\s*([a-z])\)?\s*(.*)$")
BARE = {2: r"\s*(\d+[a-z]*)\.\s+(.+)$", 3: r"\s*(\d+[a-z]*)\)\s*(.+)$", 4: r"\s*([a-z])\)\s*(.+)$"}
REFERENCE = r"(?:art\.\s*(?P<article>\d+[a-z]*)|§\s*(?P<paragraph>\d+[a-z]*))(?:\s+ust\.\s*(?P<section>\d+[a-z]*))?(?:\s+pkt\s*(?P<point>\d+[a-z]*))?(?:\s+lit\.\s*(?P<letter>[a-z]))?"
RELATIVE = (r"\bust\.\s*(?P<section>\d+[a-z]*)(?:\s+pkt\s*(?P<point>\d+[a-z]*))?(?:\s+lit\.\s*(?P<letter>[a-z]))?", r"\bpkt\s*(?P<point>\d+[a-z]*)(?:\s+lit\.\s*(?P<letter>[a-z]))?")

#: Kinds of markers: one that always counts, a lower-case article, a bare one, the scope that a chunk states, a chunk's beginning.
SURE, WRAPPED, OPEN, SCOPE, HEAD = range(5)
_MARKER = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("body", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("kind", T.IntegerType())]))
_MENTION = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("reference", T.StringType()), T.StructField("relative", T.BooleanType()), *[T.StructField(x, T.StringType()) for x in LEVELS]]))


def _line_markers(line: str, at: int, stated: list[re.Pattern], bare: dict[int, re.Pattern]) -> list[tuple]:
    for level, pattern in enumerate(stated):
        if m := pattern.match(line):
            label, inline = m[1].lower(), bare[2].match(m[2]) if level == 0 else None
            if inline:  # Art. 86. 1. ...: the article and its first section on one line
                inner = at + m.start(2)
                return [(at, inner, 0, label, SURE), (inner, inner + inline.start(2), 2, inline[1].lower(), SURE)]
            return [(at, at + m.start(2), level, label, WRAPPED if level == 0 and line.lstrip().startswith("art.") else SURE)]
    for level, pattern in bare.items():
        if m := pattern.match(line):
            return [(at, at + m.start(2), level, m[1].lower(), OPEN)]
    return []


def _markers(texts: Column) -> Column:
    stated, bare = [re.compile(x, re.I) for x in STATED], {k: re.compile(x, re.I) for k, x in BARE.items()}

    @F.pandas_udf(_MARKER)
    def find(column: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            found, at = [], 0
            for line in (text or "").split("\n"):
                found += _line_markers(line.rstrip("\r"), at, stated, bare)
                at += len(line) + 1
            return [dict(zip(("start", "body", "level", "label", "kind"), x)) for x in found]

        return column.map(one)

    return find(texts)


def _accepted(rows: DataFrame, document: str, chunk: str) -> DataFrame:
    """The markers that open a unit where they stand, after scopes and chunk beginnings. All windows share one sort."""
    order = Window.partitionBy(document).orderBy(chunk, "start", F.desc("kind"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level, kind = F.col("level"), F.col("kind")
    article = (level == 0) & (kind != HEAD)
    rows = rows.withColumn("_articles", F.count_if(article).over(before))
    rows = rows.withColumn("_ok", F.when(kind == WRAPPED, F.col("_articles") == 0).when(kind == OPEN, False).otherwise(kind != HEAD))
    label = F.last(F.when(article & F.col("_ok"), F.col("label")), ignorenulls=True).over(before)
    rows = rows.withColumn("_ok", F.when(kind == SCOPE, ~F.col("label").eqNullSafe(label)).otherwise(F.col("_ok")))
    for bare, needs in ((2, (0, 1, 2)), (3, (1, 2)), (4, (3,))):
        # What the units above leave open: a section needs an article or a paragraph, a point a section or a paragraph, a letter a point.
        last = F.last(F.when(F.col("_ok") & (level < max(bare, 2)), level), ignorenulls=True).over(before)
        rows = rows.withColumn("_ok", F.when((kind == OPEN) & (level == bare), F.coalesce(last.isin(*needs), F.lit(False))).otherwise(F.col("_ok")))
    return rows.filter(F.col("_ok") | (kind == HEAD))


def units(chunks: DataFrame, document: str = "doc_id", chunk: str = "chunk_index", column: str = "text", scope: str | None = None) -> DataFrame:
    """(document, unit, continued, citation, parent, unit_type, article, ..., letter, chunk, start, end, text) of all units.

    ``unit`` numbers a document's units from 1; ``start`` and ``end`` are half-open code-point offsets in the chunk; ``text`` is the
    body without the marker, its lines trimmed, blank ones left out. What a chunk has before its first marker is a
    further row of the unit before, ``continued``; what stands before a document's first unit is none. ``scope`` names a
    column with a chunk's article: where it isn't the article that holds, it begins anew, without a unit of its own, and
    what stands before the chunk's first marker is none either.

    Chunks that repeat (document, chunk) follow each other in no stated order. Null and empty texts have no markers.
    Windows sort a document's markers only; each unit then takes its text from its chunk by an equality join.
    """
    own = chunks.select(F.col(document), F.col(chunk), F.col(column).cast("string").alias("_text"), (F.col(scope) if scope else F.lit(None)).cast("string").alias("_scope"))
    found = own.select(document, chunk, F.explode(_markers(F.col("_text"))).alias("m")).select(document, chunk, "m.*")
    head = own.select(document, chunk, F.lit(-1).alias("start"), F.lit(0).alias("body"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("label"), F.lit(HEAD).alias("kind"))
    stated = own.filter("_scope is not null").select(document, chunk, F.lit(-2).alias("start"), F.lit(0).alias("body"), F.lit(0).alias("level"), F.lower("_scope").alias("label"), F.lit(SCOPE).alias("kind"))
    rows = _accepted(found.unionByName(head).unionByName(stated), document, chunk)
    order = Window.partitionBy(document).orderBy(chunk, "start", F.desc("kind"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    level = F.col("level")
    for i, name in enumerate(LEVELS):
        latest = F.last(F.when(level <= i, F.struct(F.when(level == i, F.col("label")).alias("label"))), ignorenulls=True).over(upto)
        rows = rows.withColumn(name, latest["label"])
    opens = level.isNotNull() & (F.col("kind") != SCOPE)
    rows = rows.withColumn("unit", F.count_if(opens).over(upto)).withColumn("_type", F.last(F.when(opens, level), ignorenulls=True).over(upto))
    rows = rows.withColumn("_scoped", F.last(F.when(level.isNotNull(), F.col("kind") == SCOPE), ignorenulls=True).over(upto))
    rows = rows.filter(F.col("kind") != SCOPE).withColumn("end", F.lead("start").over(Window.partitionBy(document, chunk).orderBy("start")))
    rows = rows.filter(opens | (F.col("unit") > 0) & ~F.col("_scoped")).withColumn("continued", F.col("kind") == HEAD)
    labels = F.array(*[F.lit(x) for x in LEVELS])
    above = [F.when(F.lit(i) < F.col("_type"), F.col(x)) for i, x in enumerate(LEVELS)]
    rows = rows.select(document, "unit", "continued", _citation([F.col(x) for x in LEVELS]).alias("citation"), F.nullif(_citation(above), F.lit("")).alias("parent"), F.get(labels, F.col("_type")).alias("unit_type"), *LEVELS, F.col(chunk).alias("_chunk"), F.greatest("start", F.lit(0)).alias("start"), "body", "end")
    texts = own.select(F.col(document).alias("_document"), F.col(chunk).alias("_at"), "_text")
    met = rows.join(texts, F.col(document).eqNullSafe(F.col("_document")) & F.col("_chunk").eqNullSafe(F.col("_at")))
    met = met.withColumn("end", F.coalesce("end", F.length("_text")))
    lines = F.transform(F.split(F.substring("_text", F.col("body") + 1, F.col("end") - F.col("body")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    met = met.withColumn("text", F.array_join(F.filter(lines, lambda x: x != ""), "\n")).filter(~F.col("continued") | (F.col("text") != ""))
    return met.select(document, "unit", "continued", "citation", "parent", "unit_type", *LEVELS, F.col("_chunk").alias(chunk), "start", "end", "text")


def _citation(labels: list[Column]) -> Column:
    return F.concat_ws(" ", *[F.concat(F.lit(p), c) for p, c in zip(PREFIXES, labels)])


def references(found: DataFrame, document: str = "doc_id", before: int = 120, after: int = 80) -> DataFrame:
    """(document, unit, start, end, reference, relative, relation, article, ..., letter): what the units' texts refer to.

    A reference without an article or a paragraph is relative: what it leaves out it takes from the unit it stands in.
    The relation is read from the words around; offsets are code points in the unit's text.
    """
    whole, near = re.compile(REFERENCE, re.I), [re.compile(x, re.I) for x in RELATIVE]

    @F.pandas_udf(_MENTION)
    def mentions(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            stated = list(whole.finditer(text or ""))
            taken, out = [m.span() for m in stated], [(m, False) for m in stated]
            for pattern in near:
                fresh = [m for m in pattern.finditer(text or "") if not any(a <= m.start() < b for a, b in taken)]
                taken += [m.span() for m in fresh]
                out += [(m, True) for m in fresh]
            none = dict.fromkeys(LEVELS)
            return [none | {k: v and v.lower() for k, v in m.groupdict().items()} | {"start": m.start(), "end": m.end(), "reference": m[0].strip(" .,;:"), "relative": r} for m, r in out]

        return texts.map(one)

    own = [F.col(x).alias(f"_{x}") for x in LEVELS]
    rows = found.select(document, "unit", "text", *own, F.explode(mentions(F.col("text"))).alias("m")).select(document, "unit", "text", *[f"_{x}" for x in LEVELS], "m.*")
    left = F.greatest(F.col("start") - before, F.lit(0))
    context = F.lower(F.substring(F.col("text"), left + 1, F.col("end") + after - left))
    relation = F.lit("references")
    for name, words in reversed(RELATIONS.items()):
        relation = F.when(F.rlike(context, F.lit(words)), name).otherwise(relation)
    inherited = [F.when(F.col("relative"), F.coalesce(x, f"_{x}")).otherwise(F.col(x)).alias(x) for x in LEVELS[:3]]
    return rows.select(document, "unit", "start", "end", "reference", "relative", relation.alias("relation"), *inherited, "point", "letter")


def resolved(refs: DataFrame, found: DataFrame, document: str = "doc_id") -> DataFrame:
    """(document, source, target, relation): the unit that each reference names, the narrowest that it states and no narrower.

    Each unit is listed under every set of labels by which it may be named (sections, points and letters stated or not), and
    the least specific, then first, unit of such a name is kept; so a reference meets one row by equality and an article
    of many units makes no pairs.
    """
    heads = found.filter("not continued").select(document, "unit", *LEVELS)
    specificity = sum((F.col(x).isNotNull().cast("int") for x in LEVELS), F.lit(0))
    shown = [F.struct(*[(F.lit(bool(mask >> i & 1))).alias(x) for i, x in enumerate(LEVELS[2:])]) for mask in range(8)]
    named = heads.withColumn("_s", specificity).withColumn("_shown", F.explode(F.array(*shown)))
    parts = [F.when(F.col(f"_shown.{x}"), F.col(x)) for x in LEVELS[2:]]
    fits = F.forall(F.array(*[~F.col(f"_shown.{x}") | F.col(x).isNotNull() for x in LEVELS[2:]]), lambda x: x)
    named = named.filter(fits).select(document, _name([F.col("article"), F.col("paragraph"), *parts]).alias("name"), "unit", "_s")
    best = named.groupBy(document, "name").agg(F.min(F.struct("_s", "unit")).alias("x")).select(F.col(document).alias("_document"), "name", F.col("x.unit").alias("target"))
    asked = refs.select(document, F.col("unit").alias("source"), "relation", _name([F.col(x) for x in LEVELS]).alias("_name"))
    met = asked.join(best, F.col(document).eqNullSafe(F.col("_document")) & (F.col("_name") == F.col("name")))
    return met.filter("source <> target").select(document, "source", "target", "relation").distinct()


def _name(labels: list[Column]) -> Column:
    return F.concat_ws("/", *[F.coalesce(x, F.lit("")) for x in labels])


def edges(found: DataFrame, document: str = "doc_id") -> DataFrame:
    """(document, source, target, relation) between units: references by what they mean, and neighbours of one parent."""
    named = resolved(references(found, document), found, document)
    heads = found.filter("not continued").select(document, "unit", F.coalesce("parent", F.lit("")).alias("_parent"))
    node = F.struct(F.col(document).alias("d"), F.col("unit").alias("u"))
    beside = sibling_edges(heads.withColumn("_node", node), [document, "_parent"], "unit", "_node")
    beside = beside.select(F.col("source.d").alias(document), F.col("source.u").alias("source"), F.col("target.u").alias("target"), "relation")
    return named.unionByName(beside)


def versions_chained(found: DataFrame, versions: DataFrame, document: str = "doc_id") -> DataFrame:
    """(act, citation, source, target): each version of a citation and the next one, by start, then version.

    ``versions`` is (document, act, version, start); ``source`` and ``target`` are versions. Unknown starts come first.
    """
    rows = found.filter("not continued").select(document, "citation").distinct().join(small(stored(versions.select(document, "act", "version", "start"), "versions"), BROADCAST_ROWS), document)
    after = F.lead("version").over(Window.partitionBy("act", "citation").orderBy(F.asc_nulls_first("start"), "version"))
    return rows.select("act", "citation", F.col("version").alias("source"), after.alias("target")).filter("target is not null and target <> source")
