"""Judgments, rules and statutes against a query: what names them, how they are preferred, and what is quoted first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.text import SPACE, normalize_whitespace
from lantern.operators.lineage import small, stored
from lantern.operators.ranking import clamped

# Points of a judgment that a query names.
SAME_SIGNATURE, OTHER_CHAMBER, CHAMBER_ONLY, SHARED_CHAMBER, NO_SHARED_CHAMBER, CLASHING_DOMAIN = 3.0, 2.2, 0.25, 0.7, -0.35, -0.75
# Points of a rule's citation by the levels that it names.
CITATION_POINTS = (("paragraph", r"\bust\.\s*\d+[a-z]?\b", 2), ("point", r"\bpkt\s*\d+[a-z]?\b", 2), ("letter", r"\blit\.\s*[a-z]\b", 1), ("all", r"\bust\.\s*\d+[a-z]?\s+pkt\s*\d+[a-z]?\s+lit\.\s*[a-z]\b", 2))
# Points of an opening quote for its domain and for each topic word that it has.
SAME_DOMAIN, TOPIC_WORD = 2.0, 0.35
# Fixed value: heading of an article within a statute's text.
ARTICLE = r"\bArt\.\s*[0-9]+[a-z]*\.?"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signatures(c: Column, court: str = "FSK") -> Column:
    """Array of (chamber, number, year) of the signatures in a text, such as ``II FSK 12/20``; no chamber is empty."""
    pattern = F.lit(rf"(?i)\b(?:(I{{1,3}})\s+)?{court}\s+([0-9]+)\s*/\s*([0-9]{{2,4}})\b")
    parts = [F.regexp_extract_all(F.coalesce(c, F.lit("")), pattern, F.lit(i)) for i in (1, 2, 3)]
    year = lambda y: F.when(F.length(y) == 4, y).otherwise(F.concat(F.lit("20"), y))
    return F.transform(F.arrays_zip(parts[0].alias("a"), parts[1].alias("b"), parts[2].alias("c")), lambda x: F.struct(F.upper(x["a"]).alias("chamber"), x["b"].alias("number"), year(x["c"]).alias("year")))


def chambers(c: Column, court: str = "FSK") -> Column:
    """The chambers that a text names before the court, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?i)\b(I{{1,3}})\s+{court}\b"), F.lit(1)), F.upper))


def signature_points(asked: Column, own: Column) -> Column:
    """Points of every pair of an asked and an own signature: the same one, also in another chamber, or the chamber alone."""

    def pair(a: Column, b: Column) -> Column:
        named = a["chamber"] != ""
        same = (a["number"] == b["number"]) & (a["year"] == b["year"])
        agree = a["chamber"] == b["chamber"]
        return F.when(same, F.when(~named | agree, SAME_SIGNATURE).otherwise(OTHER_CHAMBER)).when(named & agree, CHAMBER_ONLY).otherwise(0.0)

    return F.aggregate(asked, F.lit(0.0), lambda s, a: s + F.aggregate(own, F.lit(0.0), lambda t, b: t + pair(a, b)))


def chamber_points(asked: Column, own: Column) -> Column:
    return F.when((F.size(asked) == 0) | (F.size(own) == 0), 0.0).when(F.arrays_overlap(asked, own), SHARED_CHAMBER).otherwise(NO_SHARED_CHAMBER)


def case_points(query: Column, text: Column, cases: Sequence[tuple[str, Sequence[tuple[Sequence[str], float]]]], most: float) -> Column:
    """Sum over the cases (pattern of the query, [(patterns of the text, points)]) of the first line all of whose patterns fit.

    Query and text are lower-cased; a case whose pattern the query lacks counts nothing.
    """
    asked, own = F.lower(normalize_whitespace(F.coalesce(query, F.lit("")))), F.lower(normalize_whitespace(F.coalesce(text, F.lit(""))))

    def points(q: Column, t: Column) -> Column:
        total = F.lit(0.0)
        for pattern, lines in cases:
            fits = F.lit(0.0)
            for wanted, worth in reversed(list(lines)):
                every = F.lit(True)
                for w in wanted:
                    every = every & F.rlike(t, F.lit(w))
                fits = F.when(every, worth).otherwise(fits)
            total = total + F.when(F.rlike(q, F.lit(pattern)), fits).otherwise(0.0)
        return F.least(total, F.lit(most))

    return _let(F.struct(asked.alias("q"), own.alias("t")), lambda x: points(x["q"], x["t"]))


def domain_clash(asked: Column, own: Column) -> Column:
    """Whether both name domains and share none."""
    return F.coalesce((F.size(asked) > 0) & (F.size(own) > 0) & ~F.arrays_overlap(asked, own), F.lit(False))


def judgment_score(named: Column, chamber: Column, share: Column, result: Column, topic: Column, clash: Column, is_judgment: Column, digits: int = 6) -> Column:
    """A judgment's score for a query: its names from -0.35 to 4, with result and topic from -0.75 to 6; others only clash."""
    own = clamped([named, chamber, F.least(share, F.lit(1.0))], -0.35, 4.0)
    score = F.when(is_judgment, own + result + topic).otherwise(0.0) + F.when(clash, CLASHING_DOMAIN).otherwise(0.0)
    return F.round(F.greatest(F.lit(-0.75), F.least(F.lit(6.0), score)), digits)


def field_overlap(expected: Column, actual: Column, in_text: Column) -> Column:
    """1 if an expected value is among the actual ones in any case, 0.5 if none is expected, else the share found in the text."""
    low = lambda c: F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda v: v != ""), F.lower)
    return F.when(F.size(low(expected)) == 0, 0.5).when(F.arrays_overlap(low(expected), low(actual)), 1.0).otherwise(in_text)


def metadata_channel(rows: DataFrame, domains: Column, fields: Sequence[Column], effective: Column, limit: int, query: str = "query_id", key: str = "doc_id", digits: int = 6) -> DataFrame:
    """(query, key, score, rank): a rank list by metadata, for the fusion: domains twice, each field's coverage, 1 if effective.

    The candidates of a query are bounded by the searches that found them.
    """
    score = F.round(sum(fields, 2.0 * domains) + F.coalesce(effective, F.lit(False)).cast("double"), digits)
    scored = rows.select(query, key, score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))).filter(F.col("rank") <= limit)


def source_priority(subtype: Column, legal_state: Column, publication: Column) -> Column:
    """Comparable by priority: codified before consolidated texts before others, then the later legal state and publication.

    Both are compared as text, so dates are ISO dates; null or blank is the least.
    """
    # Kinds of consolidated texts.
    order = F.when(F.lower(subtype) == "codified_text", 2).when(F.lower(subtype) == "consolidated_text", 1).otherwise(0)
    clean = lambda c: normalize_whitespace(F.coalesce(c, F.lit("")))
    return F.struct(order.alias("subtype"), clean(legal_state).alias("legal_state"), clean(publication).alias("publication"))


def preferred_sources(rows: DataFrame, keys: Sequence[str], priority: Column, source: str) -> DataFrame:
    """(keys, source, n_sources): of the sources that give the same unit, the one of highest priority; ties to the smallest.

    A plain aggregate, combined before the shuffle: a unit given by very many sources is no hot key.
    """
    ranked = rows.withColumn("_priority", priority).groupBy(*keys, "_priority").agg(F.min(source).alias(source), F.count("*").alias("_n"))
    return ranked.groupBy(*keys).agg(F.max_by(source, "_priority").alias(source), F.sum("_n").alias("n_sources"))


def rule_specificity(citation: Column, wording: Column, entities: Sequence[str], qualifiers: Sequence[str]) -> Column:
    """1, more for each level that the citation names, 2 for a named entity and 1 for a qualifier in the wording."""
    low = F.lower(normalize_whitespace(F.coalesce(wording, F.lit(""))))
    score = F.lit(1)
    for _, pattern, points in CITATION_POINTS:
        score = score + F.when(F.rlike(F.coalesce(citation, F.lit("")), F.lit(f"(?i){pattern}")), points).otherwise(0)
    has = lambda words: F.greatest(*[F.contains(low, F.lit(w)) for w in words], F.lit(False), F.lit(False))
    return score + F.when(has(entities), 2).otherwise(0) + F.when(has(qualifiers), 1).otherwise(0)


def rules_for_query(rows: DataFrame, haystack: Column, asked: Column, target: Column, specificity: Column, repealed: Column, entities: Sequence[str], dependencies: Column, recency: Sequence[Column], limit: int, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(query, key, overlap, specificity, position): rules of a query, first those that it aims at.

    Then by how many of the query's words (``asked``) stand in the rule, by specificity (2 more for a named entity, 10
    less if repealed), by the definitions that the rule depends on, in force before repealed, later ones before earlier.
    """
    low = F.lower(normalize_whitespace(F.coalesce(haystack, F.lit(""))))
    entity = F.greatest(*[F.contains(F.col("_hay"), F.lit(e)) for e in entities], F.lit(False), F.lit(False))
    rows = rows.withColumn("_hay", low).withColumn("_gone", F.coalesce(repealed, F.lit(False)))
    rows = rows.withColumn("overlap", F.coalesce(F.size(F.filter(F.array_distinct(asked), lambda w: F.contains(F.col("_hay"), w))), F.lit(0)))
    rows = rows.withColumn("specificity", (specificity + F.when(entity, 2).otherwise(0) - F.when(F.col("_gone"), 10).otherwise(0)).cast("int"))
    order = [F.desc(F.coalesce(target, F.lit(False))), F.desc("overlap"), F.desc("specificity"), F.desc(dependencies), "_gone", *[F.desc_nulls_last(c) for c in recency], key]
    placed = rows.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return placed.filter(F.col("position") <= limit).select(query, key, "overlap", "specificity", "position")


def article_excerpt(text: Column) -> Column:
    """The first article of a text, up to the next article's heading; a text without articles as a whole; null if blank."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"{SPACE}+", " "))
    first = F.regexp_extract(clean, rf"(?s)({ARTICLE}.*?)(?:{ARTICLE}|\z)", 1)
    found = F.when(F.rlike(clean, F.lit(ARTICLE)), F.trim(first)).otherwise(clean)
    return F.when(found != "", found)


def opening_quotes(rows: DataFrame, score: Column, asked_domains: Column, own_domains: Column, topics: Column, signed: Sequence[tuple[str, str, float]], asked: str = "query_text", text: str = "text", query: str = "query_id", key: str = "doc_id", digits: int = 6) -> DataFrame:
    """(query, key, score, quote): the statute that an answer opens with, and its first article.

    Only statutes of the query's domains count, if there are any. Points: the search's own, the same domain, each topic
    word of the query in the text, and ``signed``: (pattern of the query, pattern of the text, points), an empty pattern
    fits always and a leading ``!`` negates one. The best statute with a quote is taken, ties to the smaller key.
    """
    own = Window.partitionBy(query)
    rows = rows.withColumn("_fits", F.coalesce(F.arrays_overlap(asked_domains, own_domains), F.lit(False)))
    rows = rows.withColumn("_any", F.max("_fits").over(own)).filter("_fits or not _any")
    low, q = F.lower(normalize_whitespace(F.coalesce(F.col(text), F.lit("")))), F.lower(F.coalesce(F.col(asked), F.lit("")))
    rows = rows.withColumn("_low", low).withColumn("_asked", q)

    def fits(c: str, pattern: str) -> Column:
        return ~F.rlike(c, F.lit(pattern[1:])) if pattern.startswith("!") else F.rlike(c, F.lit(pattern)) if pattern else F.lit(True)

    adjusted = sum((F.when(fits("_asked", a) & fits("_low", b), w).otherwise(0.0) for a, b, w in signed), F.lit(0.0))
    words = F.coalesce(F.size(F.filter(topics, lambda w: F.contains(F.col("_low"), w))), F.lit(0)) * TOPIC_WORD
    rows = rows.withColumn("score", F.round(score + F.when(F.col("_fits"), SAME_DOMAIN).otherwise(0.0) + words + adjusted, digits)).withColumn("quote", article_excerpt(F.col(text)))
    best = rows.filter("quote is not null").withColumn("_rn", F.row_number().over(own.orderBy(F.desc("score"), key)))
    return best.filter("_rn = 1").select(query, key, "score", "quote")


#: Channels of a plan's families in the order in which they are made: type, column of the plan, how many.
PLAN_CHANNELS = (("legal_concepts", "legal_concepts", 2), ("model_soft_expansion", "synonyms", 2))
#: Entries of a dictionary that plans name which are broadcast; more are joined by shuffling.
FEW_ENTRIES = 50_000


def plan_families(plans: DataFrame, dictionary: DataFrame, types: Mapping[str, str], limit: int = 8, plan: str = "plan") -> DataFrame:
    """(plan, position, family_id, type, query, hard, weight): the first families of a plan, in the order in which it names them.

    ``plans`` is (plan, question, locked, detected, legal_concepts, synonyms, roles, counter_roles): the question itself, then for every
    locked entry of the dictionary its name, two provisions and a statutory term, then the names of detected entries whose
    kind ``types`` maps to a family, two concepts, two synonyms, and the names of two roles, if both sides have one. ``dictionary`` is (concept_id,
    name, kind, provisions, statutory). A query counts once a type, spaces and case aside, so one text may stand under two.
    All ids of a plan meet the entries that plans name in one join, and an entry's families are made before it. A plan's
    families are few: they are gathered once and ordered within its row, by functions that run inside generated code.
    """
    empty = F.array().cast("array<string>")
    listed = lambda column: F.coalesce(F.col(column), empty)

    def family(kind, text: Column, hard: bool) -> Column:
        """(type, query, hard, key): equal keys are one family, an empty one is none."""
        kind, clean = kind if isinstance(kind, Column) else F.lit(kind), normalize_whitespace(text)
        key = F.when((clean != "") & kind.isNotNull(), F.concat_ws("\n", kind, F.lower(clean))).otherwise("")
        return F.struct(kind.alias("type"), clean.alias("query"), F.lit(hard).alias("hard"), key.alias("key"))

    channel = lambda kind, column, most, hard: [family(kind, F.get(listed(column), F.lit(i)), hard) for i in range(most)]
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in types.items() for x in pair]), F.col("kind"))
    locked = F.array(family("locked_institution", F.col("name"), True), *channel("verified_provision", "provisions", 2, True), *channel("statutory_language", "statutory", 1, False))
    detected = F.array(family(kind, F.col("name"), False))
    two_sided = F.when((F.size(listed("roles")) > 0) & (F.size(listed("counter_roles")) > 0), F.concat(listed("roles"), listed("counter_roles"))).otherwise(empty)
    named = plans.select(F.explode(F.concat(listed("locked"), listed("detected"), two_sided)).alias("concept_id")).distinct()
    entries = dictionary.join(named, "concept_id", "left_semi").select("concept_id", F.col("name").alias("_name"), locked.alias("_locked"), detected.alias("_detected"))

    # A plan's own texts stand at two places that ask for no entry: first the question, then what follows the detected ones.
    opening = F.array(family("exact_user_phrase", F.col("question"), False))
    closing = F.array(*[x for name, column, most in PLAN_CHANNELS for x in channel(name, column, most, False)])
    asked = F.concat(F.array(F.lit(None), F.lit(None)).cast("array<string>"), listed("locked"), listed("detected"), two_sided)
    # Before the ids are dealt out, so that a plan's texts are normalised once.
    own = plans.select(plan, opening.alias("_opening"), closing.alias("_closing"), asked.alias("_asked"), (F.size(listed("locked")) + 2).alias("_end1"), (F.size(listed("locked")) + F.size(listed("detected")) + 2).alias("_end2"))
    rows = own.select(plan, "_opening", "_closing", "_end1", "_end2", F.posexplode("_asked").alias("_at", "concept_id"))
    met = rows.join(small(stored(entries, "plan-entries"), FEW_ENTRIES), "concept_id", "left")
    at, last = F.col("_at"), F.lit(2**31 - 1)
    families = F.when(at == 0, F.col("_opening")).when(at == 1, F.col("_closing")).when(at < F.col("_end1"), F.col("_locked")).when(at < F.col("_end2"), F.col("_detected"))
    found = F.when(families.isNotNull(), F.struct(F.when(at == 1, last).otherwise(at).alias("at"), families.alias("families")))
    role = F.when((at >= F.col("_end2")) & F.col("_locked").isNotNull(), F.struct("_at", "_name"))
    sets = met.filter("_at < 2 or _locked is not null").select(plan, found.alias("f"), role.alias("r"))
    sets = sets.groupBy(plan).agg(F.sort_array(F.collect_list("f")).alias("_sets"), F.slice(F.sort_array(F.collect_list("r")), 1, 2).alias("_names"))

    both = family("role_and_direction", F.array_join(F.col("_names._name"), " "), False)
    ordered = sets.select(plan, F.concat(F.flatten(F.col("_sets.families")), F.array(both)).alias("_all"))
    keys = F.slice(F.array_remove(F.array_distinct(F.col("_all.key")), ""), 1, limit)
    placed = ordered.select(plan, "_all", F.posexplode(keys).alias("_p", "_key"))
    placed = placed.select(plan, (F.col("_p") + 1).alias("position"), F.element_at("_all", F.array_position("_all.key", F.col("_key")).cast("int")).alias("f")).select(plan, "position", "f.*")
    return placed.select(plan, "position", F.concat_ws("_", "type", F.col("position").cast("string")).alias("family_id"), "type", "query", "hard", F.when(F.col("hard"), 1.4).otherwise(1.0).alias("weight"))
