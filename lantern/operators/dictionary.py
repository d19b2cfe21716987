"""Phrases of a dictionary in texts at word boundaries, and what they mean for its concepts.

Texts and phrases are lower-cased, folded, and have single spaces and plain hyphens. A text is cut into words and
the gaps between them. A phrase is known by a hash of its first words; each word of a text looks its hash up by an equality
join, and only where one is found are the further words and gaps compared. So neither the number of phrases nor that of
texts makes a nested loop. What a concept needs (aliases, contexts, negative contexts) is counted from the hits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions.text import fold
from lantern.operators.lineage import small, stored

WORD = r"[\p{L}\p{N}_]+"
GAP = r"[^\p{L}\p{N}_]+"
BROADCAST_ROWS = 500_000
# Confidence of a match by what was found, best first.
CONFIDENCE = {"exact_phrase": 0.99, "lemma_phrase": 0.95, "safe_regex": 0.94, "abbreviation": 0.93, "colloquial_alias": 0.84, "factual_alias": 0.84, "contextual_inference": 0.61}
#: A concept that only another one's presence suggests.
DERIVED = 0.75
_CONTEXTS = ("required_context", "context_any", "negative_context", "material_concept")


def normalized(c: Column) -> Column:
    """Lower case without marks, hyphens of all kinds as one, and single spaces."""
    plain = F.regexp_replace(fold(c), "[‐-―]", "-")
    return F.trim(F.regexp_replace(plain, r"[\t\n\x0B\f\r\p{Z}]+", " "))


def _pieces(c: Column) -> Column:
    """Words and gaps in turn."""
    return F.regexp_extract_all(c, F.lit(f"{WORD}|{GAP}"), F.lit(0))


def _is_word(c: Column) -> Column:
    return F.rlike(c, F.lit(f"^{WORD}$"))


def _at(pieces: Column, i: Column) -> Column:
    """The piece at a place from 1; an empty one beyond the ends."""
    return F.coalesce(F.get(pieces, i - 1), F.lit(""))


def _anchors(pieces: Column, i: Column) -> Column:
    """Hash of the word at a place, and of it with the gap and the word that follow."""
    return F.array(F.xxhash64(_at(pieces, i)), F.xxhash64(_at(pieces, i), _at(pieces, i + 1), _at(pieces, i + 2)))


def _prepared(phrases: DataFrame) -> DataFrame:
    """(phrase, core, lead, trail, anchor): phrases with a word; ``core`` goes from the first word to the last."""
    own = phrases.select("phrase").distinct().withColumn("_pieces", _pieces(normalized(F.col("phrase"))))
    size = F.size("_pieces")
    first = F.when(_is_word(_at(F.col("_pieces"), F.lit(1))), 1).otherwise(2)
    last = F.when(_is_word(_at(F.col("_pieces"), size)), size).otherwise(size - 1)
    own = own.filter(size > 0).withColumn("_first", first).withColumn("_last", last).filter("_last >= _first")
    core = F.slice("_pieces", F.col("_first"), F.col("_last") - F.col("_first") + 1)
    lead = F.when(F.col("_first") == 2, _at(F.col("_pieces"), F.lit(1))).otherwise("")
    trail = F.when(F.col("_last") < size, _at(F.col("_pieces"), size)).otherwise("")
    anchors = _anchors(core, F.lit(1))
    return own.select("phrase", core.alias("core"), lead.alias("lead"), trail.alias("trail"), F.when(F.size(core) == 1, anchors[0]).otherwise(anchors[1]).alias("anchor"))


def phrase_hits(texts: DataFrame, phrases: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, phrase, n): the phrases (phrase) that stand in a text at word boundaries, and how often.

    A phrase may begin or end with other characters than words, which must then stand there too, beside no further word.
    Phrases without any word, null or empty texts, and null phrases match nothing; texts with equal keys are counted
    together. If the phrases are too many to be broadcast, only as many words as the longest phrase has go with each
    word of a text into the shuffle.
    """
    known = stored(_prepared(phrases), "phrases")
    longest = known.agg(F.coalesce(F.max(F.size("core")), F.lit(1))).first()[0]
    own = texts.select(F.col(key).alias("_key"), _pieces(normalized(F.coalesce(F.col(column).cast("string"), F.lit("")))).alias("_e"))
    first = F.when(_is_word(_at(F.col("_e"), F.lit(1))), 1).otherwise(2)
    places = F.when(F.size("_e") >= first, F.sequence(first, F.size("_e"), F.lit(2)))
    # Up to a broadcast join all is generated code that hands a text's pieces on without copying them for each word;
    # a lambda in between would break that and cost the square of a text's length.
    words = own.select("_key", "_e", F.explode(places).alias("_i"))
    words = words.select("_key", "_e", "_i", F.explode(_anchors(F.col("_e"), F.col("_i"))).alias("anchor"))
    dictionary = small(known, BROADCAST_ROWS)
    e, i, leads = F.col("_e"), F.col("_i"), F.col("_i") == 2  # the text begins with the gap
    if dictionary is known:
        # As many words as the longest phrase has, and one piece before and two after, go with a word into the shuffle.
        words = words.select("_key", "anchor", F.slice("_e", F.greatest(i - 1, F.lit(1)), F.lit(longest + 3)).alias("_e"), F.least(i, F.lit(2)).alias("_i"), leads.alias("_leads"))
        leads = F.col("_leads")
    met = words.join(dictionary, "anchor").filter(F.slice("_e", i, F.size("core")) == F.col("core"))
    before, after, beyond = _at(e, i - 1), _at(e, i + F.size("core")), _at(e, i + F.size("core") + 1)
    led = (F.col("lead") == "") | F.endswith(before, F.col("lead")) & ((F.length(before) > F.length("lead")) | leads)
    trailed = (F.col("trail") == "") | F.startswith(after, F.col("trail")) & ((F.length(after) > F.length("trail")) | (beyond == ""))
    return met.filter(led & trailed).groupBy(F.col("_key").alias(key), "phrase").agg(F.count("*").alias("n"))


def pattern_hits(texts: DataFrame, patterns: Sequence[tuple[str, str]], key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, concept_id, phrase): the stated patterns (concept_id, pattern) that fit a normalised text, in one narrow pass."""
    if not patterns:
        return texts.select(key, F.lit("").alias("concept_id"), F.lit("").alias("phrase")).limit(0)
    own = texts.select(F.col(key), normalized(F.coalesce(F.col(column).cast("string"), F.lit(""))).alias("_t"))
    fits = [F.when(F.rlike("_t", F.lit(p)), F.struct(F.lit(c).alias("concept_id"), F.lit(p).alias("phrase"))) for c, p in patterns]
    return own.select(key, F.explode(F.array_compact(F.array(*fits))).alias("x")).select(key, "x.concept_id", "x.phrase").distinct()


def _signals(texts: DataFrame, phrases: DataFrame, patterns: Sequence[tuple[str, str]], key: str, column: str) -> DataFrame:
    """(key, concept_id, kind, place, phrase) of what each concept has in each text."""
    own = phrases.select("concept_id", "kind", "place", "phrase")
    hits = phrase_hits(texts, own, key, column).select(key, "phrase").join(small(stored(own, "dictionary"), BROADCAST_ROWS), "phrase")
    fits = pattern_hits(texts, patterns, key, column)
    return hits.select(key, "concept_id", "kind", "place", "phrase").unionByName(fits.select(key, "concept_id", F.lit("safe_regex").alias("kind"), F.lit(0).alias("place"), "phrase"))


def _of(kind: str) -> Column:
    return F.col("kind") == kind


def _counted(signals: DataFrame, phrases: DataFrame, order: Sequence[str], key: str) -> DataFrame:
    """One row per text and concept: its best alias, and how many of its contexts the text has and asks for."""
    priority = F.lit(None).cast("int")
    for n, kind in reversed(list(enumerate(order))):
        priority = F.when(_of(kind), n).otherwise(priority)
    best = F.min(F.when(priority.isNotNull(), F.struct(priority.alias("priority"), "place", "kind", "phrase")))
    evidence = F.array_sort(F.collect_set(F.when(_of("required_context") | _of("context_any"), F.struct(_of("context_any").alias("any"), "place", "phrase"))))
    counts = [F.count_if(_of(k)).alias(k) for k in _CONTEXTS]
    found = signals.groupBy(key, "concept_id").agg(best.alias("best"), F.transform(evidence, lambda x: x["phrase"]).alias("evidence"), *counts)
    asked = phrases.select("concept_id", "kind", "phrase").distinct().groupBy("concept_id").agg(F.count_if(_of("required_context")).alias("asked"), (F.count_if(_of("context_any")) > 0).alias("any_asked"))
    return found.join(small(stored(asked, "asked"), BROADCAST_ROWS), "concept_id", "left").fillna(0, ["asked"]).fillna(False, ["any_asked"])


def _confidence(kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in CONFIDENCE.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def _listed(concepts: DataFrame) -> DataFrame:
    own = concepts.filter(~F.col("status").isin("disabled", "draft")).select("concept_id", "concept_type", "status", F.coalesce("strict", F.lit(False)).alias("strict"))
    return small(stored(own, "concepts"), BROADCAST_ROWS)


def recognised(texts: DataFrame, concepts: DataFrame, phrases: DataFrame, patterns: Sequence[tuple[str, str]] = (), key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, concept_id, concept_type, kind, phrase, confidence, locked, evidence): the concepts of each text.

    ``concepts`` is (concept_id, concept_type, status, strict), ``phrases`` (concept_id, kind, place, phrase) with aliases of the
    kinds of CONFIDENCE and contexts (``required_context``, ``context_any``, ``negative_context``), ``place`` giving their
    order; ``patterns`` count only where no alias is found. Disabled and draft concepts are none.

    A match is locked if its concept is active, the text has all required contexts, one of ``context_any`` if there are any,
    and no negative one; a strict concept needs some evidence besides.
    """
    order = ("exact_phrase", "lemma_phrase", "abbreviation", "colloquial_alias", "factual_alias", "safe_regex")
    found = _counted(_signals(texts, phrases, patterns, key, column), phrases, order, key).filter("best is not null").join(_listed(concepts), "concept_id")
    locked = (F.col("status") == "active") & (F.col("negative_context") == 0) & (F.col("required_context") == F.col("asked")) & (~F.col("any_asked") | (F.col("context_any") > 0)) & (~F.col("strict") | (F.size("evidence") > 0))
    return found.select(key, "concept_id", "concept_type", F.col("best.kind").alias("kind"), F.col("best.phrase").alias("phrase"), _confidence(F.col("best.kind")).alias("confidence"), locked.alias("locked"), "evidence")


def institutions(texts: DataFrame, concepts: DataFrame, phrases: DataFrame, patterns: Sequence[tuple[str, str]] = (), key: str = "doc_id", column: str = "text") -> DataFrame:
    """As ``recognised``, by the rules of named institutions: (key, concept_id, kind, phrase, confidence, locked, context_satisfied).

    Patterns come after lemmas. An exact phrase needs its context only if the institution is strict. Where no alias is found,
    two material concepts with a satisfied and no negative context suggest an institution, which is never locked.
    """
    order = ("exact_phrase", "lemma_phrase", "safe_regex", "abbreviation", "colloquial_alias")
    found = _counted(_signals(texts, phrases, patterns, key, column), phrases, order, key).join(_listed(concepts), "concept_id")
    context = (F.col("required_context") == F.col("asked")) & (~F.col("any_asked") | (F.col("context_any") > 0))
    inferred = F.col("best").isNull() & (F.col("material_concept") >= 2) & context & (F.col("negative_context") == 0)
    kind = F.coalesce(F.col("best.kind"), F.when(inferred, "contextual_inference"))
    satisfied = F.when((kind == "exact_phrase") & ~F.col("strict"), True).otherwise(context)
    rows = found.withColumn("kind", kind).withColumn("context_satisfied", satisfied).filter("kind is not null")
    locked = (F.col("status") == "active") & (F.col("kind") != "contextual_inference") & F.col("context_satisfied") & (F.col("negative_context") == 0)
    return rows.select(key, "concept_id", "kind", F.coalesce(F.col("best.phrase"), F.lit("contextual_signals")).alias("phrase"), _confidence(F.col("kind")).alias("confidence"), locked.alias("locked"), "context_satisfied")


def with_related(found: DataFrame, related: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, concept_id, kind, confidence, locked): matches, and concepts (concept_id, related_id) related to them.

    A related concept that the text hasn't itself has the confidence of its origin, DERIVED at most, and is never locked.
    """
    own = stored(found.select(key, "concept_id", "kind", "confidence", "locked"), "recognised")
    near = own.join(small(stored(related.select("concept_id", "related_id").distinct(), "related"), BROADCAST_ROWS), "concept_id")
    derived = near.groupBy(key, F.col("related_id").alias("concept_id")).agg(F.max(F.least("confidence", F.lit(DERIVED))).alias("confidence"))
    derived = derived.join(own.select(key, "concept_id"), [key, "concept_id"], "left_anti")
    return own.unionByName(derived.select(key, "concept_id", F.lit("related_concept").alias("kind"), "confidence", F.lit(False).alias("locked")))


def incompatible(found: DataFrame, pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, concept_id, incompatible_with): matches that exclude another one of the same text."""
    asked = found.select(key, "concept_id").join(small(stored(pairs.select("concept_id", "incompatible_with").distinct(), "incompatible"), BROADCAST_ROWS), "concept_id")
    return asked.join(found.select(key, F.col("concept_id").alias("incompatible_with")), [key, "incompatible_with"], "left_semi").select(key, "concept_id", "incompatible_with")


def document_markers(texts: DataFrame, markers: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, concept_id, markers): a concept's markers (concept_id, place, phrase) that a document has, in their order."""
    own = stored(markers.select("concept_id", "place", "phrase"), "markers")
    met = phrase_hits(texts, own, key, column).join(small(own, BROADCAST_ROWS), "phrase")
    return met.groupBy(key, "concept_id").agg(F.array_sort(F.collect_set(F.struct("place", "phrase"))).alias("_m")).select(key, "concept_id", F.transform("_m", lambda x: x["phrase"]).alias("markers"))
