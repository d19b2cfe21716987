"""Predicates that narrow a corpus before anything is ranked, and gates of relevance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.functions.text import normalize_whitespace


def of_kinds(kind: Column, wanted: Sequence[str], wider: Mapping[str, Sequence[str]]) -> Column:
    """Whether a kind is wanted, or is one that a wanted generic kind stands for."""
    asked = {w.lower() for w in wanted if w}
    return F.lower(kind).isin(*sorted(asked | {x for w in asked for x in wider.get(w, ())}))


def in_domains(domain: Column, provisions: Column, wanted: Sequence[str]) -> Column:
    """Whether the domain is wanted, or a provision bears a wanted domain in brackets. Nothing wanted: all."""
    if not wanted:
        return F.lit(True)
    names = sorted({w.upper() for w in wanted})
    tagged = F.exists(provisions, lambda p: F.greatest(*[F.contains(p, F.lit(f"[{n}]")) for n in names], F.lit(False)))
    return F.coalesce(F.upper(domain).isin(*names), F.lit(False)) | F.coalesce(tagged, F.lit(False))


def any_key(values: Column, wanted: Sequence[str]) -> Column:
    """Whether an array has any of the wanted values; a null array has none."""
    return F.coalesce(F.arrays_overlap(values, F.array(*[F.lit(w) for w in wanted])), F.lit(False))


def filtered(rows: DataFrame, wanted: Mapping[str, Sequence | None]) -> DataFrame:
    """The rows that meet every given filter; None is no filter. Arrays must overlap, other columns be in the list.

    Filters stand below whatever limit follows, so that they reach the scan.
    """
    for column, values in wanted.items():
        if values is not None:
            is_array = isinstance(rows.schema[column].dataType, T.ArrayType)
            rows = rows.filter(any_key(F.col(column), values) if is_array else F.col(column).isin(*values))
    return rows


def quote_only(text: Column, quotes: str, resolutions: Sequence[str], reference: str, least: int = 2) -> Column:
    """Whether a text only quotes the law: it fits ``quotes``, decides nothing, and has enough references."""
    low = F.lower(normalize_whitespace(text))
    decides = F.greatest(*[F.contains(low, F.lit(r)) for r in resolutions], F.lit(False))
    count = (F.length(low) - F.length(F.replace(low, F.lit(reference), F.lit("")))) / len(reference)
    return F.coalesce((low != "") & F.rlike(low, F.lit(quotes)) & ~decides & (count >= least), F.lit(False))


def materially_relevant(facts: Sequence[Column], provision: Column, has_facts: Column, has_provisions: Column, exempt: Column, wrong: Column, least: float = 0.15) -> Column:
    """Whether a candidate shares material facts or provisions, as far as the issue names any.

    An exempt kind always does; a wrong neighbour never. ``facts`` are component scores.
    """
    fact = F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in facts]) >= least
    scoped = F.when(has_facts & has_provisions, fact & provision).when(has_facts, fact).otherwise(provision)
    return exempt | ~wrong & scoped


def relevance(required: Column, matched: Column, domain: Column, mechanism: Column, provision: Column, material: Mapping[str, Column], core: Sequence[str], asked: Mapping[str, Column]) -> Column:
    """The relation of a document to a question: direct, strong_analogy, different_mechanism, context_only, irrelevant.

    ``material`` are axes that hold where the question asks for nothing; a core axis counts for an analogy only where
    it is asked for.
    """
    every = F.lit(True)
    for c in material.values():
        every &= c
    any_core = F.lit(False)
    for name in core:
        any_core |= asked[name] & material[name]
    return (
        F.when(required & ~matched, "irrelevant")
        .when(matched & mechanism & domain & every, "direct")
        .when(matched & mechanism & domain & provision & any_core, "strong_analogy")
        .when(matched & ~mechanism, "different_mechanism")
        .when(matched, "context_only")
        .otherwise("irrelevant")
    )


def of_country(text: Column, query: Column, countries: Column) -> Column:
    """Whether a text names a country that the query names; a query that names none takes any text."""
    low, asked = F.lower(text), F.lower(query)
    named = F.filter(countries, lambda c: F.contains(asked, F.lower(c)))
    return (F.size(named) == 0) | F.exists(named, lambda c: F.contains(low, F.lower(c)))
