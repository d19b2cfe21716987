"""Text functions as Columns; all run inside generated code.

Patterns use explicit character classes, so that other engines with other ideas of ``\\w`` agree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[ \\t\\n\\r\\f\\x0B]"
TOKEN = "[0-9A-Za-zÀ-ÖØ-öø-ÿĄĆĘŁŃŚŹŻąćęłńśźż]"
#: What is left of TOKEN in lower-cased text; fewer ranges are matched faster.
LOWER_TOKEN = "[a-z0-9ß-öø-ÿąćęłńśźż]"
# Reference to a provision, and the labels and patterns of personal data in the order they are applied.
CITATION = rf"art\.{SPACE}*[0-9]+[a-z]*(?:{SPACE}*(?:ust\.{SPACE}*[0-9]+[a-z]*|§{SPACE}*[0-9]+[a-z]*))?(?:{SPACE}*pkt{SPACE}*[0-9]+[a-z]*)?(?:{SPACE}*lit\.{SPACE}*[a-z])?"
PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "national_id": r"\b[0-9]{11}\b",
    "tax_id": r"\b[0-9]{3}-[0-9]{3}-[0-9]{2}-[0-9]{2}\b",
    "phone": r"\+[0-9]{1,3}[ -]?[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{3,4}\b",
}
#: What each match of those patterns has in it.
PERSONAL_NEEDS = {"email": "@", "tax_id": "-", "phone": "+"}
#: Suffixes that the light stemmer takes off, longest first.
SUFFIXES = ("ements", "ement", "tions", "ation", "tion", "ings", "ing", "ment", "edly", "ed", "ly", "es", "s")


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def cut_boilerplate(c: Column, openings: Sequence[str]) -> Column:
    """The text before the first line that opens with one of the phrases, whatever their case."""
    lines = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\r", "\n")
    at = F.regexp_instr(lines, F.lit(r"(?i)\n(?:" + "|".join(openings) + ")"))
    return F.trim(F.when(at > 0, F.substring(lines, F.lit(1), at - 1)).otherwise(lines))


def tokens(c: Column, least: int = 3) -> Column:
    """Lower-cased tokens of at least so many letters or digits, in order, with repeats."""
    return F.regexp_extract_all(F.lower(c), F.lit(LOWER_TOKEN + "{" + str(least) + ",}"), F.lit(0))


def query_tokens(c: Column, most: int = 24, least: int = 3) -> Column:
    """The first distinct tokens; a full-text query matches any of them as a prefix."""
    return F.slice(F.array_distinct(tokens(c, least)), 1, most)


def stem(c: Column) -> Column:
    """The token without the first suffix of the list that leaves four letters."""
    out = c
    for suffix in reversed(SUFFIXES):
        fits = c.endswith(suffix) & (F.length(c) >= len(suffix) + 4)
        out = F.when(fits, F.left(c, F.length(c) - len(suffix))).otherwise(out)
    return out


def normalize_citation(c: Column) -> Column:
    c = normalize_whitespace(F.lower(c))
    c = F.regexp_replace(F.replace(c, F.lit("artykuł"), F.lit("art.")), r"\bart ?\.", "art.")
    return F.regexp_replace(F.regexp_replace(c, " *, *", " "), r"^[ .;:,]+|[ .;:,]+$", "")


def citations(c: Column, pattern: str = CITATION) -> Column:
    """Distinct normalised references of a text, in order of first mention."""
    found = F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, normalize_citation), lambda x: x != ""))


def citation_slug(source: Column, citation: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(normalize_citation(citation), "[^0-9a-z]+", "_"), "^_+|_+$", "")
    return F.concat(source.cast("string"), F.lit(":"), F.when(slug == "", F.lit("provision")).otherwise(slug))


def match_specificity(required: Column, found: Column) -> Column:
    """2: the same reference; 1: a part of it; 0: another."""
    return F.when(found == required, 2).when(F.startswith(found, F.concat(required, F.lit(" "))), 1).otherwise(0)


def redact(c: Column, patterns: Mapping[str, str] = PERSONAL, needs: Mapping[str, str] = PERSONAL_NEEDS) -> tuple[Column, Column]:
    """The text with personal data replaced, and the labels that were found, in order.

    ``needs`` names a string that every match of a pattern has: a text without it isn't searched.
    """
    labels = []
    for label, pattern in patterns.items():
        found = F.rlike(c, F.lit(pattern))
        if label in needs and patterns[label] == PERSONAL.get(label):
            found = F.contains(c, F.lit(needs[label])) & found
        labels.append(F.when(found, F.lit(label)))
        c = F.when(found, F.regexp_replace(c, pattern, f"[REDACTED_{label.upper()}]")).otherwise(c)
    return c, F.array_compact(F.array(*labels))


def fold(c: Column) -> Column:
    """Lower case without the marks of Western and Polish letters."""
    plain = {"àáâãäåą": "a", "çć": "c", "èéêëę": "e", "ìíîï": "i", "ñń": "n", "òóôõöø": "o", "ùúûü": "u", "ýÿ": "y", "ł": "l", "ś": "s", "źż": "z"}
    return F.translate(F.lower(c), "".join(plain), "".join(v * len(k) for k, v in plain.items()))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether all tokens of the phrase, of which there is one, are among the text's; see ``coverage``."""
    own = F.array_distinct(tokens(phrase, 2))
    return (F.size(own) > 0) & (F.size(F.array_except(own, F.array_distinct(tokens(text, 2)))) == 0)


def coverage(text: Column, phrases: Column) -> Column:
    """Share of the non-blank phrases that the text has; 0.5 where nothing is asked for."""
    words = F.array_distinct(tokens(text, 2))
    asked = F.filter(phrases, lambda p: F.trim(p) != "")
    own = lambda p: F.array_distinct(tokens(p, 2))
    hit = F.filter(asked, lambda p: (F.size(own(p)) > 0) & (F.size(F.array_except(own(p), words)) == 0))
    return F.when(F.size(asked) > 0, F.size(hit) / F.size(asked)).otherwise(F.lit(0.5))


def labels_of(c: Column, markers: Mapping[str, Sequence[str]]) -> Column:
    """All labels one of whose markers the lower-cased text contains."""
    low = F.lower(c)
    any_of = lambda words: F.greatest(*[F.contains(low, F.lit(w)) for w in words], F.lit(False))
    return F.array_compact(F.array(*[F.when(any_of(words), F.lit(label)) for label, words in markers.items()]))


def first_label(c: Column, markers: Mapping[str, Sequence[str]], otherwise: str) -> Column:
    """The first label, in order of priority, one of whose markers the text contains."""
    found = labels_of(c, markers)
    return F.when(F.size(found) > 0, F.element_at(found, 1)).otherwise(F.lit(otherwise))


def chunk_id(document: Column, index: Column, text: Column) -> Column:
    """24 hexadecimal digits of the identity of a chunk."""
    return F.left(F.sha2(F.concat_ws(":", document.cast("string"), index.cast("string"), text).cast("binary"), 256), F.lit(24))


def fingerprint(content_hash: Column, version: str) -> Column:
    """Changes with the content or with the version of the index."""
    return F.sha2(F.concat(F.coalesce(content_hash, F.lit("")), F.lit("\0" + version)).cast("binary"), 256)


def json_list(c: Column) -> Column:
    """A JSON list of strings; anything else is an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def sections(c: Column, headings: Sequence[str]) -> Column:
    """Map from the headings that stand alone on a line to the text up to the next one."""
    lines = F.transform(F.split(c, "\n"), normalize_whitespace)
    known = [h.lower() for h in headings]
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def between(ls: Column, marks: Column) -> Column:
        # Each heading's lines reach to the next heading: every line is copied once, however long the text.
        end = lambda j: F.coalesce(F.get(marks, j + 1)["i"], F.size(ls))
        return F.transform(marks, lambda m, j: F.struct(m["h"].alias("h"), F.array_join(F.filter(F.slice(ls, m["i"] + 2, end(j) - m["i"] - 1), lambda x: x != ""), " ").alias("t")))

    def folded(parts: Column) -> Column:
        names = F.array_distinct(F.transform(parts, lambda p: p["h"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(F.transform(F.filter(parts, lambda p: p["h"] == n), lambda p: p["t"]), " ")))

    def marked(ls: Column) -> Column:
        places = F.transform(ls, lambda x, i: F.struct(F.lower(x).alias("h"), i.alias("i")))
        return F.filter(places, lambda m: m["h"].isin(*known))

    return once(lines, lambda ls: once(marked(ls), lambda marks: once(F.filter(between(ls, marks), lambda p: p["t"] != ""), folded)))
