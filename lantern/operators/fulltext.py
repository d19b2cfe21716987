"""Full-text candidates: postings, field-weighted BM25 with prefix terms, and bounded fast paths."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.text import query_tokens, tokens
from lantern.operators.lineage import small, stored

K1, B = 1.2, 0.75
#: Letters of the shortest token that a query looks for.
LEAST = 3
#: Query tokens that are broadcast to the documents; more are joined by shuffling.
BROADCAST_ROWS = 500_000
#: Query tokens that go to the tasks as values, so that texts are counted by them where they are read.
TOKENS_IN_SCAN = 100_000
#: Texts that are counted at once, and terms whose beginnings a worker keeps.
TEXT_BLOCK, KEPT_TERMS = 500, 200_000
#: Phrases that are held against every text; more are met by their first characters, so many at most.
FEW_PHRASES, GRAM = 64, 4


def occurrences(documents: DataFrame, fields: Mapping[str, float], key: str = "doc_id", least: int = 1) -> DataFrame:
    """(key, length, term, w): one row a token, with its field's weight; ``length`` counts the document's tokens.

    Each document has one row besides with an empty term and weight 1, from which documents and lengths are counted.
    """
    def weighted(c: str, w: float) -> Column:
        return F.transform(tokens(F.coalesce(F.col(c).cast("string"), F.lit("")), least), lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w")))

    words = F.concat(*[weighted(c, w) for c, w in fields.items()])
    rows = documents.select(F.col(key), words.alias("words")).select(key, F.size("words").alias("length"), "words")
    return rows.select(key, "length", F.explode(F.array_append("words", F.struct(F.lit("").alias("term"), F.lit(1.0).alias("w")))).alias("x")).select(key, "length", "x.term", "x.w")


def counted(documents: DataFrame, fields: Mapping[str, float], key: str = "doc_id", least: int = 1, wanted: frozenset[str] | None = None) -> DataFrame:
    """(key, length, term, w): ``occurrences`` added up within each row of the documents, without a hash table of a task's terms.

    With ``wanted``, the terms are those of its tokens with which the text's terms begin, as in ``matches``; others go
    no further than the block of texts that they stand in.
    """
    kind = documents.schema[key].dataType.simpleString()
    weights = [float(w) for w in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: dict[str, list[str]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXT_BLOCK):
                part = batch.slice(lo, TEXT_BLOCK)
                lists = [part.column(1 + i) for i in range(len(weights))]
                doc = np.concatenate([np.repeat(np.arange(part.num_rows), x.value_lengths().to_numpy()) for x in lists])
                length = np.bincount(doc, minlength=part.num_rows)
                w = np.concatenate([np.full(len(x.flatten()), y) for x, y in zip(lists, weights)])
                coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
                terms, code = coded.dictionary, coded.indices.to_numpy()
                if wanted is not None:
                    doc, terms, code, w = _begun(doc, terms.to_pylist(), code, w, begun)
                # The row of each document itself has the empty term.
                terms = pa.concat_arrays([terms, pa.array([""], pa.string())])
                every = np.concatenate([doc * len(terms) + code, np.arange(1, part.num_rows + 1) * len(terms) - 1])
                found, at = np.unique(every, return_inverse=True)
                sums = np.bincount(at, np.concatenate([w, np.ones(part.num_rows)]))
                own = found // len(terms)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(length[own], pa.int32()), terms.take(pa.array(found % len(terms))), pa.array(sums)], names=["key", "length", "term", "w"])

    def _begun(doc: np.ndarray, terms: list[str], code: np.ndarray, w: np.ndarray, begun: dict[str, list[str]]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """The same occurrences by the wanted tokens with which their terms begin; each term brings its run of tokens."""
        if len(begun) > KEPT_TERMS:
            begun.clear()
        for t in terms:
            if t not in begun:
                begun[t] = [t[:n] for n in range(LEAST, len(t) + 1) if t[:n] in wanted]
        size = np.array([len(begun[t]) for t in terms], np.int64)
        tokens_of = pa.array([x for t in terms for x in begun[t]], pa.string()).dictionary_encode()
        first, n = np.cumsum(size) - size, size[code]
        ends = np.cumsum(n)
        place = np.repeat(first[code] - (ends - n), n) + np.arange(n.sum())
        return np.repeat(doc, n), tokens_of.dictionary, tokens_of.indices.to_numpy()[place], np.repeat(w, n)

    words = [tokens(F.coalesce(documents[c].cast("string"), F.lit("")), least).alias(f"_{i}") for i, c in enumerate(fields)]
    return documents.select(documents[key].alias("key"), *words).mapInArrow(run, f"key {kind}, length int, term string, w double").withColumnRenamed("key", key)


def terms_of(queries: DataFrame, key: str = "query_id", column: str = "text", most: int = 24) -> DataFrame:
    """(query, position, token): the tokens that a query looks for, each as a prefix."""
    return queries.select(key, F.posexplode(query_tokens(F.col(column), most)).alias("position", "token"))


def matches(words: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(token, key, length, weighted_tf): documents with a term that begins with a wanted token.

    ``wanted`` has each token once, whatever the number of queries that look for it. A term is exploded into its beginnings
    of LEAST letters and more, so that a prefix is an equality join, and a frequent beginning meets no tokens but its own.
    Words that no query looks for go no further than the task that read them. The empty token finds the empty term.
    """
    lengths = F.when(F.length("term") >= LEAST, F.sequence(F.lit(LEAST), F.length("term"))).when(F.col("term") == "", F.array(F.lit(0)))
    begins = words.withColumn("_n", F.explode(lengths)).withColumn("token", F.left("term", F.col("_n")))
    found = begins.join(wanted.select("token"), "token")
    return found.groupBy("token", key, "length").agg(F.sum("w").alias("weighted_tf"))


def bm25(hits: DataFrame, wanted: DataFrame, query: str = "query_id", key: str = "doc_id", digits: int = 6, rows: int = BROADCAST_ROWS, total: DataFrame | None = None) -> DataFrame:
    """(query, key, score): BM25 over prefix tokens; higher is better.

    ``hits`` is as from ``matches``; ``wanted`` is (query, token). ``total`` is one row (n, mean_length); without it, ``hits`` has
    the documents' own rows under the empty token.
    A token's weight in a document is the same for all queries, so hits are dealt by document once and scores need no
    further exchange.
    """
    own = hits.filter("token = ''")
    total = total if total is not None else own.agg(F.sum("weighted_tf").alias("n"), (F.sum(F.col("weighted_tf") * F.col("length")) / F.sum("weighted_tf")).alias("mean_length"))
    df = hits.filter("token <> ''").groupBy("token").agg(F.count("*").alias("df"))
    asked = small(stored(wanted.join(df, "token").select(query, "token", "df"), "asked"), rows)
    tf = F.col("weighted_tf")
    by_document = hits.filter("token <> ''").repartition(F.col(key)).join(F.broadcast(total), F.lit(True))  # one row
    weight = by_document.select("token", key, "n", (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))).alias("_part"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    return weight.join(asked, "token").groupBy(query, key).agg(F.round(F.sum(idf * F.col("_part")), digits).alias("score"))


def ranked(scores: DataFrame, by: str = "query_id", key: str = "doc_id", score: str = "score", limit: int | None = None) -> DataFrame:
    """``rank`` from 1 within each query: score descending, then key; a limit is pushed into the window."""
    w = Window.partitionBy(by).orderBy(F.desc(score), key)
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def search(documents: DataFrame, queries: DataFrame, fields: Mapping[str, float], limit: int, key: str = "doc_id", query: str = "query_id", most: int = 24) -> DataFrame:
    """(query, key, score, rank): the best documents of every query at once.

    Texts are read once: what the wanted tokens meet is written, and frequencies, lengths and scores come from it.
    """
    wanted = stored(terms_of(queries, query, most=most).select(query, "token").distinct(), "wanted")
    asked = wanted.select("token").distinct()
    few = [r[0] for r in asked.limit(TOKENS_IN_SCAN + 1).collect()]
    if len(few) <= TOKENS_IN_SCAN:
        found = counted(documents, fields, key, wanted=frozenset(few)).repartition(F.col(key))
        hits = found.groupBy(F.col("term").alias("token"), key, "length").agg(F.sum("w").alias("weighted_tf"))
    else:
        every = asked.union(documents.sparkSession.createDataFrame([("",)], "token string"))
        hits = matches(counted(documents, fields, key), small(stored(every, "every-token"), BROADCAST_ROWS), key)
    hits = stored(hits, "hits")
    return ranked(bm25(hits, wanted, query, key), query, key, limit=limit)


def containing(documents: DataFrame, phrases: DataFrame, key: str = "doc_id", column: str = "text", phrase_key: str = "query_id", phrase: str = "query_text") -> DataFrame:
    """(phrase_key, key): the documents whose text contains a phrase, character for character; rows may repeat.

    A phrase of five pieces between spaces or more has three in its inside that stand in the text as they are: they
    are joined by hash, and what meets is checked in full. Shorter phrases go by their first characters (``holding``).
    """
    pieces = F.split(F.col(phrase), " ")
    wanted = phrases.filter(F.col(phrase).isNotNull()).select(F.col(phrase_key), F.col(phrase).alias("_phrase"), F.size(pieces).alias("_size"), F.xxhash64(*[F.get(pieces, F.lit(k)) for k in (1, 2, 3)]).alias("_anchor"))
    wanted = stored(wanted, "phrases")
    texts = documents.select(F.col(key), F.col(column).alias("_text"))
    own = texts.withColumn("_pieces", F.split("_text", " ")).filter(F.size("_pieces") >= 5)
    anchors = F.transform(F.sequence(F.lit(1), F.size("_pieces") - 4), lambda i: F.xxhash64(*[F.element_at("_pieces", i + k) for k in (1, 2, 3)]))
    met = own.select(key, "_text", F.explode(F.array_distinct(anchors)).alias("_anchor")).join(small(wanted.filter("_size >= 5"), BROADCAST_ROWS), "_anchor")
    short = holding(texts, wanted.filter("_size < 5").select(phrase_key, "_phrase"), "_phrase", key, "_text")
    return met.filter(F.contains("_text", F.col("_phrase"))).select(phrase_key, key).union(short.select(phrase_key, key))


def holding(texts: DataFrame, phrases: DataFrame, phrase: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, columns of ``phrases``): every text with every phrase in it, character for character, parts of words too.

    At most FEW_PHRASES phrases are broadcast and held against each text. More of them are met by equality with their
    first GRAM characters (a shorter phrase with all of its own), each of which a text has once, and what meets is
    checked against the text. An empty phrase is in every text, a null one in none. Rows repeat if a key does.
    """
    wanted = stored(phrases.filter(F.col(phrase).isNotNull()), "held")
    own = texts.select(F.col(key), F.col(column).alias("_held"))
    if wanted.limit(FEW_PHRASES + 1).count() <= FEW_PHRASES:
        return own.join(F.broadcast(wanted), F.contains("_held", F.col(phrase))).drop("_held")
    letters = F.split("_letters", "")
    of = lambda n: F.when(F.length("_letters") >= n, F.transform(F.sequence(F.lit(1), F.length("_letters") - (n - 1)), lambda i: F.concat(*[F.element_at("_split", i + k) for k in range(n)])))
    grams = F.flatten(F.array_compact(F.array(F.array(F.lit("")), *[F.array_distinct(of(n)) for n in range(1, GRAM + 1)])))
    sizes = [r[0] for r in wanted.select(F.least(F.length(phrase), F.lit(GRAM)).alias("n")).distinct().collect()]  # GRAM + 1 values at most
    anchors = small(wanted.withColumn("_gram", F.left(phrase, F.lit(GRAM))), BROADCAST_ROWS)
    split = own.filter("_held is not null").select(F.col(key), F.col("_held").alias("_letters")).withColumn("_split", letters)
    found = split.select(F.col(key), F.explode(F.filter(grams, lambda g: F.length(g).isin(*sizes))).alias("_gram")).join(anchors, "_gram").drop("_gram")
    named = own.select(F.col(key).alias("_key"), "_held")
    return found.join(named, F.col(key).eqNullSafe(F.col("_key")) & F.contains("_held", F.col(phrase))).drop("_key", "_held")


def additive_score(text: Column, phrases: Column) -> Column:
    """How many of the phrases the lower-cased text contains."""
    low = F.lower(text)
    return F.aggregate(phrases, F.lit(0), lambda s, p: s + F.contains(low, F.lower(p)).cast("int"))


def cooccurring(text: Column, required: Column, any_of: Column) -> Column:
    """Whether a token begins with each of the required prefixes, and one with any of the others."""
    words = F.array_distinct(tokens(text, 1))
    has = lambda p: F.exists(words, lambda w: F.startswith(w, p))
    return F.forall(required, has) & F.exists(any_of, has)


def first_nonempty(channels: DataFrame, by: str = "query_id", priority: str = "priority") -> DataFrame:
    """The rows of each query's most urgent channel that has any: exact lookups, then bounded ones, then full text."""
    w = Window.partitionBy(by)
    return channels.withColumn("_least", F.min(priority).over(w)).filter(F.col(priority) == F.col("_least")).drop("_least")
