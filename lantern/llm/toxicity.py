"""Toxicity by classifier chains.

Categories are predicted one after another by linear models; each later model also sees the earlier categories'
probabilities. In training these are out-of-fold, so that a later model learns from probabilities as they will be.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm import _words as W

#: Labelled documents that the chain is fitted on, at most: those with the smallest hash of their id.
TRAIN_ROWS = 20_000
FEATURE_BITS = 20
FOLDS = 3
#: Documents whose entries are expanded at once while fitting.
BLOCK_ROWS = 1_000
#: Words enter if their share differs between the classes by so many standard errors and so many documents have them.
LEAST_Z, LEAST_DOCS = 4.5, 4
#: The classes weigh the same in training, so a few rare words can carry a clean text a little over one half.
THRESHOLD = 0.6
#: Letters and digits of ASCII, and all bytes of other characters.
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def feature_chunks(texts: list[bytes]) -> Iterator[tuple[W.Chunk, np.ndarray]]:
    """Chunks of lower-cased words (punctuation parts words) with the feature number of each word."""
    for docs in W.chunked(texts):
        raw, base = W.layout(texts, docs)
        data = W.LOWER[raw]
        start, end = W.edges(_INSIDE[data])
        c = W.assemble(docs, raw, data, base, start, end)
        yield c, (c.hash >> W.U(64 - FEATURE_BITS)).astype(np.int64)


def _distinct(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique((doc.astype(np.int64) << FEATURE_BITS) | feature)
    return pairs >> FEATURE_BITS, pairs & ((1 << FEATURE_BITS) - 1)


@dataclass
class Link:
    """One model of the chain: a bias, weights of its features, and weights of the earlier probabilities."""

    category: str
    bias: float
    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray

    def score(self, sums: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        z = self.bias + sums
        for w, p in zip(self.earlier, before):
            z = z + w * p
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Rows:
    """Sparse presence features of some documents, numbered densely: ``values`` are the features that occur."""

    def __init__(self, lists: Sequence[Sequence[int]]):
        self.n = len(lists)
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
        occurs = np.zeros(1 << FEATURE_BITS, bool)
        for x in lists:
            occurs[x] = True
        self.values = np.flatnonzero(occurs)
        number = np.cumsum(occurs, dtype=np.int32) - 1
        self.feature = np.empty(self.first[-1], np.int32)
        for x, lo in zip(lists, self.first):
            self.feature[lo : lo + len(x)] = number[x]

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Documents and features of all entries, BLOCK_ROWS documents at a time."""
        for lo in range(0, self.n, BLOCK_ROWS):
            own = self.first[lo : lo + BLOCK_ROWS + 1]
            yield np.repeat(np.arange(lo, lo + len(own) - 1), np.diff(own)), self.feature[own[0] : own[-1]]

    def sums(self, features: np.ndarray, weights: np.ndarray) -> np.ndarray:
        table = np.zeros(len(self.values))
        table[np.searchsorted(self.values, features)] = weights
        out = np.zeros(self.n)
        for doc, feature in self.blocks():
            out += np.bincount(doc, table[feature], self.n)
        return out


def _fit(category: str, rows: Rows, keep: np.ndarray, y: np.ndarray, before: list[np.ndarray]) -> Link:
    """Logistic regression with an L2 penalty on the rows in ``keep``; both classes weigh the same."""
    size = len(rows.values)
    of_class = [keep & (y == 0), keep & (y > 0)]
    n0, n1 = (max(1, int(x.sum())) for x in of_class)
    c0, c1 = np.zeros((2, size), np.int64)
    for doc, feature in rows.blocks():
        for c, own in zip((c0, c1), of_class):
            c += np.bincount(feature[own[doc]], minlength=size)
    share = (c1 + c0) / (n1 + n0)
    z = (c1 / n1 - c0 / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    chosen = np.flatnonzero((np.abs(z) >= LEAST_Z) & (c1 + c0 >= LEAST_DOCS))
    number = np.full(size, -1)
    number[chosen] = np.arange(len(chosen))
    entries = []
    for doc, feature in rows.blocks():
        mine = keep[doc] & (number[feature] >= 0)
        entries.append((doc[mine].astype(np.int32), number[feature[mine]].astype(np.int32)))
    doc, column = (np.concatenate(x) for x in zip(*entries))
    extra = np.stack([np.ones(rows.n), *before])  # bias and earlier probabilities
    w, e = np.zeros(len(chosen)), np.zeros(len(extra))
    moments = [np.zeros(len(chosen) + len(e)) for _ in range(2)]
    weight = keep * np.where(y > 0, 0.5 / n1, 0.5 / n0)
    for step in range(1, 301):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[column], rows.n) + e @ extra, -40, 40)))
        error = (p - y) * weight
        g = np.concatenate([np.bincount(column, error[doc], len(chosen)) + 1e-5 * w, extra @ error])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, e = w - move[: len(w)], e - move[len(w) :]
    return Link(category, float(e[0]), rows.values[chosen], w, e[1:])


def fit_chain(lists: Sequence[Sequence[int]], ids: Sequence[int], labels: dict[str, np.ndarray]) -> list[Link]:
    """The chain over the categories in the order of ``labels``; none if there are no rows."""
    if not len(lists):
        return []
    rows, everyone = Rows(lists), np.ones(len(lists), bool)
    fold = W.mix(np.asarray(ids, np.int64).astype(W.U)) % W.U(FOLDS)
    chain, before = [], []
    for category, y in labels.items():
        y = np.asarray(y, float)
        held_out = np.zeros(rows.n)
        for k in range(FOLDS):
            own = fold == k
            if own.any() and (~own).any():
                link = _fit(category, rows, ~own, y, before)
                held_out[own] = link.score(rows.sums(link.features, link.weights), before)[own]
        chain.append(_fit(category, rows, everyone, y, before))
        before.append(held_out)
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], rows: int = TRAIN_ROWS, key: str = "doc_id", column: str = "text") -> list[Link]:
    """Fit the chain on at most ``rows`` labelled documents.

    ``categories`` maps each category, in chain order, to an SQL expression over ``labels`` that is 0 or 1. Labels
    with a null among them or a null key are left out; of several labels of a key the largest counts, and a key that
    stands on several documents is trained on each of the first ``rows`` of them. Null and empty texts have no words.

    The bounded sample is fitted in one task of an executor; only the chosen weights reach the driver.
    """
    y = {c: F.expr(e).cast("int") for c, e in categories.items()}
    known = labels.select(labels[key].cast("long").alias("id"), *[v.alias(f"y_{i}") for i, v in enumerate(y.values())]).dropna()
    known = known.groupBy("id").agg(*[F.max(f"y_{i}").alias(f"y_{i}") for i in range(len(y))])
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(docs[key].cast("long").alias("id"), docs[column].cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, 1):
            lists = [None] * batch.num_rows
            for c, feature in feature_chunks(W.as_bytes(batch.column(1))):
                d, f = _distinct(c.doc, feature)
                for i, own in zip(c.docs, np.split(f, np.searchsorted(d, np.arange(1, len(c.docs))))):
                    lists[i] = own.astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(lists, pa.list_(pa.int32()))], names=names)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = pa.Table.from_batches(batches, sample_schema).sort_by("id")
        lists = [x.values.to_numpy() for x in sample["features"]]
        chain = fit_chain(lists, sample["id"].to_numpy(), {c: sample[f"y_{i}"].to_numpy() for i, c in enumerate(order)})
        rows = [(i, x.category, x.bias, x.features.tolist(), x.weights.tolist(), x.earlier.tolist()) for i, x in enumerate(chain)]
        columns = zip(*rows) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["link", "category", "bias", "features", "weights", "earlier"])

    order = list(categories)
    names = ["id", *[f"y_{i}" for i in range(len(y))], "features"]
    sample_schema = pa.schema([("id", pa.int64()), *[(f"y_{i}", pa.int32()) for i in range(len(y))], ("features", pa.list_(pa.int32()))])
    kinds = [pa.int32(), pa.string(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
    features = texts.mapInArrow(W.tidy(run), "id long, " + ", ".join(f"y_{i} int" for i in range(len(y))) + ", features array<int>")
    # The limit brings the bounded sample to one task.
    fitted = features.limit(rows).mapInArrow(W.tidy(fit), "link int, category string, bias double, features array<int>, weights array<double>, earlier array<double>").toArrow().sort_by("link")
    return [Link(x["category"], x["bias"], np.array(x["features"], np.int32), np.array(x["weights"], float), np.array(x["earlier"], float)) for x in fitted.to_pylist()]


def probabilities(chain: list[Link], texts: list[bytes]) -> np.ndarray:
    """The probability of each category in order, for each text."""
    tables = np.zeros((len(chain), 1 << FEATURE_BITS))
    for table, link in zip(tables, chain):
        table[link.features] = link.weights
    used = (tables != 0).any(axis=0)
    sums = np.zeros((len(chain), len(texts)))
    for c, feature in feature_chunks(texts):
        hit = used[feature]
        d, f = _distinct(c.doc[hit], feature[hit])
        for s, table in zip(sums, tables):
            s[c.docs] = np.bincount(d, table[f], len(c.docs))
    p = np.zeros_like(sums)
    for i, link in enumerate(chain):
        p[i] = link.score(sums[i], list(p[:i]))
    return p


def score(docs: DataFrame, chain: list[Link], categories: Sequence[str], threshold: float = THRESHOLD, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, p_<category> ..., is_<last category>) of every row; extra columns are not read.

    A null or empty text has the features of no words. Without a fitted chain all probabilities are 0. Repeated rows
    give repeated rows. One pass without a shuffle; what is broadcast has 2**FEATURE_BITS entries a category at most.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, 1):
            p = probabilities(shared.value, W.as_bytes(batch.column(1))) if shared.value else np.zeros((n, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p), pa.array(p[-1] >= threshold)], names=names)

    n = len(categories)
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", *[f"p_{c}" for c in categories], f"is_{categories[-1]}"]
    schema = f"key {kind}, " + ", ".join(f"p_{c} double" for c in categories) + f", is_{categories[-1]} boolean"
    return docs.select(docs[key].alias("key"), docs[column].cast("string").alias("text")).mapInArrow(W.tidy(run), schema).withColumnRenamed("key", key)


def keep(docs: DataFrame, chain: list[Link], threshold: float = THRESHOLD, column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose last category is below the threshold.

    A null or empty text has the features of no words and stays unless the chain calls those toxic; without a fitted
    chain every row stays. Repeated rows share a fate. A narrow pass, no shuffle.
    """
    if not chain:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def verdict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            yield pa.array(probabilities(shared.value, W.as_bytes(text))[-1] >= threshold)
        W.release_memory()

    toxic = F.arrow_udf(verdict, "boolean")
    return docs.filter(~toxic(docs[column].cast("string")))
