"""N-gram Jaccard join by rare-first prefix filtering.

A document's set is its distinct word n-grams. All sets are ordered alike, rarest n-gram first. Two sets that reach the
threshold share an n-gram of their prefixes, so documents meet only there, under a length, a positional and a suffix
filter, and each pair is verified once.

Counting how many documents hold an n-gram needs every n-gram of the corpus once. These travel packed: a task hashes
whole texts and sends, for each range of hashes (a bucket), one array of 8-byte entries, the last bits of a hash beside the
document's number in its batch. Counts end at 65535, where an n-gram is as common as any. A bucket answers each batch with the n-grams that occur elsewhere too; all others are
the rarest. Most documents have more n-grams of their own than the prefix is long and are done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm import _words as W
from lantern.llm._storage import materialise
from lantern.llm.components import components

#: Text that fills one bucket at most on average, up to 32 TB; at 100 TB with this most of bits it is 24 MB.
BUCKET_BYTES, MOST_BUCKET_BITS = 8 << 20, 22
#: Rows and bytes of a batch of Arrow rows.
SEND_ROWS, SEND_BYTES = 1_000, 1 << 20
#: Documents and n-grams of a batch: entries number documents in 16 bits.
BATCH_DOCS, BATCH_GRAMS = 20_000, 500_000
#: An n-gram in so many documents of one batch is sent once with its count.
COMMON = 256
ALL = 0xFFFF
#: Bits of a hash that travel beside its bucket: with the bucket's they make 52 to 64.
LOW_BITS = 48
BINS = 16

_PACKED = "bucket int, batch long, kind int, a binary, b binary, c binary"
_ANSWER = "batch long, kind int, a binary, b binary, c binary"


def packed(low: np.ndarray, number: np.ndarray) -> bytes:
    """Ascending values of LOW_BITS as differences, high bytes and the rest apart, and 16-bit numbers.

    8 bytes an entry; the high bytes are nearly all 0 and compress away.
    """
    step = np.diff(low, prepend=W.U(0))
    return (step >> W.U(32)).astype(np.uint16).tobytes() + (step & W.U(0xFFFFFFFF)).astype(np.uint32).tobytes() + number.astype(np.uint16).tobytes()


def unpacked(value: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(value) // 8
    high, low, number = np.frombuffer(value, np.uint16, n), np.frombuffer(value, np.uint32, n, 2 * n), np.frombuffer(value, np.uint16, n, 6 * n)
    return np.cumsum((high.astype(W.U) << W.U(32)) | low, dtype=W.U), number


def token_bits(bits: int) -> tuple[int, int]:
    """Bits of a hash that are left out, and bits of a token beside its bucket, with ``bits`` bits of bucket."""
    low = min(LOW_BITS, 64 - bits)
    return 64 - bits - low, low


def gram_sets(texts: list[bytes], words: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(documents, document of each member counted from 0, member) for chunks; members are distinct in a document."""
    for c in W.word_chunks(texts, lower=True):
        at, h = c.grams(words)
        doc = c.doc[at]
        counts = c.counts()
        short = np.flatnonzero((counts > 0) & (counts < words))
        if len(short):
            whole = W.span_hash(W.prefix_sums(c.hash), c.first[short], c.first[short + 1])
            doc, h = np.concatenate([doc, short]), np.concatenate([h, whole])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        yield c.docs, doc[new], h[new]


class _Batch:
    """Sets of a run of documents, packed by bucket."""

    def __init__(self):
        self.ids, self.valid, self.doc, self.gram, self.n_docs, self.n_grams = [], [], [], [], 0, 0

    def add(self, ids: np.ndarray, valid: np.ndarray, doc: np.ndarray, gram: np.ndarray) -> None:
        self.ids.append(ids)
        self.valid.append(valid)
        self.doc.append(doc + self.n_docs)
        self.gram.append(gram)
        self.n_docs += len(ids)
        self.n_grams += len(gram)

    def rows(self, batch: int, bits: int) -> Iterator[tuple]:
        ids, valid, doc, gram = (np.concatenate(x) for x in (self.ids, self.valid, self.doc, self.gram))
        n = np.bincount(doc, minlength=self.n_docs)
        first = np.concatenate([[0], np.cumsum(n)])
        sums = [np.concatenate([np.zeros(1, W.U), np.cumsum(x, dtype=W.U)]) for x in (W.mix(gram), W.mix(gram ^ W.U(0x5851F42D4C957F2D)))]
        one, two = (s[first[1:]] - s[first[:-1]] for s in sums)
        # Documents without a set or an id are classes of their own.
        alone = (n == 0) | ~valid
        one[alone] = W.mix(np.arange(self.n_docs, dtype=W.U)[alone] + W.U(batch) * W.U(1 << 16))
        two[alone] = W.U(1)
        # Of equal sets in the batch only the first sends its n-grams.
        order = np.lexsort((two, one))
        leads = np.ones(self.n_docs, bool)
        leads[order[1:]] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]]) | (n[order[1:]] != n[order[:-1]])
        sent = (leads & valid)[doc]
        doc, gram = doc[sent], gram[sent]
        # From here on an n-gram is its token: the bucket's bits and those below them.
        buckets = 1 << bits
        left_out, low_bits = token_bits(bits)
        gram = gram >> W.U(left_out)
        order = np.lexsort((doc, gram))
        doc, gram = doc[order].astype(W.U), gram[order]
        start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(gram)))
        token, low = gram >> W.U(low_bits), gram & W.U((1 << low_bits) - 1)
        common = count >= COMMON
        c_at = start[common]
        c_token = gram[c_at]
        spread = np.repeat(common, count)
        info = np.stack([ids, valid.astype(np.int64), n, one.view(np.int64), two.view(np.int64)])
        members = np.concatenate([np.array([len(c_at)]), c_token.view(np.int64), count[common], doc[spread].astype(np.int64)])
        yield int(batch % buckets), batch, 1, info.astype(np.int64).tobytes(), members.astype(np.int64).tobytes(), b""
        entry, number, where = low[~spread], doc[~spread], token[~spread]
        filled = np.union1d(where, token[c_at])
        edges = [np.searchsorted(x, filled, side) for x in (where, token[c_at]) for side in ("left", "right")]
        for k, lo, hi, c_lo, c_hi in zip(filled, *edges):
            own, mine = slice(lo, hi), slice(c_lo, c_hi)
            yield int(k), batch, 0, packed(entry[own], number[own]), low[c_at[mine]].tobytes(), count[common][mine].astype(np.int64).tobytes()


def _pack(words: int, bits: int):
    names = ["bucket", "batch", "kind", "a", "b", "c"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, own = TaskContext.get().partitionId(), 0, _Batch()

        def flush() -> Iterator[pa.RecordBatch]:
            W.release_memory()
            rows, size = [], 0
            for row in own.rows((part << 24) | serial, bits):
                rows.append(row)
                size += sum(map(len, row[3:]))
                if len(rows) == SEND_ROWS or size > SEND_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

        for batch in W.pieces(batches, 1):
            keys = batch.column(0)
            valid = ~np.asarray(keys.is_null())
            ids = np.asarray(keys.fill_null(0), np.int64)
            for docs, doc, gram in gram_sets(W.as_bytes(batch.column(1)), words):
                if own.n_docs and (own.n_docs + len(docs) > BATCH_DOCS or own.n_grams + len(gram) > BATCH_GRAMS):
                    yield from flush()
                    serial, own = serial + 1, _Batch()
                for lo in range(0, len(docs), BATCH_DOCS):  # a chunk of very many empty texts
                    hi = min(lo + BATCH_DOCS, len(docs))
                    if own.n_docs + hi - lo > BATCH_DOCS:
                        yield from flush()
                        serial, own = serial + 1, _Batch()
                    a, b = np.searchsorted(doc, [lo, hi])
                    own.add(ids[docs[lo:hi]], valid[docs[lo:hi]], doc[a:b] - lo, gram[a:b])
        if own.n_docs:
            yield from flush()

    return run


def _u64(value: bytes) -> np.ndarray:
    return np.frombuffer(value, W.U)


def _i64(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.int64)


def _count(table: pa.Table) -> pa.Table:
    """A bucket's answer to each batch: n-grams of two documents and more, the document's number, and the count."""
    W.release_memory()
    rows = table.to_pylist()
    out = [(r["batch"], 1, r["a"], r["b"], b"") for r in rows if r["kind"]]
    rows = [r for r in rows if not r["kind"]]
    if rows:
        low, number, count, source = [], [], [], []
        for i, r in enumerate(rows):
            (entry, own), common = unpacked(r["a"]), _u64(r["b"])
            low += [entry, common]
            number += [own, np.full(len(common), ALL, np.uint16)]
            count += [np.ones(len(entry), np.int32), _i64(r["c"]).astype(np.int32)]
            source.append(np.full(len(entry) + len(common), i, np.int32))
        low, number, count, source = (np.concatenate(x) for x in (low, number, count, source))
        order = np.argsort(low, kind="stable")
        low = low[order]
        start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        each = np.diff(np.append(start, len(low)))
        total = np.repeat(np.add.reduceat(count[order], start), each)
        kept = total >= 2
        low, total, order = low[kept], total[kept], order[kept]
        number, source = number[order], source[order]
        order = np.argsort(source, kind="stable")
        low, total, number = low[order], np.minimum(total[order], 0xFFFF).astype(np.uint16), number[order]
        bucket = np.array([rows[0]["bucket"]], np.int64).tobytes()
        edge = np.searchsorted(source[order], np.arange(len(rows) + 1))
        for i, r in enumerate(rows):
            mine = slice(edge[i], edge[i + 1])
            if edge[i] < edge[i + 1]:
                out.append((r["batch"], 0, packed(low[mine], number[mine]), total[mine].tobytes(), bucket))
    columns = zip(*out) if out else [[]] * 5
    return pa.table([pa.array(x, t) for x, t in zip(columns, [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])], names=["batch", "kind", "a", "b", "c"])


_SETS = "doc_id long, n long, one long, two long, own long, prefix long, shared array<long>, bins array<int>"


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return (percent * n + 99) // 100


def _order(percent: int, bits: int):
    low_bits = token_bits(bits)[1]

    def run(table: pa.Table) -> pa.Table:
        """Sets of a batch; those whose prefix reaches beyond their own n-grams have the shared ones, rarest first."""
        W.release_memory()
        rows = table.to_pylist()
        info = next(r for r in rows if r["kind"])
        ids, valid, n, one, two = _i64(info["a"]).reshape(5, -1)
        members = _i64(info["b"])
        m = int(members[0])
        c_token, c_count, c_docs = members[1 : 1 + m], members[1 + m : 1 + 2 * m], members[1 + 2 * m :]
        c_first = np.concatenate([[0], np.cumsum(c_count)])
        rows = [r for r in rows if not r["kind"]]
        parts = [(*unpacked(r["a"]), np.frombuffer(r["b"], np.uint16), _u64(r["c"])[0]) for r in rows] or [(np.zeros(0, W.U), np.zeros(0, np.uint16), np.zeros(0, np.uint16), W.U(0))]
        token = np.concatenate([(bucket << W.U(low_bits)) | low for low, _, _, bucket in parts]).view(np.int64)
        number = np.concatenate([x[1] for x in parts]).astype(np.int64)
        total = np.concatenate([x[2] for x in parts])
        every = number == ALL
        if every.any():
            by = np.argsort(c_token)
            which = by[np.searchsorted(c_token[by], token[every])]
            docs = [c_docs[c_first[w] : c_first[w + 1]] for w in which]
            sizes = [len(x) for x in docs]
            token = np.concatenate([token[~every], np.repeat(token[every], sizes)])
            total = np.concatenate([total[~every], np.repeat(total[every], sizes)])
            number = np.concatenate([number[~every], *docs])
        shared = np.bincount(number, minlength=len(ids))
        own = n - shared
        length = n - least_overlap(n, percent) + 1
        alive = (shared > 0) & (own < length)
        kept = alive[number]
        token, number, total = token[kept], number[kept], total[kept]
        order = np.lexsort((token, total, number))
        token, number = token[order], number[order]
        offsets = np.concatenate([[0], np.cumsum(np.where(alive, shared, 0))])
        bins = np.bincount(number * BINS + (token & (BINS - 1)), minlength=len(ids) * BINS)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(token, pa.int64()), mask=pa.array(~alive))
        bin_lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * BINS, pa.int32()), pa.array(bins, pa.int32()), mask=pa.array(~alive))
        key = pa.array(ids, pa.int64(), mask=valid == 0)
        return pa.table([key, pa.array(n), pa.array(one), pa.array(two), pa.array(own), pa.array(np.where(alive, length - own, 0)), lists, bin_lists], names=["doc_id", "n", "one", "two", "own", "prefix", "shared", "bins"])

    return run


def _least(n1: Column, n2: Column, percent: int) -> Column:
    """Members that two sets of these sizes must share."""
    return F.ceil(percent * (n1 + n2) / F.lit(100 + percent))


def _may_link(x: str, y: str, percent: int) -> Column:
    """Length and positional filter for two sets that meet in a prefix n-gram."""
    n1, n2, p1, p2 = (F.col(f"{t}.{c}") for c in ("n", "pos") for t in (x, y))
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (1 + F.least(n1 - p1, n2 - p2) - 1 >= _least(n1, n2, percent))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold. The suffix filter bounds the overlap by bins of the members."""
    side = lambda t: sets.select(F.col("node").alias(t), *[F.col(c).alias(f"{t}_{c}") for c in ("n", "bins", "shared")])
    need = _least(F.col("a_n"), F.col("b_n"), percent)
    at_most = F.aggregate(F.zip_with("a_bins", "b_bins", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(at_most >= need)
    return both.filter(F.size(F.array_intersect("a_shared", "b_shared")) >= need).select("a", "b")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(F.col(f"{x}.node"), F.col(f"{y}.node")).alias("a"), F.greatest(F.col(f"{x}.node"), F.col(f"{y}.node")).alias("b")]


def similar_documents(docs: DataFrame, words: int = 5, percent: int = 75, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row.

    Words are lower-cased in A-Z. A text with fewer than ``words`` words is one shingle; one without words, or null,
    has the empty set and is linked with nothing. Documents link when 100 * intersection >= percent * union;
    ``component_id`` is the smallest id that links reach. Equal sets are one node, so copies make no pairs. Rows with
    a null key are linked with nothing and have a null component; repeated rows and keys each give a row.

    Within the documents that share a prefix n-gram, all are first held against two of them; documents that these
    links join need not meet again. What remains is pairs across components, with one side outside the n-gram's
    largest component. So a group of near copies costs its size, not its square, and no link between components is
    missed. ``docs`` must be a deterministic scan, as a written table is: batches are numbered by their partition.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[key].cast("long").alias("doc_id"), docs[column].cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES, 16)
    bits = min(MOST_BUCKET_BITS, (buckets - 1).bit_length())
    answers = texts.mapInArrow(W.tidy(_pack(words, bits)), _PACKED).groupBy("bucket").applyInArrow(_count, _ANSWER)
    made = answers.groupBy("batch").applyInArrow(_order(percent, bits), _SETS)
    every = materialise(made.withColumn("node", F.xxhash64("one", "two", "n")).drop("one", "two"), "sets")

    sets = materialise(every.filter("shared is not null").select("node", "n", "own", "prefix", "shared", "bins").dropDuplicates(["node"]), "nodes")
    index = sets.select("node", "n", "own", F.posexplode(F.slice("shared", F.lit(1), F.col("prefix").cast("int"))).alias("i", "gram")).select("gram", "node", "n", (F.col("own") + F.col("i")).alias("pos"))

    # Prefix n-grams in which documents meet, and how much of a set is met nowhere.
    met = materialise(index.groupBy("gram").agg(F.count("*").alias("docs")).filter("docs > 1").select("gram"), "grams")
    index = materialise(index.join(met, "gram"), "met")
    alone = index.groupBy("node").agg(F.count("*").alias("met")).join(sets.select("node", "own", "prefix", "n"), "node")
    alone = materialise(alone.select("node", ((F.col("own") + F.col("prefix") - F.col("met")) / F.col("n")).alias("alone")), "alone")
    # Every document of an n-gram against two of them: the one with the least of its own, which stands in the middle
    # of near copies, and one chosen by hash.
    draw = F.xxhash64("node").alias("draw")
    stars = index.join(alone, "node").groupBy("gram").agg(F.min(F.struct("alone", draw, "node", "n", "pos")).alias("lo"), F.min(F.struct(draw, "node", "n", "pos")).alias("hi"))
    both = F.array(*[F.struct(f"{c}.node", f"{c}.n", f"{c}.pos") for c in ("lo", "hi")])
    stars = materialise(stars.select("gram", F.explode(both).alias("y")).select("gram", "y.node", "y.n", "y.pos"), "stars")
    pairs = index.alias("x").join(stars.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.node") != F.col("y.node")) & _may_link("x", "y", percent))
    tried = materialise(pairs.select(*_pair("x", "y")).distinct(), "pairs")
    links = materialise(_verified(tried, sets, percent), "links")
    labels = components(links)

    # What is left: pairs across components, one of them outside the n-gram's largest component.
    labelled = index.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = materialise(labelled, "index")
    counts = labelled.groupBy("gram", "label").count().groupBy("gram").agg(F.max_by("label", F.struct("count", "label")).alias("largest"), F.count("*").alias("labels"))
    open_grams = materialise(counts.filter("labels > 1").drop("labels"), "open")
    # Sizes of a link differ by a factor 100 / percent at most: they fall in the same or the next class.
    scale = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) * (1 + 1e-9)))
    rest = materialise(labelled.join(open_grams, "gram").withColumn("size_class", scale), "rest")
    probe = rest.filter("label <> largest").withColumn("size_class", F.explode(F.array(*[F.col("size_class") + i for i in (-1, 0, 1)])))
    same = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.size_class") == F.col("y.size_class")) & (F.col("x.label") != F.col("y.label"))
    cross = probe.alias("x").join(rest.alias("y"), same & _may_link("x", "y", percent)).select(*_pair("x", "y")).distinct()
    cross = materialise(cross.join(tried, ["a", "b"], "left_anti"), "cross")
    labels = components(links.union(_verified(cross, sets, percent)))

    nodes = every.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    nodes = nodes.join(labels, "node", "left").filter("label is not null or rows > 1")
    nodes = materialise(nodes.select("node", "least", F.coalesce("label", "node").alias("label")), "classes")
    classes = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = materialise(nodes.join(classes, "label").select("node", "component_id"), "named")
    found = every.select("doc_id", "n", "node").join(named, "node", "left")
    return found.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
