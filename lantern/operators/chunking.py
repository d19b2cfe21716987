"""Paragraph chunking with overlap, and the tables derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.text import SPACE, chunk_id, citation_slug, citations

TARGET, OVERLAP = 1400, 220


def chunk_texts(text: Column, target: int = TARGET, overlap: int = OVERLAP, separator: str = "\n{2,}") -> Column:
    """Paragraphs joined up to the target length.

    A text within the target, or without paragraphs, is one chunk as it is. A paragraph is never cut. After a chunk
    the next one begins with the tail of the last, if that was longer than the overlap.
    """
    strip = lambda c: F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")
    paragraphs = F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, p: Column) -> Column:
        full = (s["now"] != "") & (F.length(s["now"]) + 2 + F.length(p) > target)
        tail = F.when(F.length(s["now"]) > overlap, strip(F.right(s["now"], F.lit(overlap)))).otherwise("") if overlap > 0 else F.lit("")
        lead = F.when(full, tail).otherwise(s["now"])
        now = F.when(lead == "", p).otherwise(F.concat(lead, F.lit("\n\n"), p))
        return F.struct(F.when(full, F.array_append(s["done"], s["now"])).otherwise(s["done"]).alias("done"), now.alias("now"))

    made = F.aggregate(paragraphs, start, step, lambda s: F.array_append(s["done"], s["now"]))
    return F.when((F.length(text) <= target) | (F.size(paragraphs) == 0), F.array(text)).otherwise(made)


def chunks(documents: DataFrame, key: str = "doc_id", column: str = "text", target: int = TARGET, overlap: int = OVERLAP, separator: str = "\n{2,}") -> DataFrame:
    """(key, chunk_index, chunk_text, chunk_id) of every document; a narrow pass."""
    made = documents.select(F.col(key), F.posexplode(chunk_texts(F.col(column), target, overlap, separator)).alias("chunk_index", "chunk_text"))
    return made.withColumn("chunk_id", chunk_id(F.col(key), F.col("chunk_index"), F.col("chunk_text")))


def without_boilerplate(pieces: DataFrame, pattern: str, key: str = "doc_id", column: str = "chunk_text") -> DataFrame:
    """The chunks that don't match, or all chunks of a document of which none would be left."""
    keep = ~F.rlike(F.col(column), F.lit(pattern))
    return pieces.withColumn("_keep", keep).withColumn("_any", F.max("_keep").over(Window.partitionBy(key))).filter("_keep or not _any").drop("_keep", "_any")


def chunk_citations(pieces: DataFrame, pattern: str, declared: Column | None = None) -> DataFrame:
    """(chunk_id, citation) bridge: references in a chunk and those declared for its document."""
    found = citations(F.col("chunk_text"), pattern)
    every = F.array_union(found, declared) if declared is not None else found
    return pieces.select("chunk_id", F.explode(every).alias("citation")).distinct()


def unit_chunks(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks of (key, citation, text, ancestors) units: one per citation and text, under its ancestors' headings."""
    first = Window.partitionBy(key, "citation", F.sha2(F.col("text").cast("binary"), 256)).orderBy("start")
    rows = units.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    order = Window.partitionBy(key).orderBy("start", "citation")
    rows = rows.withColumn("chunk_index", F.row_number().over(order) - 1).withColumn("chunk_text", F.concat_ws("\n", "ancestors", "citation", "text"))
    return rows.select(key, "chunk_index", "citation", "chunk_text", citation_slug(F.col(key), F.col("citation")).alias("provision_id"), chunk_id(F.col(key), F.col("chunk_index"), F.col("chunk_text")).alias("chunk_id"))


def merge_texts(texts: Column, least: int = 41, most: int = 500) -> Column:
    """One text from an ordered array of overlapping chunks.

    The longest end of the text so far, of ``least`` to ``most`` characters, that begins the next chunk is written
    once; without one a blank line stands between. Blank chunks are left out.
    """
    strip = lambda c: F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")
    parts = F.filter(F.transform(texts, lambda t: strip(F.coalesce(t, F.lit("")))), lambda t: t != "")

    def step(so_far: Column, chunk: Column) -> Column:
        top = F.least(F.lit(most), F.length(so_far), F.length(chunk))
        sizes = F.when(top >= least, F.sequence(top, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        fits = F.filter(sizes, lambda n: F.right(so_far, n) == F.left(chunk, n))
        joined = F.when(F.size(fits) > 0, F.concat(so_far, F.substring(chunk, F.element_at(F.when(F.size(fits) > 0, fits), 1) + 1, F.length(chunk)))).otherwise(F.concat(so_far, F.lit("\n\n"), chunk))
        return F.when(so_far == "", chunk).otherwise(joined)

    return F.aggregate(parts, F.lit(""), step)


def merged_documents(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): the chunks of each document put together again; only a document's own chunks meet."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda x: x["chunk_text"])
    return pieces.groupBy(key).agg(ordered.alias("_texts")).select(key, merge_texts(F.col("_texts")).alias("text"))
