"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import bpe, chat, decontaminate, html, jaccard, lengths, lexical, repair, sharding, substring, token_files, topk, toxicity
from lantern.llm._storage import materialise, small_batches

#: Categories of the chain in order, as 0 or 1 over ``labels``.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
#: Id that ends each document in the token files.
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(chat.text_parts(rows.unionByName(more))))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lengths.limits(lengths.length_histogram(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 16)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(topk.scaled(table(spark, sf_dir, "embeddings")), "scaled")
    return topk.top_k(rows.filter(F.pmod("vec_id", F.lit(50)) == 0), rows, 5)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return substring.kept_words(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.score(docs, chain, list(CATEGORIES))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    segments = token_files.write_ids(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), END_ID)
    return token_files.read_spans(segments)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    report, _ = repair.repair(repair.damaged(rows))
    return repair.with_every(report, rows)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_html_extraction": op4_html_extraction,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_sharding": op6_sharding,
    "op7_bpe": op7_bpe,
    "op8_exact_topk": op8_exact_topk,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_token_files": op11_token_files,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": r"""
        with t as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e as (
            select *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') as body,
                replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&NewLine;') as head
            from t)
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
            coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
            sum(8 + length(head) + 1 + length(body) + 8)::bigint as formatted_chars,
            sum(len(list_filter(regexp_split_to_array(text, '[\s\x0B]+'), lambda x: x <> '')))::bigint as n_tokens
        from e group by conv_id""",
    "op5_ngram_jaccard": r"""
        with recursive w as materialized (
            select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
        s as materialized (
            select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)),
        n as materialized (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
        l as materialized (
            select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 75 * (a.n + b.n - k)),
        e as materialized (select x, y from l union all select y, x from l),
        r as (select doc_id as x, doc_id as y from documents union select r.x, e.y from r join e on e.x = r.y)
        select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.y) as component_id
        from documents d left join n using (doc_id) join r on r.x = d.doc_id group by d.doc_id""",
    "op8_exact_topk": r"""
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
            from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5""",
    "op9_substring_dedup": r"""
        with w as materialized (
            select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
        s as materialized (
            select doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) as h
            from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50)),
        m as (select h, min(doc_id) as source from s group by h),
        c as (
            select doc_id, list_distinct(flatten(list(range(i, i + 50)))) as gone
            from s join m using (h) where source < doc_id group by doc_id),
        k as (
            select doc_id, len(ws) as n_words, coalesce(len(gone), 0) as n_removed,
                case when gone is null then ws else list_filter(ws, lambda x, j: not list_contains(gone, j)) end as kept
            from w left join c using (doc_id))
        select doc_id, n_words::bigint as n_words, n_removed::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k""",
    "op13_lexical_search": r"""
        with d as materialized (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
        b as (
            select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
        q as (select item_id, t, count(*) as k from b group by all),
        e as (select count(*) as docs, sum(len(ts))::bigint as terms from d where len(ts) > 0),
        p as materialized (select doc_id, n, t, count(*) as tf from (select doc_id, len(ts) as n, unnest(ts) as t from d) where t in (select t from q) group by all),
        w as (select t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::double))::bigint as w from p, e group by t, docs),
        s as (
            select item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::bigint as score
            from q join p using (t) join w using (t), e group by all),
        r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0)
        select item_id, rank, doc_id, score from r where rank <= 10""",
}
