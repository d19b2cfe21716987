"""Queries of the text and document operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lantern.functions import text as X
from lantern.operators import chunking, evaluation, inventory, provisions, selection
from lantern.plans.registry import query, table

#: Markers that stand for domains over the driver's texts, in order of priority.
DOMAINS = {"fr": ["la ", " les "], "de": [" der ", "keit"], "es": [" los ", "ción"], "en": [" the ", " of "]}
#: Reference pattern that the driver's texts contain: a word before a number.
NUMBERED = r"[a-z]+ [0-9]{2,}"
PHONE = r"\\+[0-9]{1,3}[ -]?[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{3,4}\\b"


@query(r"select doc_id, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')) as clean_text from documents")
def whitespace_normalized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_whitespace(F.col("text")).alias("clean_text"))


@query(
    r"""
    with p as (
        select doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: regexp_replace(x, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')), lambda x: x <> '') as ps
        from documents),
    recursive_start as (select 1),
    r as (
        with recursive f as (
            select doc_id, ps, 0 as i, '' as now, null::varchar as done, 0 as n from p where length(text) > 600 and len(ps) > 0
            union all
            select doc_id, ps, i + 1,
                case when now <> '' and length(now) + 2 + length(ps[i + 1]) > 600
                    then case when length(now) > 80 and regexp_replace(right(now, 80), '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g') <> '' then regexp_replace(right(now, 80), '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g') || chr(10) || chr(10) || ps[i + 1] else ps[i + 1] end
                    else case when now = '' then ps[i + 1] else now || chr(10) || chr(10) || ps[i + 1] end end,
                case when now <> '' and length(now) + 2 + length(ps[i + 1]) > 600 then now end,
                n + case when now <> '' and length(now) + 2 + length(ps[i + 1]) > 600 then 1 else 0 end
            from f where i < len(ps))
        select * from f),
    c as (
        select doc_id, n - 1 as chunk_index, done as chunk_text from r where done is not null
        union all select doc_id, n, now from r where i = len(ps)
        union all select doc_id, 0, text from p where length(text) <= 600 or len(ps) = 0)
    select doc_id, chunk_index::int as chunk_index, length(chunk_text)::int as n_chars, substr(sha256(doc_id || ':' || chunk_index || ':' || chunk_text), 1, 24) as chunk_id from c"""
)
def paragraph_chunks(spark, sf_dir):
    made = chunking.chunks(table(spark, sf_dir, "documents"), target=600, overlap=80, separator="\n+")
    return made.select("doc_id", "chunk_index", F.length("chunk_text").alias("n_chars"), "chunk_id")


@query(
    r"""
    with c as (select doc_id, i - 1 as chunk_index, x as chunk_text from (select doc_id, unnest(regexp_split_to_array(text, '\n')) as x, generate_subscripts(regexp_split_to_array(text, '\n'), 1) as i from documents)),
    k as (select *, not regexp_matches(chunk_text, '[0-9]') as keep from c)
    select doc_id, count(*) as n_kept from (select *, bool_or(keep) over (partition by doc_id) as any_kept from k) where keep or not any_kept group by doc_id"""
)
def boilerplate_chunks_filtered(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "chunk_text"))
    return chunking.without_boilerplate(lines, "[0-9]").groupBy("doc_id").agg(F.count("*").alias("n_kept"))


@query(
    r"""
    select doc_id, trim(case when regexp_matches(text, '\n(?i:license|copyright|the of)') then regexp_extract(text, '(?s)^(.*?)\n(?i:license|copyright|the of)', 1) else text end) as body from documents"""
)
def boilerplate_cut(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.cut_boilerplate(F.col("text"), ["license", "copyright", "the of"]).alias("body"))


@query(
    r"""
    with a as (select doc_id, text, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED_EMAIL]', 'g') as t1 from documents),
    b as (select *, regexp_replace(t1, '\b[0-9]{11}\b', '[REDACTED_NATIONAL_ID]', 'g') as t2 from a),
    c as (select *, regexp_replace(t2, '\b[0-9]{3}-[0-9]{3}-[0-9]{2}-[0-9]{2}\b', '[REDACTED_TAX_ID]', 'g') as t3 from b),
    d as (select *, regexp_replace(t3, '\+[0-9]{1,3}[ -]?[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{3,4}\b', '[REDACTED_PHONE]', 'g') as t4 from c)
    select doc_id, t4 as redacted, concat_ws(',', case when t1 <> text then 'email' end, case when t2 <> t1 then 'national_id' end, case when t3 <> t2 then 'tax_id' end, case when t4 <> t3 then 'phone' end) as applied
    from d"""
)
def personal_data_redacted(spark, sf_dir):
    redacted, labels = X.redact(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", redacted.alias("redacted"), F.array_join(labels, ",").alias("applied"))


@query(
    r"""
    with f as (select doc_id, list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z]+ [0-9]{2,}'), lambda x: trim(regexp_replace(x, ' +', ' ', 'g')))) as cs from documents)
    select citation, count(distinct doc_id) as n_docs from (select doc_id, unnest(cs) as citation from f) group by citation"""
)
def citation_bridge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("chunk_text", F.col("text")).withColumn("chunk_id", F.col("doc_id"))
    return chunking.chunk_citations(docs, NUMBERED).groupBy("citation").agg(F.count("*").alias("n_docs"))


@query(
    r"""
    with t as (select item_id as query_id, list_distinct(regexp_extract_all(lower(text), '[0-9A-Za-zÀ-ÖØ-öø-ÿĄĆĘŁŃŚŹŻąćęłńśźż]{3,}')) as x, regexp_extract_all(lower(text), '[0-9A-Za-zÀ-ÖØ-öø-ÿĄĆĘŁŃŚŹŻąćęłńśźż]{3,}') as ts from benchmark),
    u as (select query_id, t, min(i) as first from (select query_id, unnest(ts) as t, generate_subscripts(ts, 1) as i from t) group by all),
    o as (select *, row_number() over (partition by query_id order by first) as p from u)
    select query_id, (p - 1)::int as position, t as token from o where p <= 24"""
)
def query_terms(spark, sf_dir):
    from lantern.operators.fulltext import terms_of

    return terms_of(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"))


@query(
    r"""
    with t as (select distinct unnest(regexp_extract_all(lower(text), '[0-9A-Za-zÀ-ÖØ-öø-ÿĄĆĘŁŃŚŹŻąćęłńśźż]{3,}')) as token from benchmark)
    select token, case
        when token like '%ements' and length(token) >= 10 then left(token, length(token) - 6) when token like '%ement' and length(token) >= 9 then left(token, length(token) - 5)
        when token like '%tions' and length(token) >= 9 then left(token, length(token) - 5) when token like '%ation' and length(token) >= 9 then left(token, length(token) - 5)
        when token like '%tion' and length(token) >= 8 then left(token, length(token) - 4) when token like '%ings' and length(token) >= 8 then left(token, length(token) - 4)
        when token like '%ing' and length(token) >= 7 then left(token, length(token) - 3) when token like '%ment' and length(token) >= 8 then left(token, length(token) - 4)
        when token like '%edly' and length(token) >= 8 then left(token, length(token) - 4) when token like '%ed' and length(token) >= 6 then left(token, length(token) - 2)
        when token like '%ly' and length(token) >= 6 then left(token, length(token) - 2) when token like '%es' and length(token) >= 6 then left(token, length(token) - 2)
        when token like '%s' and length(token) >= 5 then left(token, length(token) - 1) else token end as stem
    from t"""
)
def stems(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("token")).distinct()
    return words.select("token", X.stem(F.col("token")).alias("stem"))


@query(
    r"""
    with l as (select doc_id, lower(text) as t from documents),
    m as (select doc_id, (contains(t, 'la ') or contains(t, ' les ')) as fr, (contains(t, ' der ') or contains(t, 'keit')) as de, (contains(t, ' los ') or contains(t, 'ción')) as es, (contains(t, ' the ') or contains(t, ' of ')) as en from l)
    select doc_id, concat_ws(',', case when fr then 'fr' end, case when de then 'de' end, case when es then 'es' end, case when en then 'en' end) as domains,
        case when fr then 'fr' when de then 'de' when es then 'es' when en then 'en' else 'unknown' end as domain from m"""
)
def domains_detected(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(X.labels_of(F.col("text"), DOMAINS), ",").alias("domains"), X.first_label(F.col("text"), DOMAINS, "unknown").alias("domain"))


@query("select doc_id, lower(strip_accents(text)) as folded from documents")
def folded_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.fold(F.col("text")).alias("folded"))


@query(
    r"""
    select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title,
        len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1)))::int as n_links, list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))[1] is not null as has_link,
        regexp_extract(url, '^https?://([^/?#]+)', 1) as host from pages"""
)
def page_titles_and_links(spark, sf_dir):
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).alias("n_links"), (F.size(links) > 0).alias("has_link"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))


@query(
    r"""
    select page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(?:script|style|head)[^>]*>.*?</(?:script|style|head)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')))::int as n_chars from pages"""
)
def page_text_lengths(spark, sf_dir):
    plain = F.regexp_replace(F.regexp_replace("html", "(?s)<(?:script|style|head)[^>]*>.*?</(?:script|style|head)>", " "), "<[^>]+>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.length(X.normalize_whitespace(plain)).alias("n_chars"))


@query("select event_id, coalesce(json_extract_string(props, '$.k')::bigint, -1) as k from events where json_extract(props, '$.k') is not null")
def json_metadata(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").filter(k.isNotNull()).select("event_id", k.alias("k"))


@query(
    r"""
    with l as (select doc_id, unnest(regexp_split_to_array(text, '\n')) as x, generate_subscripts(regexp_split_to_array(text, '\n'), 1) as i from documents),
    h as (select *, regexp_matches(x, '^ *[A-Z][a-z]*\.$') as head from l),
    g as (select *, sum(head::int) over (partition by doc_id order by i) as unit, coalesce(sum(length(x) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as start from h)
    select doc_id, unit::bigint as unit, min(start)::int as "start", max(start + length(x))::int as "end", regexp_extract(arg_min(x, i), '^ *([A-Z][a-z]*)\.$', 1) as word from g where unit > 0 group by doc_id, unit"""
)
def structured_units(spark, sf_dir):
    found = provisions.units(table(spark, sf_dir, "documents"), levels=(("word", r"^ *([A-Z][a-z]*)\.$"),))
    return found.select("doc_id", "unit", "start", "end", "word")


@query(
    r"""
    with t as (select *, row_number() over (partition by conv_id order by turn) as p, sum(length(text) + 2) over (partition by conv_id order by turn) - 2 as used from conversations)
    select conv_id, turn, used::bigint as used from t where p = 1 or used <= 1200"""
)
def context_packed(spark, sf_dir):
    return selection.packed(table(spark, sf_dir, "conversations"), 1200, "conv_id", "turn").select("conv_id", "turn", "used")


@query(
    r"""
    select source, count(*) as n_rows, count(distinct doc_id) as n_ids, count(*) filter (where coalesce(trim(text) <> '', false)) as with_content, count(*) filter (where not coalesce(trim(text) <> '', false)) as without_content
    from documents group by source"""
)
def corpus_inventory(spark, sf_dir):
    return inventory.inventory(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), ["source"])


@query("select lang, coalesce(source, '') as source, count(*) as n from documents group by all")
def type_histogram(spark, sf_dir):
    return inventory.histogram(table(spark, sf_dir, "documents"), "lang", "source")


@query(
    """
    select array_to_string(list_sort(list(distinct lang)), ',') as present,
        array_to_string(list_sort(list_filter(['de', 'en', 'es', 'fr', 'pl'], lambda x: not list_contains(list(distinct lang), x))), ',') as missing,
        case when len(list_filter(['de', 'en', 'es', 'fr', 'pl'], lambda x: not list_contains(list(distinct lang), x))) = 0 then 'ok' when count(lang) = 0 then 'empty' else 'incomplete' end as status from documents"""
)
def corpus_health(spark, sf_dir):
    row = inventory.health(table(spark, sf_dir, "documents"), "lang", ["de", "en", "es", "fr", "pl"])
    return row.select(F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"), "status")


@query(
    """
    select event_type, count(*) as total, count(*) filter (where coalesce(cast(value as varchar) <> '', false)) as has_value, count(*) filter (where coalesce(props <> '', false)) as has_props
    from events group by event_type"""
)
def metadata_coverage(spark, sf_dir):
    return inventory.coverage(table(spark, sf_dir, "events"), ["value", "props"], ["event_type"])


@query(
    """
    with c as (select conv_id, text, row_number() over (partition by sha256(text) order by conv_id, turn) as rn, turn from conversations)
    select conv_id, turn from c where rn = 1"""
)
def first_of_equal_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    return selection.first_by(rows, ["h"], ["conv_id", "turn"]).select("conv_id", "turn")


@query(
    """
    with n as (select l_partkey, max(l_quantity::bigint) as most, list(distinct l_quantity::bigint) as have from lineitem group by l_partkey)
    select l_partkey, array_to_string(list_sort(list_filter(range(1, most + 1), lambda x: not list_contains(have, x))), ',') as missing from n"""
)
def sequence_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").cast("long").alias("quantity"))
    return selection.missing_numbers(rows, "l_partkey", "quantity").select("l_partkey", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


@query(
    """
    with t as (select conv_id, turn, role, lead(turn) over (partition by conv_id order by turn) as nxt from conversations)
    select conv_id, count(nxt) * 2 as n_edges from t group by conv_id having count(nxt) > 0"""
)
def neighbour_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("node", F.struct("conv_id", "turn"))
    edges = provisions.sibling_edges(rows, ["conv_id"], "turn", "node")
    return edges.groupBy(F.col("source.conv_id").alias("conv_id")).agg(F.count("*").alias("n_edges"))


@query(
    """
    with q as (select doc_id, text, 5 as s, 25 as e, case when doc_id % 3 = 0 then substr(text, 6, 20) else substr(text, 7, 20) end as quote from documents)
    select doc_id, substr(text, s + 1, e - s) is not distinct from quote as valid from q"""
)
def source_spans_checked(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    quote = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 6, 20)).otherwise(F.substring("text", 7, 20))
    rows = docs.select("doc_id", "text", F.lit(5).alias("s"), F.lit(25).alias("e"), quote.alias("quote"))
    return provisions.spans_hold(rows, "text", "s", "e", "quote").select("doc_id", "valid")


@query(
    r"""
    select doc_id, concat_ws(',', case when length(trim(text)) = 0 then 'empty' end, case when regexp_matches(text, '[0-9]{11}') then 'personal_data' end, case when contains(lower(text), 'the') is false then 'no_stop_word' end) as term_errors from documents"""
)
def term_checks(spark, sf_dir):
    from lantern.operators.evidence import errors

    rules = {"empty": F.length(F.trim("text")) > 0, "personal_data": ~F.rlike("text", F.lit("[0-9]{11}")), "no_stop_word": F.contains(F.lower("text"), F.lit("the"))}
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(errors(rules), ",").alias("term_errors"))


@query(
    """
    with d as (select doc_id, lower(text) as t from documents)
    select doc_id, contains(t, 'the') and contains(t, 'and') and not contains(t, 'license') as passed from d"""
)
def context_terms_pass(spark, sf_dir):
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return table(spark, sf_dir, "documents").select("doc_id", evaluation.terms_pass(F.col("text"), lit("the", "and"), lit("license")).alias("passed"))


@query(
    """
    select doc_id, sum(s) as section_score from (
        select doc_id, case when regexp_matches(lower(text), 'tion') then 2.0 else 0.0 end + case when regexp_matches(lower(text), '[0-9]{3}') then -1.5 else 0.0 end + case when regexp_matches(lower(text), 'keit|ung') then 0.5 else 0.0 end as s from documents)
    group by doc_id"""
)
def section_scores(spark, sf_dir):
    from lantern.operators.fusion import section_score

    score = section_score(F.col("text"), {"tion": 2.0, "[0-9]{3}": -1.5, "keit|ung": 0.5})
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("section_score"))


@query("select doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as position from documents qualify position <= 2")
def capped_per_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    top = selection.capped(docs, ["source"], [F.desc("n_chars"), "doc_id"], 2)
    return top.select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("position"))
