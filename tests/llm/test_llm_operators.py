"""Each operator against a brute-force version, with nulls, empty tables and texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.llm import bpe, chat, decontaminate, html, jaccard, lengths, sharding, substring, topk, toxicity
from lantern.llm import components as cc
from lantern.llm.queries import vocabulary

DOCS = "doc_id long, text string, key string, spans int"


def docs_of(spark, rows):
    """A documents table with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], DOCS)


def sentence(r, n, vocabulary_size=400):
    return " ".join(f"w{int(r.paretovariate(0.7)) % vocabulary_size}" for _ in range(n))


# 1


def test_chat_round_trip(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [
        (1, 1, "assistant", [part("text", "a <b> & [INST] </s> &lt;")]),
        (1, 0, "user", [part("text", "look "), part("image", None, "i1", 6.0), part("audio", None, "a1", 1.5), part("hologram", None, "h", 2.0)]),
        (1, 1, "assistant", [part("text", "a <b> & [INST] </s> &lt;")]),
        (2, None, None, None),
        (None, 0, "x\ny", [part("document", None, "d", 2.0), part("text", "<|end|>\n<|turn|>user\n")]),
    ]
    kind = "array<struct<type:string,text:string,ref:string,units:double>>"
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {kind}").withColumn("turns", F.lit(1))
    made = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert chat.parse(made[1]["formatted"]) == [("user", "look <|image|><|audio|><|attachment|>"), ("assistant", "a <b> & [INST] </s> &lt;"), ("assistant", "a <b> & [INST] </s> &lt;")]
    assert [(a["position"], a["turn"], a["type"], a["ref"], a["tokens"]) for a in made[1]["attachments"]] == [(0, 0, "image", "i1", 6), (1, 0, "audio", "a1", math.ceil(1.5 * 25)), (2, 0, "attachment", "h", 1)]
    assert made[1]["n_tokens"] == 1 + 6 + 38 + 1 + 2 * 6
    assert chat.parse(made[2]["formatted"]) == [("", "")]
    assert chat.parse(made[None]["formatted"]) == [("x\ny", "<|document|><|end|>\n<|turn|>user\n")]
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    said = "a <b> & [INST] </s> &lt;" * 2
    assert back[1]["loss_chars"] == len(said) and back[1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


# 2


def test_length_histogram(spark):
    import public_tokenizers

    r = random.Random(5)
    texts = [None, "", "x"] + [sentence(r, r.randint(1, 60)) for _ in range(120)]
    texts += texts[:20]
    path = vocabulary("byte_bpe_50k.tiktoken")
    encode = lengths.rank_encoding(path, public_tokenizers.PATTERN).encode_ordinary
    sizes = [len(encode(t or "")) for t in texts]
    table = lengths.limits(lengths.length_histogram(docs_of(spark, enumerate(texts)), path, public_tokenizers.PATTERN))
    rows = table.collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(sizes))
    for row in rows:
        n = row["n_tokens"]
        assert (row["n_docs"], row["docs_from"], row["docs_to"]) == (sizes.count(n), sum(s >= n for s in sizes), sum(s <= n for s in sizes))
        assert row["tokens_from"] == sum(s for s in sizes if s >= n) and row["truncated_tokens"] == sum(min(s, n) for s in sizes)
        assert row["lost_tokens"] == sum(max(0, s - n) for s in sizes) and row["total_tokens"] == sum(sizes) and row["total_docs"] == len(sizes)
    for row in lengths.at_limits(table, [0, 17, 10**6]).collect():
        assert row["docs_over"] == sum(s > row["context_limit"] for s in sizes) and row["kept_tokens"] == sum(min(s, row["context_limit"]) for s in sizes)
    assert {r["share"]: r["n_tokens"] for r in lengths.quantiles(table, [0.5, 1.0]).collect()} == {0.5: sorted(sizes)[math.ceil(len(sizes) / 2) - 1], 1.0: max(sizes)}
    assert lengths.limits(lengths.length_histogram(docs_of(spark, []), path, public_tokenizers.PATTERN)).count() == 0


# 3


def test_templates_catch_changed_values(spark):
    item = "A train leaves Boston at 60 km per hour while another leaves Denver at 45 km per hour and they meet after 3 hours"
    changed = item.replace("Boston", "Paris").replace("60", "72").replace("45", "51").replace("3 hours", "4 hours").replace("Denver", "Rome")
    clash = item.replace("60", "72").replace("45", "72")  # two values became one
    filler = "nothing of note was said here about any of that and so it goes on. "
    rows = [(1, filler + item + ". " + filler), (2, filler + changed), (3, filler + clash), (4, filler * 3), (5, None), (6, ""), (None, item), (7, " ".join(item.split()[:9])), (1, filler + item + ". " + filler)]
    bench = spark.createDataFrame([(10, item, 0), (11, "too short", 0), (12, None, 0), (None, item, 0), (13, "five words are one window", 0)], "item_id long, text string, doc int")
    found = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.leaks(docs_of(spark, rows), bench).collect()}
    assert found == {(1, 10): True, (2, 10): False}
    kept = decontaminate.without_leaks(docs_of(spark, rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [3, 4, 5, 6, 7] and kept.columns == ["doc_id", "text", "key", "spans"]
    assert decontaminate.leaks(docs_of(spark, []), bench).count() == 0
    assert decontaminate.leaks(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_leaks_against_search(spark):
    r = random.Random(8)
    items = [(k, sentence(r, r.randint(10, 40), 4000)) for k in range(20)]
    rows, truth = [], set()
    for i in range(80):
        text = sentence(r, r.randint(0, 80), 4000)
        if i % 4 == 0:
            k, t = r.choice(items)
            truth.add((i, k))
            text = f"{text} {t} {sentence(r, 5, 4000)}"
        rows.append((i, text))
    found = decontaminate.leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in found.collect()} == truth


def test_leaks_at_openings_of_sentences(spark):
    item = "Tom has 3 cats. Ann has 4 dogs. Bob has 9 fish. How many animals do they have?"
    changed = "Eva has 5 cats. Jim has 7 dogs. Lea has 8 fish. How many animals do they have?"
    short = "Whales breathe air through blowholes daily"
    bench = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    rows = [(1, changed), (2, "we read that Whales breathe air through blowholes daily and more"), (3, "we read that whales breathe air through blowholes daily"), (4, "Tom has a cat. Ann has a dog.")]
    found = {(r["doc_id"], r["item_id"]): (r["n_words"], r["start"], r["exact"]) for r in decontaminate.leaks(docs_of(spark, rows), bench).collect()}
    assert found == {(1, 1): (18, 0, False), (2, 2): (6, 3, True), (3, 2): (6, 3, True)}


def test_leaks_of_values_and_short_items(spark):
    head = "the old gardener waters every single plant behind the quiet house before the sun rises and leaves"
    items = [(1, "What is 12 + 7 - 3 * 5"), (2, "Ann, Bob, Cyd, Dee, Eve, Fay, Gil"), (3, f"{head} 2 of 2"), (4, "Define quiet entropy")]
    rows = [(1, "so what is 12 + 7 - 3 * 5 then"), (2, "for Ann, Bob, Cyd, Dee, Eve, Fay, Gil it was"), (3, f"{head} 2 of 6"), (4, f"{head} 3 of 6"), (5, "define quiet entropy, they said"), (6, "define loud entropy"), (7, "what is 13 + 8 - 4 * 6")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.leaks(docs_of(spark, rows), bench).collect()}
    assert found == {(1, 1): True, (2, 2): True, (3, 3): True, (4, 3): False, (5, 4): True}


def test_leaks_with_names_of_other_lengths(spark):
    items = [
        (1, "Alice has 5 red apples. Bob gives Alice 3 kg of rice. Carol pays 9 dollars. How much does Alice own?"),
        (2, "A traveller flew from Paris to Berlin with 3 bags and paid 40 euros for each of them at the desk."),
        (3, "Mary has 4 cups. Mary gives 2 cups to John Smith and then buys 7 more cups from the shop near home."),
        (4, "old Tom feeds 2 grey cats"),
    ]
    rows = [
        (1, "Peter has 7 red apples. Dave gives Peter 4 kg of rice. Erin pays 8 dollars. How much does Peter own?"),
        (2, "So: A traveller flew from New York to Rome with 5 bags and paid 60 euros for each of them at the desk."),
        (3, "Anna has 6 cups. Anna gives 3 cups to Tom and then buys 9 more cups from the shop near home."),
        (4, "Peter has 7 red apples. Dave gives Erin 4 kg of rice. Erin pays 8 dollars. How much does Frank own?"),  # Alice is three
        (5, "and old Ann Lee feeds 3 grey cats"), (6, "an old man feeds 2 grey cats"), (7, "New York, Rome and Paris"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["n_words"], r["start"], r["exact"]) for r in decontaminate.leaks(docs_of(spark, rows), bench).collect()}
    assert found == {(1, 1): (21, 0, False), (2, 2): (22, 1, False), (3, 3): (21, 0, False), (5, 4): (7, 1, False)}


# 4


def test_pages(spark):
    page = "<html><head><title>T</title></head><body><nav>menu</nav><div class='ad'>buy<div>now</div></div><article><header><h1>Head &amp; <i>line</i></h1></header><p>One<br>two\n three<script>var a='</p>';</script></p><div id=comments>no</div><p>A &lt; B</p></article><footer>f</footer></body></html>"
    bare = lambda text: f"<body><div>Site name</div><p>{text}</p><div>Imprint</div></body>"
    rows = [
        (1, "http://a.org/x/1", page, 0), (2, "http://b.org/n/1", bare("first"), 0), (3, "http://b.org/n/2?q=1", bare("second"), 0), (4, "http://b.org/z", bare("third"), 0),
        (5, None, bare("alone"), 0), (6, "http://c.org/", None, 0), (7, "http://c.org/y", "", 0), (2, "http://b.org/n/1", bare("first"), 0), (8, "http://d.org/only", bare("single"), 0),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, row int")
    found = html.extract(df).collect()
    text = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert text[1] == "Head & line\n\nOne two three\n\nA < B"
    assert [text[k] for k in (2, 3, 4)] == ["first", "second", "third"]
    assert text[5] == "Site name\n\nalone\n\nImprint" and text[8] == "Site name\n\nsingle\n\nImprint" and text[6] == text[7] == ""
    assert html.extract(df.limit(0)).count() == 0


def test_copies_keep_their_article(spark):
    bare = lambda text: f"<body><div>Site name</div>{text}<div>Imprint</div></body>"
    long = "".join(f"<p>paragraph {i} tells a story of its own at some length</p>" for i in range(20))
    rows = [
        (1, "http://a.org/n/1", bare("<p>first</p>")), (2, "http://a.org/n/1?utm=x", bare("<p>first</p>")), (3, "http://a.org/n/1/print", bare("<p>first</p>")), (4, "http://a.org/z", bare("<p>other</p>")),
        (5, "http://b.org/n/1", bare(long)), (6, "http://b.org/n/1/print", bare(long + "<p>printed</p>")),
    ]
    text = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [text[k] for k in (1, 2, 3, 4)] == ["first", "first", "first", "other"]
    assert all(f"paragraph {i} tells" in text[k] for i in range(20) for k in (5, 6)) and "printed" in text[6]


def test_furniture_by_markup():
    """Names inside an article are its own unless they mark an element that holds others; end tags may be left out."""
    text = lambda page: html.article(*html.blocks(page)).split("\n\n")
    assert text("<article><h2 id=search>Search methods</h2><section id='related-work'>R</section><section class='alert-systems'>A</section><p class='comment-free'>C<p class=notice>N</article>") == ["Search methods", "R", "A", "C", "N"]
    assert text("<article><p class='ad'>Buy<p>Real one.<p>Real two.</article>") == ["Real one.", "Real two."]
    assert text("<article><ul><li class='share'>x<li>y</ul><p>Z</article>") == ["y", "Z"]
    assert text("<article><p>one <math><mi>x</mi>=1</math> two</p><object>fallback</object></article>") == ["one x=1 two", "fallback"]
    assert text("<article>Long article text</article><article class='comment'>me too</article><section id=comments><article>reader</article></section>") == ["Long article text"]
    assert text("<div class='layout with-sidebar'><form><article>A<p>B</article></form></div>") == ["A", "B"]
    assert text("<form><div>whole page</div></form>") == ["whole page"] and text("<div>page with<form>name</form></div>") == ["page with"]
    assert text("<div class='sidebar'><article>teaser</article></div><div>Long text of the page</div>") == ["Long text of the page"]
    assert text("<table><tr><td class=nav>n<td>text<tr><td>more</table>after") == ["text", "more", "after"]
    assert text("<article><div class='cookie-notice'>c</div><div class='share-buttons'>s</div><a class=share>s</a>t</article>") == ["t"]
    assert text("") == text("<nav>a") == text("<p class='ad'>b") == [""] and text("</div></p>x</b>") == ["x"]


def site(r, host, n, marked):
    """Pages of a host in URL order with their article's lines; furniture is shared, partly without a mark of its own."""
    top, foot = ([sentence(r, 4) for _ in range(3)] for _ in range(2))
    pages, last = [], None
    for i in range(n):
        lines = [f"{host} {i} {sentence(r, r.randint(20, 60))}" for _ in range(r.choice([1, 3, 8, 200 if i == 4 else 5]))]
        if last and marked and i % 3 == 0:  # a near copy
            lines = [*last[:-1], lines[0]]
        last = lines
        shown = "".join(r.choice([f"<p>{x}", f"<p id='search'>{x}</p>", f"<div>{x}</div>", f"<ul><li>{x}</ul>", f"<h2 class='menu'>{x}</h2>"]) for x in lines)
        extra = f"<p class=ad>only here {i}<p>" if i % 2 else f"<aside>news {i}</aside>"
        body = "".join(f"<div>{x}</div>" for x in top) + (f"<article>{shown}{extra}</article>" if marked else f"{extra}{shown}") + "".join(f"<p>{x}" for x in foot)
        pages.append((f"http://{host}/a/{i:03d}", f"<html><body><nav>menu {i}</nav>{body}<footer>f {i}</footer>", "\n\n".join(lines)))
    return pages


def test_articles_by_force(spark):
    r = random.Random(15)
    pages = [x for k in range(6) for x in site(r, f"h{k}.org", 12, k % 2 == 0)]
    rows = [(i, url, page, 0) for i, (url, page, _) in enumerate(pages)]
    rows += rows[:5]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, gone int")
    found = html.extract(df).collect()
    assert len(found) == len(rows) and all(x["text"] == pages[x["page_id"]][2] for x in found)
    assert html.differences(html.parse_pages(df, "page_id").dropDuplicates(["row"])).count() == 36  # all pages without a mark


def test_lcs_against_a_table():
    r = random.Random(9)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        got = html.lcs(a, b)
        rest = iter(b)
        assert got == sorted(set(got)) and len(got) == best[-1, -1] and all(a[i] in rest for i in got)


def test_neighbours_do_not_depend_on_partitions(spark):
    r = random.Random(4)
    rows = [(f"h{r.randint(0, 2)}", f"/{r.choice('ab')}/{r.randint(0, 60)}", i) for i in range(90)]
    df = spark.createDataFrame(rows, "host string, path string, row long")
    truth, order = {}, sorted(rows)
    share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for i, (h, p, k) in enumerate(order):
        near = [(-share(p, order[j][1]), j > i, order[j][2]) for j in (i - 1, i + 1) if 0 <= j < len(order) and order[j][0] == h]
        truth[k] = min(near)[2]
    assert {x["row"]: x["other"] for x in html.neighbours(df).collect()} == truth


# 5


def classes_by_force(rows, words=5, percent=75):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(least[a], least[b])
            moved |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return {i: (len(sets[i]), least[i]) for i in sets}


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_against_all_pairs(spark, monkeypatch, small):
    if small:  # many batches, and n-grams that are common in one
        monkeypatch.setattr(jaccard, "BATCH_DOCS", 17)
        monkeypatch.setattr(jaccard, "COMMON", 3)
    r = random.Random(11)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "É two"), (6, "é two")]
    rows += [(i, sentence(r, r.randint(1, 120))) for i in range(7, 60)]
    base = sentence(r, 150).split()
    for i in range(60, 160):  # a large group of near copies, some only linked through others
        t = list(base)
        for _ in range(r.randint(0, 9)):
            t[r.randrange(len(t))] = f"x{r.randint(0, 9)}"
        rows.append((i, " ".join(t)))
    rows += [(i, rows[r.randrange(7, 160)][1]) for i in range(160, 190)]
    passage = sentence(r, 60)
    rows += [(i, f"{sentence(r, 40)} {passage} {sentence(r, 40)}") for i in range(190, 220)]
    r.shuffle(rows)
    found = jaccard.similar_documents(docs_of(spark, rows)).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found} == classes_by_force(rows) and len(found) == len(rows)


def test_jaccard_odd_rows(spark):
    rows = [(4, "a b c d e f g"), (None, "a b c d e f g"), (4, "a b c d e f g"), (9, "a b c d e f g"), (None, None)]
    found = jaccard.similar_documents(docs_of(spark, rows)).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in found if x["doc_id"]) == [(4, 3, 4), (4, 3, 4), (9, 3, 4)]
    assert sorted((x["n_shingles"], x["component_id"]) for x in found if x["doc_id"] is None) == [(0, None), (3, None)]
    assert jaccard.similar_documents(docs_of(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (5, 5)]
    found = {r["node"]: r["label"] for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys([*range(41), 100], 0), 200: 200, 201: 200}


# 6


def test_shards(spark):
    rows = [(i, f"text {i}é") for i in range(300)] + [(7, None), (None, "n"), (None, "n"), (7, "text 7é")]
    found = sharding.assign(docs_of(spark, rows), 16).collect()
    assert len(found) == len(rows)
    by = {}
    for x in found:
        by.setdefault(x["shard"], []).append(x["slot"])
        assert x["grown_shard"] in (x["shard"], 16) and x["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) == set(range(16))
    got = sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["size"], x["text_crc32"]) for x in found)
    assert got == sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert len({x["shard"] for x in found if x["doc_id"] == 7}) == 1
    draw = lambda key, leaf: -math.log((int(hashlib.md5(f"{key}:{leaf}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
    assert all(x["shard"] == min(range(16), key=lambda s: draw(x["doc_id"], s)) for x in found if x["doc_id"] is not None)
    assert sharding.assign(docs_of(spark, [])).count() == 0


def test_weights_move_keys_only_to_or_from_the_changed_leaf(spark):
    leaves = sharding.tree(8)
    heavy = [sharding.Shard(s.region, s.rack, s.index, 3.0 if s.index == 5 else 1.0) for s in leaves]
    df = spark.range(3000).select(sharding.descend(F.col("id"), leaves).alias("a"), sharding.descend(F.col("id"), heavy).alias("b"))
    rows = df.collect()
    assert all(x["b"] == 5 for x in rows if x["a"] != x["b"]) and abs(sum(x["b"] == 5 for x in rows) / 3000 - 0.3) < 0.04


# 7


def test_bpe_as_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    own, theirs = bpe.model(path), Tokenizer.from_file(path)
    r = random.Random(1)
    texts = ["", "It's we'LL \x1cx", "ΑΣ ΣΑΣ!", "foo<|endoftext|>bar <|startoftext|> <|endoftext|", "İstanbul ﬁ é", "日本語 123 ½", "x" * 3000, "　y​z"]
    texts += ["".join(r.choice("abcé'ßÉ12 .!<|>\n\t́ΣσŁ\x1f漢𝒳") for _ in range(r.randint(1, 80))) for _ in range(600)]
    for t in texts:
        e = theirs.encode(t, add_special_tokens=False)
        assert own.encode_decode(t) == (" ".join(map(str, e.ids)), theirs.decode(e.ids, skip_special_tokens=False))
        assert own.encode(t) == e.ids and own.decode(e.ids) == theirs.decode(e.ids, skip_special_tokens=False)
    rows = [(1, "Hello there"), (2, None), (3, ""), (None, "Hello there"), (1, "Hello there")]
    found = bpe.encode_documents(docs_of(spark, rows), path).collect()
    assert sorted((x["doc_id"] or 0, x["n_tokens"], x["decoded"]) for x in found) == [(0, 2, "hello</w> there</w>"), (1, 2, "hello</w> there</w>"), (1, 2, "hello</w> there</w>"), (2, 0, ""), (3, 0, "")]
    digests = {x["doc_id"]: x["ids_sha256"] for x in bpe.encode_digests(docs_of(spark, rows), path).collect()}
    assert digests[2] == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_documents(docs_of(spark, []), path).count() == 0


def test_bpe_does_not_depend_on_its_cache(monkeypatch):
    path = vocabulary("word_bpe_49k.json")
    text = sentence(random.Random(2), 300) + " the then there's " * 20
    want = bpe.WordBpe(path).encode_decode(text)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    assert bpe.WordBpe(path).encode_decode(text) == want


# 8


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k_by_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "QUERY_TILE", 7)
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "COLUMNS", 16)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    r = random.Random(6)
    rows = [(i, [r.uniform(-1, 1) * scale for _ in range(4)]) for i in range(200)] + [(300 + i, [0.5 * scale] * 4) for i in range(40)]
    rows += [(500, None), (550, [None, 1.0, 1.0, 1.0]), (600, [float("nan")] * 4), (650, [float("inf")] * 4), (None, [1.0] * 4), (700, [1.0] * 3), (0, rows[0][1]), (50, [scale] * 4)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, v int")
    base = topk.scaled(df)
    found = {}
    for x in topk.top_k(base.filter("vec_id % 50 = 0"), base, 5).orderBy("query_id", "rank").collect():
        found.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    ok = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    truth = {}
    for q in {i for i, _ in ok if i % 50 == 0}:
        best = {}
        for a in {v for i, v in ok if i == q}:
            for i, v in ok:
                if i != q and len(v) == len(a):
                    best[i] = max(best.get(i, -(10**30)), sum(x * y for x, y in zip(a, v)))
        truth[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert found == {q: t for q, t in truth.items() if t}
    assert topk.top_k(base.limit(0), base).count() == 0 and topk.top_k(base, base.limit(0)).count() == 0


def test_top_k_of_huge_components(spark):
    """Scores beyond a long end at its limits; a component that leaves the doubles takes its row out."""
    rows = [(0, [1e17, 1e17]), (1, [1e17, 1e17]), (2, [-1e17, -1e17]), (3, [1e-3, 1.0]), (4, [1e308, 0.0]), (5, [3e15, 1.0])]
    base = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = [(x["query_id"], x["vec_id"], x["score"]) for x in topk.top_k(base.filter("vec_id in (0, 3)"), base, 5).orderBy("query_id", "rank").collect()]
    whole = lambda v: [math.floor(256 * x) for x in v]
    score = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(whole(rows[a][1]), whole(rows[b][1])))))
    want = [(q, i, score(q, i)) for q in (0, 3) for i in sorted((i for i in (0, 1, 2, 3, 5) if i != q), key=lambda i: (-score(q, i), i))]
    assert found == want and {s for _, _, s in found} >= {2**63 - 1, -(2**63)}


# 9


def kept_by_force(rows, window=50):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i if i is not None else -1, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_substring_dedup_by_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(substring, "BATCH_BYTES", 3000)
        monkeypatch.setattr(substring, "BROADCAST_SPANS", 0)
    r = random.Random(12)
    passages = [sentence(r, n) for n in (49, 50, 51, 90, 130)] + ["a b c d e f " * 20, "z " * 140]
    rows = [(None, passages[4]), (1000, None), (1001, ""), (1002, passages[4].upper())]
    for i in range(120):
        pieces = [sentence(r, r.randint(0, 40)) for _ in range(3)]
        for _ in range(r.randint(0, 2)):
            p = r.choice(passages)
            if r.random() < 0.3:
                w = p.split()
                w[r.randrange(len(w))] = "changed"
                p = " ".join(w)
            pieces.insert(r.randrange(3), p)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(pieces)))
    rows += [(200 + i, rows[r.randrange(10, 110)][1]) for i in range(20)] + [(30, rows[40][1]), (31, rows[35][1])]
    r.shuffle(rows)
    found = substring.kept_words(docs_of(spark, rows), 50).collect()
    assert sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["n_words"], x["n_removed"], x["kept_sha256"]) for x in found) == kept_by_force(rows)
    cut = substring.remove_repeats(docs_of(spark, rows), 50)
    assert cut.columns == ["doc_id", "text", "key", "spans"]
    texts = sorted((x["doc_id"] if x["doc_id"] is not None else -1, hashlib.sha256(b" ".join((x["text"] or "").encode().split())).hexdigest()) for x in cut.collect())
    assert texts == sorted((i, h) for i, n, gone, h in kept_by_force(rows) if not gone or gone < n)
    same = {x["doc_id"]: x["text"] for x in cut.collect()}
    assert same[1000] is None and same[1001] == ""
    assert substring.kept_words(docs_of(spark, []), 50).count() == 0


def test_factors_are_the_longest_copies(spark):
    """Each factor is a copy of its source; together they cover the words that windows find, and none is needless."""
    r = random.Random(21)
    base = sentence(r, 400, 5000).split()
    rows = [(1, " ".join(base[:200])), (2, " ".join(base[150:400])), (5, " ".join(["x"] * 3 + base[20:390] + ["y"] * 60)), (7, " ".join(base[20:120] + ["z"] + base[121:260]))]
    words = {i: t.split() for i, t in rows}
    found = {x["doc_id"]: [s.asDict() for s in x["spans"]] for x in substring.factors(docs_of(spark, rows)).collect()}
    assert all(words[i][s["start"] : s["end"]] == words[s["source"]][s["at"] : s["at"] + s["end"] - s["start"]] and s["source"] < i for i, own in found.items() for s in own)
    # The window at word 133 is the last that document 1 holds, so the factor from document 2 begins after it.
    assert [(s["start"], s["end"], s["source"]) for s in found[5]] == [(3, 183, 1), (134, 373, 2)]
    assert set(found) == {2, 5, 7}
    spans = [dict(start=a, end=b, source=s, at=t) for a, b, s, t in [(0, 50, 1, 0), (1, 60, 1, 1), (1, 70, 2, 9), (40, 120, 3, 0), (30, 80, 1, 400), (200, 250, 1, 7)]]
    assert [(s["start"], s["end"], s["source"]) for s in substring.parsed(spans)] == [(0, 60, 1), (40, 120, 3), (200, 250, 1)]
    for _ in range(200):
        spans = [dict(start=a, end=a + r.randint(1, 30), source=r.randint(0, 3), at=r.choice([0, a])) for a in (r.randint(0, 80) for _ in range(r.randint(0, 20)))]
        assert (substring.covered(substring.parsed(spans), 120) == substring.covered(spans, 120)).all()


# 10


def labelled(r, n, first=0):
    rows, labels = [], []
    for i in range(first, first + n):
        words = sentence(r, r.randint(30, 200)).split()
        rude, poor = r.random() < 0.25, r.random() < 0.3
        if rude:
            words[r.randrange(len(words))] = r.choice(["Vile!", "foul", "(nasty)"])
            words[r.randrange(len(words))] = r.choice(["vile", "Foul.", "nasty"])
        if poor:
            words += ["clickhere"] * 2
        rows.append((i, " ".join(words)))
        labels.append((i, int(poor), int(rude)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(3)
    rows, labels = labelled(r, 900)
    known = spark.createDataFrame([*labels[:600], (1, None, 1), (None, 1, 1)], "doc_id long, poor int, rude int")
    df = docs_of(spark, rows + [(2000, None), (2001, ""), (None, "vile foul"), (2002, "vile nasty " * 2000)])
    chain = toxicity.train(df, known, {"poor": "poor", "rude": "rude"})
    assert len(chain) == 2 and len(chain[1].earlier) == 1
    found = {x["doc_id"]: x for x in toxicity.score(df, chain, ["poor", "rude"]).collect()}
    held = [(i, rude) for i, _, rude in labels[600:]]
    assert sum(found[i]["is_rude"] == bool(rude) for i, rude in held) / len(held) > 0.97
    assert found[2002]["is_rude"] and found[None]["is_rude"] and not found[2000]["is_rude"] and not found[2001]["is_rude"]
    kept = toxicity.keep(df, chain)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == {i for i, x in found.items() if not x["is_rude"]}
    again = toxicity.train(df.repartition(7), known, {"poor": "poor", "rude": "rude"})
    assert all(np.allclose(a.weights, b.weights) for a, b in zip(chain, again))


def test_toxicity_without_labels(spark):
    df = docs_of(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, poor int, rude int")
    chain = toxicity.train(df, none, {"poor": "poor", "rude": "rude"})
    assert chain == [] and [x["p_rude"] for x in toxicity.score(df, chain, ["poor", "rude"]).collect()] == [0.0, 0.0]
    assert toxicity.keep(df, chain).count() == 2 and toxicity.score(docs_of(spark, []), chain, ["rude"]).count() == 0
    alike = toxicity.train(df, spark.createDataFrame([(1, 1, 1)], none.schema), {"poor": "poor", "rude": "rude"})
    assert toxicity.score(df, alike, ["poor", "rude"]).count() == 2
