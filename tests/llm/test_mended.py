"""Cases that earlier rounds got wrong: parts of articles, names of other scripts, scores of the chain."""

import math
import re

import numpy as np
import pytest

from lantern.llm import decontaminate, html, toxicity


def text(page):
    return html.article(*html.blocks(page)).split("\n\n")


def test_comments_inside_an_article_go():
    assert text("<article><p>Story.</p><section id=\"comments\"><h2>Comments</h2><p>Reader A says</p></section></article>") == ["Story."]
    assert text("<article><p>Story.</p><div class=\"responses\"><p>Reader</p></div><ul id=replies><li>B</ul></article>") == ["Story."]
    assert text("<article><p>Story.</p><section id='comment-on-law'><p>Law</p></section></article>") == ["Story.", "Law"]


def test_parts_of_an_article_stay():
    page = "<article><p>Intro</p><div class='menu'>Starters, mains</div><div class='alert'>Warning: hot</div><div class='search'>binary search</div><section class='banner'>Banner text</section></article>"
    assert text(page) == ["Intro", "Starters, mains", "Warning: hot", "binary search", "Banner text"]
    assert text("<article><section class='banner'><p>All of the article.</p></section></article>") == ["All of the article."]
    assert text("<article><p>Intro</p><div class=menu><a href=/>Home</a> <a href=/x>News</a></div><div class='search'><input><button>Go</button></div></article>") == ["Intro"]
    assert text("<article><p>Intro</p><div class='notice'>We moved</div><div class='related'>More</div></article>") == ["Intro"]


def test_teasers_of_other_stories_go():
    assert text("<article><h1>Story</h1><p>Long text of it</p></article><article><h2><a href=/2>Other story</a></h2><p>Teaser</p></article>") == ["Story", "Long text of it"]
    assert text("<main><article><h1>Story</h1><p>Long text of it</p></article><article>Other</article><p>More of the page</p></main>") == ["Story", "Long text of it", "More of the page"]
    assert text("<article><h1>Story</h1><article>Part one of it</article><p>Long text</p></article>") == ["Story", "Part one of it", "Long text"]


@pytest.mark.parametrize("menu", [0, 5, 40, 100])
def test_menus_decide_nothing_about_copies(spark, menu):
    nav = "".join(f"<li><a href=/{i}>Section number {i}</a>" for i in range(menu))
    page = lambda k: f"<body><nav><ul>{nav}</ul></nav><div>Welcome to our pages</div><p>Own paragraph number {k} tells of {k} things</p><div>Copyright by us</div></body>"
    rows = [(k, f"http://m.org/a/{k}", page(k)) for k in range(4)]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in found} == {k: f"Own paragraph number {k} tells of {k} things" for k in range(4)}


@pytest.mark.parametrize("names", [("Łucja", "Żaneta"), ("Ольга", "Игорь"), ("Ödön", "Ágnes"), ("Ωμέγα", "Άλφα"), ("Ẽva", "Ṽera"), ("Ǆuro", "Ȼyd")])
def test_names_of_any_script(spark, names):
    item = "Last week Alice gave Bob 12 apples and then Bob gave Alice 3 pears, so how many apples did Bob keep for himself?"
    docs = spark.createDataFrame([(1, item.replace("Alice", names[0]).replace("Bob", names[1])), (2, "Nothing of the kind stands here at all, only some other words that go on and on.")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["exact"]) for r in decontaminate.leaks(docs, bench).collect()] == [(1, 7, False)]


def words(t):
    return set(re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower()))


def test_scores_by_a_plain_loop():
    """The chain's probabilities from sets of words, one document and one word at a time."""
    texts = ["bad worse bad", "good fine", "", "bad good unknown Words, words!", "żółw bad"]
    number = {w: int(f) for t in texts for c, feature in toxicity.feature_chunks([t.encode()]) for w, f in zip([c.data[a:b].tobytes() for a, b in zip(c.start, c.end)], feature)}
    weights = [{b"bad": 1.5, b"good": -2.0}, {b"worse": 0.5, b"fine": -1.0, "żółw".encode(): 3.0}]
    chain = []
    for i, (bias, own, earlier) in enumerate([(-0.5, weights[0], []), (0.25, weights[1], [1.75])]):
        order = sorted((number[w], v) for w, v in own.items())
        chain.append(toxicity.Link(f"c{i}", bias, np.array([f for f, _ in order], np.int32), np.array([v for _, v in order]), np.array(earlier)))
    found = toxicity.probabilities(chain, [t.encode() for t in texts])
    for k, t in enumerate(texts):
        before = []
        for i, link in enumerate(chain):
            z = link.bias + sum(weights[i].get(w, 0) for w in words(t)) + sum(a * p for a, p in zip(link.earlier, before))
            before.append(1 / (1 + math.exp(-z)))
        assert found[:, k] == pytest.approx(before, abs=1e-12)


def test_a_link_minimises_its_loss():
    """A fitted link is where a plain logistic loss with the same penalty no longer falls."""
    r = np.random.default_rng(3)
    y = np.repeat([0, 1], 300)
    lists = [np.unique(np.concatenate([r.integers(0, 40, 6), 50 + r.integers(0, 3, 1) if (label and r.random() < 0.8) or r.random() < 0.1 else np.zeros(0, int)])).astype(np.int32) for label in y]
    rows = toxicity.Rows(lists)
    link = toxicity._fit("c", rows, np.ones(600, bool), y.astype(float), [])
    assert set(link.features) <= {50, 51, 52} and len(link.features)

    def loss(bias, weights):
        table = dict(zip(link.features.tolist(), weights))
        total = 0.0
        for own, label in zip(lists, y):
            z = bias + sum(table.get(int(f), 0.0) for f in own)
            total += (math.log1p(math.exp(-z)) if label else math.log1p(math.exp(z))) * 0.5 / 300
        return total + 0.5e-5 * float(np.square(weights).sum())

    best = loss(link.bias, link.weights)
    for move in r.normal(0, 0.2, (20, len(link.weights) + 1)):
        assert best <= loss(link.bias + move[0], link.weights + move[1:]) + 1e-6
