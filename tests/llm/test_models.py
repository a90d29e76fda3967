"""The fitted operators: held-out accuracy, base counts against brute force, defined results of odd rows."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import chain, language, line_rules, quality_model, url_filter, wrapper
from textloom.llm.wordcodes import slices

ODD = [(1, None), (2, ""), (3, " \n\t\n"), (4, "12 345 —"), (5, "word " * 30_000), (5, "word " * 30_000), (None, "a b c\n" * 30)]


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels", "pages")}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("kept", F.lit(7))


def test_word_boundaries():
    texts = ["a b c", None, "", "  x\ty\n\nz ", "é\xa0w\n", "\n", "q"]
    for limit in (1, 8, 1000):
        for part in slices(pa.array(texts), limit):
            start, end, first = part.spans()
            for i in range(len(part)):
                words = [bytes(part.data[a:b]).decode() for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)]
                assert words == re.findall(r"[^\x20\x09-\x0D]+", texts[part.lo + i] or "")


def test_posteriors_and_viterbi_by_enumeration():
    rng = np.random.default_rng(0)
    scores, trans, start = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first = np.array([0, 4, 4, 5, 9])
    marginal, path = chain.posteriors(scores, first, trans, start), chain.viterbi(scores, first, trans, start)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if lo == hi:
            continue
        grid = np.array(np.meshgrid(*[range(3)] * (hi - lo), indexing="ij")).reshape(hi - lo, -1).T
        value = np.array([start[s[0]] + sum(scores[lo + t, s[t]] for t in range(hi - lo)) + sum(trans[a, b] for a, b in zip(s[:-1], s[1:], strict=True)) for s in grid])
        weight = np.exp(value - value.max())
        for t in range(hi - lo):
            expected = np.array([weight[grid[:, t] == k].sum() for k in range(3)]) / weight.sum()
            assert marginal[lo + t] == pytest.approx(expected)
        assert path[lo:hi].tolist() == grid[value.argmax()].tolist()


def test_line_rules_on_documents(spark, tables):
    model = line_rules.fit(tables["documents"], tables["labels"])
    judged = line_rules.judge(tables["documents"], model).join(tables["labels"], "doc_id", "left").collect()
    for r in judged[:300]:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {j for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in r["text"].split("\n") if x.split()]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r["text"])), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[c] for c in line_rules._COUNTS) == expected
    fair = [r for r in judged if r["quality"] is not None and not r["base_failed"]]
    assert np.mean([r["kept"] == bool(r["quality"]) for r in fair]) > 0.97


def test_line_rules_on_odd_rows(spark, odd, tables):
    model = line_rules.fit(tables["documents"], tables["labels"])
    rows = line_rules.judge(odd, model).collect()
    assert [r["n_words"] for r in rows if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert all(r["base_failed"] and not r["kept"] for r in rows)
    assert line_rules.keep(odd, model).columns == odd.columns
    none = tables["labels"].limit(0)
    neutral = line_rules.fit(tables["documents"], none)
    assert line_rules.judge(tables["documents"], neutral).filter("not base_failed and not kept").isEmpty()
    assert line_rules.judge(odd.limit(0), model).count() == 0


def test_lines_of_one_document_differ(tables):
    """Latent states: a line that many documents share is boilerplate in good documents too."""
    model = line_rules.fit(tables["documents"], tables["labels"])
    shares = [r["content_share"] for r in line_rules.judge(tables["documents"], model).collect() if not r["base_failed"]]
    assert len(model.known) and np.mean([0.02 < s < 0.98 for s in shares]) > 0.05
    codes = np.array([5, 6, 7, 5, 8, 5, 9, 5, 6, 7], dtype=np.uint64)
    first = np.array([0, 3, 5, 5, 7, 10])
    assert line_rules.recurring(codes, first).tolist() == []  # the last document is a copy; two others begin with 5 as well
    chance = np.array([0.9, 0.2, 0.1, 0.4, 0.3])
    content = line_rules.constrained(chance, np.array([1, 1, 1, 5, 5]), np.array([0, 3, 5]), np.array([0, 1]))
    assert content.tolist() == [True, False, False, True, False]


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the cat and dog number {i % 7} are here", "en") for i in range(400)] + [(1001, "ein hund und eine katze sind da", "de")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), limit=20)
    assert model.names == ["de", "en"]


def test_language_of_held_out_documents(tables):
    model = language.fit(tables["documents"])
    rows = language.identify(tables["documents"], model).filter(F.expr("crc32(cast(doc_id as string)) % 4 = 2")).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_language_of_mixed_and_odd_texts(spark, odd, tables):
    model = language.fit(tables["documents"])
    rows = language.identify(odd, model).collect()
    assert [r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 4)] == ["und"] * 4
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und") and rows[4]["lang_pred"] in model.names
    by = {r["lang"]: r["text"].split() for r in tables["documents"].filter("n_chars between 2000 and 4000").orderBy("doc_id").limit(80).collect()}
    text = " ".join([*by["de"][20:50], *by["fr"][20:50]])
    part = next(slices(pa.array([text])))
    scores, _, first = model.scores(part)
    best = chain.posteriors(scores, first, model.trans, model.start).argmax(axis=1)
    right = [model.names.index("de")] * 30 + [model.names.index("fr")] * 30
    assert np.mean(best == right) > 0.9
    assert language.identify(odd, None).filter("lang_pred <> 'und'").isEmpty()
    assert language.fit(tables["documents"].limit(0)) is None


def test_quality_of_held_out_documents(tables, odd):
    model = quality_model.fit(tables["documents"], tables["labels"])
    rows = quality_model.score(tables["documents"], model).join(tables["labels"], "doc_id").filter(F.expr("crc32(cast(doc_id as string)) % 4 = 2")).collect()
    assert np.mean([(r["score"] >= 0.7) == bool(r["quality"]) for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in quality_model.score(odd, model).collect())
    constant = quality_model.fit(tables["documents"], tables["labels"].limit(0))
    assert {r["score"] for r in quality_model.score(odd, constant).collect()} == {0.5}


def bags(rng, n_bags: int):
    sizes = rng.integers(0, 4, size=3 * n_bags)
    words = rng.integers(0, 50, size=sizes.sum())
    return rng.normal(size=(3 * n_bags, quality_model.N_FEATURES)), words, sizes, np.arange(0, 3 * n_bags + 1, 3)


def test_attention_gradient():
    """Each weight's gradient against a small step."""
    rng = np.random.default_rng(1)
    model = quality_model.AttentionModel(np.zeros(quality_model.N_FEATURES), np.ones(quality_model.N_FEATURES))
    told = bags(rng, 12)
    label = np.arange(12) % 3 == 0
    share = label.mean()
    weigh = np.where(label, 0.5 / share, 0.5 / (1 - share)) / 12

    def value() -> float:
        p = model.forward(*told)[0]
        return float((weigh * np.log(np.where(label, p, 1 - p))).sum())

    grads = model.gradient(*told, label.astype(float))
    for name, grad in grads.items():
        for k in rng.integers(0, grad.size, size=6) if name != "words" else told[1][:6] * quality_model.VECTOR:
            flat = model.w[name].reshape(-1)
            kept, step = flat[k], 1e-5
            flat[k] = kept + step
            up = value()
            flat[k] = kept - step
            down = value()
            flat[k] = kept
            assert grad.reshape(-1)[k] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-8), name


def test_attention_learns_which_passage_matters():
    rng = np.random.default_rng(2)
    model = quality_model.AttentionModel(np.zeros(quality_model.N_FEATURES), np.ones(quality_model.N_FEATURES))
    x, words, sizes, first = bags(rng, 40)
    label = (np.maximum.reduceat(x[:, 0], first[:-1]) > 0.8).astype(float)
    found = model.learn(x, words, sizes, first, label, rounds=300).forward(x, words, sizes, first)[0]
    assert np.mean((found > 0.5) == label) > 0.95


def test_urls(spark):
    model = url_filter.UrlModel({})
    assert model.segment("casinowinbonus") == ["casino", "win", "bonus"]
    assert model.segment("ththre") == ["ththre"]
    urls = [
        (1, "http://WWW.Example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (2, "https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        (3, "http://b.com/x#y", "b.com", "/x", "com/", "allow"),
        (4, "http://b.com", "b.com", "", None, "allow"),
        (5, "http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        (6, "http://onlinecasinoslots.org/free-spins", "onlinecasinoslots.org", "/free-spins", None, "block"),
        (7, "http://ththre.org/de/1", "ththre.org", "/de/1", None, "allow"),
        (8, None, "", "", None, "allow"),
        (9, "nothing", "", "", None, "allow"),
        (10, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ]
    pages = spark.createDataFrame([u[:2] for u in urls], "page_id long, url string").withColumn("verdict", F.lit("clash"))
    found = url_filter.judge(pages, url_filter.RULES, url_filter.fit(pages)).orderBy("page_id").collect()
    assert [(r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found] == urls


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a>Home</a>
<li>About</ul></nav><div class="cookie-banner">We use cookies</div><div id=main><h1>Title {n} &amp; more</h1><p>First   {n}<b>bold</b> text<br>
line<p>Second {n} paragraph with much more of the varying text in it</div><div class="promo-box">Special offer</div><div id="comments"><p>Nice {n}!</p></div>
<p>All rights reserved</p><footer>(c)</footer></body></html>"""


def test_pages(spark):
    rows = [(i, "http://a.org/x", PAGE.format(n=i)) for i in range(12)] + [
        (20, "http://b.org/", None), (21, None, ""), (22, "http://c.org/", "<p>Only &lt;this&gt;"), (23, "http://d.org/", "<b>" * 3000 + "deep"),
        (24, "http://e.org/", "<html><body><article><h1>A</h1><p>Same</p><aside>no</aside></article></body></html>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    found = {r["page_id"]: r for r in wrapper.extracted(pages).collect()}
    assert found[3]["text"] == "Title 3 & more\n\nFirst 3bold text line\n\nSecond 3 paragraph with much more of the varying text in it"
    assert [found[i]["text"] for i in (20, 21, 22, 23, 24)] == ["", "", "Only <this>", "deep", "A\n\nSame"]
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())
    assert wrapper.extracted(pages.limit(0)).count() == 0


def tree(page: str) -> wrapper.Node:
    return wrapper.shaped(wrapper.parse(page))


def plain_matching(a, b) -> int:
    """Simple tree matching as it is defined."""
    if a.key != b.key:
        return 0
    table = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + plain_matching(x, y))
    return 1 + table[-1][-1]


def test_tree_matching(monkeypatch):
    pairs = wrapper.alignment(tree("<ul><li>x</li><li>y</li></ul>"), tree("<ul><li>x</li><li>q</li><li>y</li></ul>"))
    assert len(pairs) == 6  # root, list, two items and their texts
    assert [x.text for x, y in pairs if x.tag == "#text" and x.text == y.text] == ["x", "y"]
    r = random.Random(4)

    def grown(depth: int) -> str:
        parts = [r.choice(["a", "b", "<br>", *[f"<{t}>{grown(depth - 1)}</{t}>" for t in ("div", "b", "p") if depth]]) for _ in range(r.randint(0, 5))]
        return "".join(parts)

    for cells in (1 << 20, 4):  # the second one halves all tables
        monkeypatch.setattr(wrapper, "CELLS", cells)
        for _ in range(60):
            a, b = tree(grown(4)), tree(grown(4))
            pairs = wrapper.alignment(a, b)
            assert len(pairs) == wrapper.similarity(a, b) == plain_matching(a, b)
            assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
            assert all(x.key == y.key for x, y in pairs)


def test_hostile_html():
    """Quotes and tags that are never closed are read in linear time."""
    began = time.monotonic()
    for part in ('<a href="x ', "<a 'x\" ", "<a ", "< ", "<b", "<!", '<a b="c>', "<script>", "</p ", "&lt;<"):
        wrapper.parse(part * 40_000)
        wrapper.parse(part * 40_000 + ">")
    assert time.monotonic() - began < 40
    assert wrapper.extract("a < b <p>c d<e", None) == "a < b\n\nc d<e"


def test_spam_words_random():
    r = random.Random(0)
    model = url_filter.UrlModel({})
    names = ["".join(r.choice(["th", "er", "on", "ti", "wh"]) for _ in range(4)) for _ in range(50)]
    assert all(model.log_odds(f"{n}.org", "/en/1") < 0 for n in names)


def test_words_of_the_table_are_learned(spark, monkeypatch):
    """Words outside the seeds: found by separators elsewhere, judged by urls that rules decide."""
    rules = [url_filter.Rule("block", "bad.test", ""), url_filter.Rule("allow", "good.test", "")]
    urls = [f"http://h{a}.bad.test/zorgel-kwimba/{a}" for a in "abcdefgh"] + [f"http://h{a}.good.test/milune-farto/{a}" for a in "abcdefgh"]
    urls += ["http://zorgelkwimba.org/", "http://milunefarto.org/", None, ""]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    model = url_filter.fit(pages, rules=rules)
    results = []
    for limit in (1 << 20, -1):
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", limit)
        found = {r["page_id"]: r for r in url_filter.judge(pages, rules, model).collect()}
        assert (found[16]["words"], found[16]["verdict"]) == ("zorgel kwimba org", "block")
        assert (found[17]["words"], found[17]["verdict"]) == ("milune farto org", "allow")
        assert found[18]["words"] == found[19]["words"] == "" and len(found) == len(urls)
        results.append(sorted((i, r["words"], round(r["log_odds"], 9)) for i, r in found.items()))
    assert results[0] == results[1]


def test_odd_urls(spark, monkeypatch):
    """Very long names and paths, repeated rows, an empty table; with and without the broadcast."""
    urls = ["http://" + "casinobonus" * 5_000 + ".org/", "http://a.org/" + "x/" * 20_000, "http://a.org/" + "y" * 100_000] + ["http://free-bets.org/"] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for limit in (1 << 20, -1):
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", limit)
        found = url_filter.judge(pages, [], url_filter.fit(pages, rules=[])).orderBy("page_id").collect()
        assert [r["verdict"] for r in found] == ["block", "allow", "allow", "block", "block"]
        assert found[0]["words"] == "casino bonus " * 5_000 + "org" and found[2]["words"] == "a org " + "y" * 100_000
    assert url_filter.judge(pages.limit(0), [], url_filter.fit(pages.limit(0), rules=[])).isEmpty()


def texts_by_id(spark, pages: list[str | None]) -> list[str]:
    rows = spark.createDataFrame([(i, "http://a.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in wrapper.extracted(rows).orderBy("page_id").collect()]


def test_constants_come_from_all_distinct_pages(spark):
    whole = "<html><body><div id=a><p>{}</p><p>Buy our things</p></div></body></html>"
    assert texts_by_id(spark, [whole.format("copy")] * 6) == ["copy\n\nBuy our things"] * 6
    # one empty and one differently built page, and a block that some pages share
    texts = [f"text {i} of its own" for i in range(20)]
    pages = [whole.format(f"{t}</p><p>{'shared by five' if i < 5 else t + ' too'}") for i, t in enumerate(texts)]
    found = texts_by_id(spark, [*pages, "", "<b>odd"])
    assert found == [f"{t}\n\n{'shared by five' if i < 5 else t + ' too'}" for i, t in enumerate(texts)] + ["", "odd"]
    # a second template on the host has constants of its own
    other = "<html><body><section><div class=x><p>{}</p><p>Second slogan</p></div></section></body></html>"
    assert texts_by_id(spark, pages + [other.format(t) for t in texts[:6]])[20:] == texts[:6]


def test_texts_decide_over_names(spark):
    texts = [f"text {i} that only this page has, and more of it" for i in range(8)]
    inside = "<html><body><article><p>{}</p><p>Subscribe to us</p></article></body></html>"
    assert texts_by_id(spark, [inside.format(t) for t in texts]) == texts
    named = (
        "<html><body><div class='content no-sidebar'><div class='post-header'><h1>Title {0}</h1></div><p>{1}</p>"
        "<div class='legal'><p>Terms {0}</p></div><div id=comments><p>Nice {0}</p></div></div>"
        "<div class=more><p>A little {0}</p></div></body></html>"
    )
    found = texts_by_id(spark, [named.format(i, t) for i, t in enumerate(texts)])
    assert found == [f"Title {i}\n\n{t}\n\nA little {i}" for i, t in enumerate(texts)]
    plain = "<html><body><div class='content no-sidebar'><p>{0}</p></div><div class=ad><p>Buy {1}</p></div></body></html>"
    assert texts_by_id(spark, [plain.format(t, i) for i, t in enumerate(texts)]) == texts
    short = "<html><body><div class=ad><p>{0}</p></div><article><h1>T {1}</h1></article></body></html>"
    assert texts_by_id(spark, [short.format(t, i) for i, t in enumerate(texts)]) == [f"T {i}" for i in range(8)]


def test_wide_and_deep_pages():
    items = [f"<li>{i}</li>" for i in range(300)]
    a, b = tree(f"<ul>{''.join(items)}</ul>"), tree(f"<ul><li>x</li>{''.join(items)}</ul>")
    assert sum(x.text == y.text for x, y in wrapper.alignment(a, b) if x.tag == "#text") == 300
    a, b = tree("<div>" * 20_000 + "x"), tree("<div>" * 19_000 + "<p>x")
    assert len(wrapper.alignment(a, b)) == 19_001
    deep = "<div>" * 400 + "<nav>Menu</nav>" + "<div><p>in</p></div>" + "</div>" * 400
    page = f"<html><body><article><p>before</p>{deep}<p>after</p></article><p>outside</p></body></html>"
    assert wrapper.extract(page, None) == "before\n\nin\n\nafter"
    assert wrapper.extract("<b>" * 50_000 + "x" + "</i>" * 50_000, None) == "x"


@pytest.mark.parametrize(("page", "text"), [
    ("<body><p>a <svg class='i'/> b</p><p>second block</p></body>", "a\n\nb\n\nsecond block"),
    ("<p>x</p><iframe src=y /><p>after</p>", "x\n\nafter"),
    ("<script src=a /><p>one</p><script>var x='<p>';</script><p>two</p>", "one\n\ntwo"),
    ("<body><form id='aspnetForm'><div><p>The whole page is in here.</p><input value=q></div></form></body>", "The whole page is in here."),
    ("<body><nav><ul><li><a>Home</a></li></ul><article><h1>T</h1><p>text of it</p></article></body>", "T\n\ntext of it"),
    ("<body><nav><a>Home</a> <a>B</a><div><p>text that is long</p></div><p>more</p></body>", "text that is long\n\nmore"),
    ("<article><header><h1>Head</h1><p>Lead text</p></header><p>Body</p></article>", "Head\n\nLead text\n\nBody"),
    ("<header><h1>Site</h1></header><main><p>x y z</p></main>", "x y z"),
    ("<html><head><title>Never closed<body><h1>H</h1><p>text</p></body></html>", "H\n\ntext"),
    ("<form><input><label>Search</label><p>go</p></form><p>This is the main text of the page</p>", "This is the main text of the page"),
    ("<head><meta a><p>in body</p>", "in body"),
    ("<nav><a>Home</a></nav><p>kept</p><nav>x</nav>", "kept"),
])
def test_no_article_is_lost(page, text):
    """Self-closed and unclosed elements, and menus, forms and headers around the text."""
    assert wrapper.extract(page, None) == text


def test_unclosed_elements_take_linear_time():
    for part in ("<svg>", "<iframe/>", "<title>", "<nav>", "<script/>", "<form><p>", "<nav><div>", "<article><header><h1>"):
        began = time.perf_counter()
        wrapper.extract(part * 20_000 + "end", None)
        assert time.perf_counter() - began < 20, part


@pytest.mark.parametrize("broadcast", [0, 1 << 25])
def test_urls_outside_of_the_fit(spark, monkeypatch, broadcast):
    """Names that no fitted url holds are split by the words of the fit, alike with and without a broadcast."""
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", broadcast)
    fitted = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(["green-garden.org", "green.net", "garden.info", "tea-garden.org", "green-tea.org"])], "page_id long, url string")
    others = spark.createDataFrame([(1, "http://greengarden.biz/zzqq"), (2, "http://green.net/x"), (3, None), (4, "http://zzz/")], "page_id long, url string")
    found = {r["page_id"]: r for r in url_filter.judge(others, [], url_filter.fit(fitted)).collect()}
    assert len(found) == 4 and found[1]["words"].split()[:2] == ["green", "garden"]
    assert found[4]["words"] == "zzz" and found[3]["words"] == ""
    same = {r["page_id"]: (r["words"], r["log_odds"]) for r in url_filter.judge(fitted.select("*"), [], url_filter.fit(fitted)).collect()}
    model = url_filter.fit(fitted)
    assert same == {r["page_id"]: (r["words"], r["log_odds"]) for r in url_filter.judge(fitted, [], model).collect()}


def test_start_tags_are_told_once():
    wrapper._told.cache_clear()
    page = '<div class="a b" id="x">' * 40 + "<p>text</p>" + "</div>" * 40 + f'<p data-x="{"y" * 300}" class="nav">long</p>'
    first, again = wrapper.parse(page), wrapper.parse(page)
    found = wrapper._told.cache_info()
    assert (found.misses, found.currsize) == (2, 2)  # the div and the short p, on both pages; long attributes are not kept
    assert wrapper.shaped(first).content == wrapper.shaped(again).content and first.children[-1].named == "chrome"
