import random
import time

import numpy as np

from attrweave.llm import html


def page(rng, spread=True):
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    body = [text(rng.randint(20, 80)) + "." for _ in range(rng.randint(2, 6))]
    menu = "".join(f'<li><a href="/{k}">{text(1)}</a>' for k in range(8))
    main = "".join(f"<p>{b}" for b in body)
    inner = f'<div class="wrap">{main}</div>' if spread else main
    return f'<!DOCTYPE html><html><head><title>{text(3)}</title><script>var x="<p>no</p>";</script></head><body><div class="menu"><ul>{menu}</ul></div><!-- <p>no</p> --><main>{inner}</main><div class="footer">&copy; {text(4)}</div></body>', "\n".join(body)


def test_held_out_texts():
    rng = random.Random(1)
    rows = [page(rng, k % 2 == 0) for k in range(120)]
    trees = html.fit(rows[:60])
    f = []
    for source, truth in rows[60:]:
        a, b = set(html.extract_page(source, trees)[0].split()), set(truth.split())
        f.append(2 * len(a & b) / max(len(a) + len(b), 1))
    assert np.mean(f) > 0.95


def test_held_out_pages_of_the_tables(spark):
    import re

    base = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect()}
    rows = [(r.html, docs[int(m[1])]) for r in spark.read.parquet(f"{base}/pages.parquet").collect() if (m := re.search(r"/(\d+)", r.url)) and int(m[1]) in docs]
    trees = html.fit(rows[:100])
    f = []
    for source, truth in rows[100:]:
        a, b = set(html.extract_page(source, trees)[0].split()), set(truth.split())
        f.append(2 * len(a & b) / max(len(a) + len(b), 1))
    assert np.mean(f) > 0.95


def test_choices_never_contradict():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(2, 40))
        dom = html.Dom([-1] + [int(rng.integers(0, k)) for k in range(1, n)], ["div"] * n, [""] * n, [])
        size, score = rng.integers(0, 50, n).astype(float), rng.standard_normal(n)
        taken = html.decode(dom, score, size)
        for k in taken:
            up = dom.parent[k]
            while up >= 0:
                assert up not in taken
                up = dom.parent[up]
        value = score * np.log1p(size)

        def best(k):
            below = sum(best(c) for c in range(n) if dom.parent[c] == k)
            return max(0.0, value[k], below)

        assert abs(sum(value[k] for k in taken) - best(0)) < 1e-9


def test_trees_are_what_brute_force_gives():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = html.boost(x, y, np.ones(500))
    assert ((trees.score(x) > 0) == y).mean() > 0.95
    for row in x[:20]:
        total = trees.base
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            at = 0
            while at < len(cut):
                at = 2 * at + (2 if row[feature[at]] > cut[at] else 1)
            total += leaf[at - len(cut)]
        assert abs(total - trees.score(row[None])[0]) < 1e-9


def test_tag_soup():
    dom = html.parse("text<p>one<p>two<b>bold<div>three</p></i></div><br/>four<script>no</script><li>a<li>b<!-- open")
    assert [t for _, t in dom.pieces] == ["text", "one", "two", "bold", "three", "four", "a", "b"]
    assert [dom.tag[n] for n, _ in dom.pieces] == ["#root", "p", "p", "b", "div", "#root", "li", "li"]


def test_malformed_pages_take_time_in_proportion():
    n = 10_000_000
    rows = ["<a" * (n // 2), "<!" * (n // 2), "<" + "a" * n, "<a " * (n // 3) + ">", "<a '" * (n // 4) + ">", '<a ">" ' * (n // 7) + '"', "<p>" + "<a x='\">" * (n // 9), "<script" * (n // 7), "<style>" * (n // 7), "<!--" * (n // 4), "</b" * (n // 3), "&#" + "9" * n, "<div " + " class" * (n // 6) + ">"]
    rows += ["<div>" * 100_000 + "</b>" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<b>" * 100_000 + "<p>x" * 100_000, "<b><i>" * 50_000 + "</b>" * 50_000, "<p><b>" * 50_000 + "x</b> y" * 50_000]
    for page in rows:
        start = time.thread_time()
        dom = html.parse(page)
        assert time.thread_time() - start < 20, page[:20]
        html.text_below(dom, [0])
        html.features(dom)
        assert time.thread_time() - start < 40, page[:20]


def test_tokens_against_the_plain_rule():
    """On random short soup: what is found by passes is what a search that tries every end finds."""
    rng = random.Random(9)

    def closes(page, at):
        while at < len(page):
            if page[at] == ">":
                return at + 1
            if page[at] in "\"'":
                at = page.find(page[at], at + 1)
                if at < 0:
                    return None
            at += 1
        return None

    def slow(page):
        out, at = [], 0
        while at < len(page):
            if page[at] == "<" and at + 1 < len(page) and page[at + 1].isalpha():
                k = at + 2
                while k < len(page) and page[k] not in " /<>\"'":
                    k += 1
                if (end := closes(page, k)) is not None:
                    out.append((at, end))
                    at = end
                    continue
            at += 1
        return out

    for _ in range(3_000):
        page = "".join(rng.choice("<<>\"'ab /") for _ in range(rng.randint(1, 25)))
        if "</" not in page:
            assert [(a, z) for a, z, _ in html._tokens(page)] == slow(page), page


def test_copies_of_a_page_are_fitted_on_once(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [page(rng) for _ in range(30)]
    pages = spark.createDataFrame([(k, rows[0 if k < 400 else k - 399][0]) for k in range(429)], "page_id long, html string")
    texts = spark.createDataFrame([(k, rows[0 if k < 400 else k - 399][1]) for k in range(429)], "doc_id long, text string")
    trees = html.train(pages, texts, F.col("page_id"), most=30)
    alone = html.fit([rows[k] for k in range(30)])
    assert (np.sort(trees.leaf.ravel()).round(6) == np.sort(alone.leaf.ravel()).round(6)).all()


def test_edge_cases(spark):
    rng = random.Random(4)
    rows = [page(rng) for _ in range(40)]
    trees = html.fit(rows)
    deep = "<div>" * 30_000 + rows[0][0]
    table = spark.createDataFrame([(1, None), (2, ""), (3, "<p></p>"), (4, deep), (1, rows[1][0]), (None, rows[2][0])], "page_id long, html string").selectExpr("*", "1 AS text", "2 AS nodes")
    found = html.extract(table, trees).collect()
    assert len(found) == 6 and [r.text for r in found if r.page_id in (2, 3)] == ["", ""]
    assert sum(bool(r.text) for r in found) >= 2
    assert {r.text for r in html.extract(table, None).collect()} == {""}
    assert html.extract(spark.createDataFrame([], "page_id long, html string"), trees).count() == 0
    from pyspark.sql import functions as F

    assert html.train(spark.createDataFrame([], "page_id long, html string"), spark.createDataFrame([], "doc_id long, text string"), F.col("page_id")) is None


def test_white_space_between_inline_elements():
    def text(page):
        return html.text_below(html.parse(page), [0])

    assert text("<p><b>one</b> <i>two</i>\n<a>three</a>four</p> <p>five</p>") == "one two threefour\nfive"
    dom = html.parse("<p><b>one</b> <i>two</i></p>")
    assert html.text_below(dom, [dom.tag.index("b"), dom.tag.index("i")]) == "one two"
