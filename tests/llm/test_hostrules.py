import re
import unicodedata

from attrweave.llm import hostrules
from tests.llm.cases import docs, hard


def failed(text):
    n = max(len(text), 1)
    lines = [x for x in text.split("\n") if x]
    share = lambda letters: sum(c in letters for c in text) / n
    out = {
        "words": len(text.split()) < hostrules.LEAST_WORDS,
        "signs": share(hostrules.SIGNS) > hostrules.MOST_SIGNS,
        "upper": sum(unicodedata.category(c) == "Lu" for c in text) / n > hostrules.MOST_UPPER,
        "digits": share(hostrules.DIGITS) > hostrules.MOST_DIGITS,
        "repeated": len(lines) > 2 and len(set(lines)) < (1 - hostrules.MOST_REPEATED) * len(lines),
        "bullets": len(lines) > 2 and sum(bool(re.match(r"\s*[-*•●]\s", x)) for x in lines) > hostrules.MOST_BULLETS * len(lines),
        "ellipses": len(lines) > 2 and sum(x.rstrip().endswith(("...", "…")) for x in lines) > hostrules.MOST_ELLIPSES * len(lines),
    }
    return [r for r in hostrules.RULES if out[r]]


def brute(rows):
    hosts = {}
    for _, text, _, host in rows:
        h = hosts.setdefault(host, [0, {r: 0 for r in hostrules.RULES}])
        h[0] += 1
        for r in failed(text or ""):
            h[1][r] += 1
    worst = {h: 0.0 for h in hosts}
    for r in hostrules.RULES:
        total = sum(n for n, _ in hosts.values())
        centre = sum(k[r] for _, k in hosts.values()) / total
        seen = sum(n * (k[r] / n - centre) ** 2 for n, k in hosts.values())
        b, free = sum(n * (1 - n / total) for n, _ in hosts.values()), len(hosts) - 1
        weight = hostrules.STRENGTH
        if b - free > 1e-9 and 0 < centre < 1:
            weight = 1 / min(max((seen - centre * (1 - centre) * free) / (centre * (1 - centre) * (b - free)), 1e-6), 1 - 1e-6) - 1
        for h, (n, k) in hosts.items():
            worst[h] = max(worst[h], (k[r] + weight * centre) / (n + weight))
    out = []
    for doc, text, _, host in rows:
        f, bad = failed(text or ""), worst[host] > hostrules.WORST
        out.append((doc, host, ",".join(f), round(worst[host], 4), bad, not f or (len(f) < hostrules.HOPELESS and not bad)))
    return sorted(out, key=repr)


def found(table):
    return sorted(((r.doc_id, r.host, r.failed, round(r.host_rate, 4), r.host_bad, r.keep) for r in hostrules.judge(table).collect()), key=repr)


def corpus():
    texts = ["plain words of a text", "ALL LOUD WORDS HERE", "1234 5678 9012 34", "## ** ## %% &&", "x", "a\na\na\na\na b", "- a b\n* c d\n\u2022 e f", "one two...\nthree four\u2026\nfive six", "\u00c4\u00d6\u00dc \u0416\u0417\u0418 ABC"]
    return [(k, texts[0] if k % 5 else texts[k // 5 % 9], "en", f"h{k % 4}") for k in range(200)] + [(900 + k, texts[1 + k % 2], "en", "bad") for k in range(40)] + [(990, texts[1], "en", "small"), (991, texts[0], "en", "bad")]


def test_against_brute_force(spark):
    rows = corpus()
    assert found(docs(spark, rows)) == brute(rows)


def test_clean_documents_stay_on_bad_hosts(spark):
    by = {r[0]: r for r in found(docs(spark, corpus()))}
    assert by[991][4] and by[991][5] and not by[900][5]


def test_white_space_alone_is_no_word(spark):
    rows = [(1, " " * 10, "en", "h"), (2, "one\ttwo\tthree\tfour\tfive", "en", "h"), (3, "x" * 2_000_000, "en", "h"), (4, "a\u00a0b c", "en", "h")]
    assert {r[0]: r[2] for r in found(docs(spark, rows))} == {1: "words", 2: "", 3: "words", 4: ""}
    assert found(docs(spark, rows)) == brute(rows)


def test_the_prior_takes_off_the_noise_of_counting(spark):
    """All hosts fail at the same rate: a single failing document doesn't condemn a host of one document."""
    rows = [(k, "x" if k * 7919 % 10_007 % 20 == 0 else "plain words of a text", "en", f"small{k}" if k < 900 else f"large{k % 60}") for k in range(9_900)]
    rates = {r.host: r.host_rate for r in hostrules.judge(docs(spark, rows)).select("host", "host_rate").distinct().collect()}
    assert max(rates.values()) < 0.1
    # Where hosts do differ, a large one keeps its own rate and a small one moves towards it.
    rows = [(k, "x" if k % 60 < 20 else "plain words of a text", "en", f"large{k % 60}") for k in range(6_000)] + [(9_000, "x", "en", "small")]
    rates = {r.host: r.host_rate for r in hostrules.judge(docs(spark, rows)).select("host", "host_rate").distinct().collect()}
    assert rates["large0"] > 0.99 and rates["large59"] < 0.01 and 0.3 < rates["small"]


def test_the_host_of_a_url(spark):
    urls = {"http://www.A.example:80/x": "a.example", "https://u:p@b.example?q": "b.example", "//c.example#f": "c.example", "no url": None, None: None, "ftp://www.d.example": "d.example"}
    table = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, u string")
    assert {r.u: r.d for r in table.select("u", hostrules.domain(table.u).alias("d")).collect()} == urls


def test_edge_cases(spark):
    rows = hard("word " * 20_000)
    assert found(docs(spark, rows, extra=False)) == brute(rows)
    assert hostrules.judge(docs(spark, rows).selectExpr("*", "1 AS n", "2 AS bad", "3 AS failed")).count() == 9
    assert hostrules.judge(docs(spark, [])).count() == 0
    one = [(1, "plain words of it", "en", "h")]
    assert found(docs(spark, one)) == brute(one)
