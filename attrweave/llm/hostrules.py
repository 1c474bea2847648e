"""Host-level quality rules.

Each document is held against a few rules. By host, the failures of each rule are counted over all its documents and
their rates shrunk towards the corpus: a rule's failures on a host are taken as beta-binomial draws, whose mean and
correlation inside a host follow from the hosts' counts by weighted moments, hosts weighing by their documents and the
noise of counting taken off; a host's rate is then the mean of its posterior. Hosts of few documents so stay near the corpus,
hosts of many keep their own rate, and where hosts don't differ by more than chance all have the corpus rate. A host is bad if
the shrunk rate of any rule is above `worst`. The verdicts go back to the documents: one that fails `hopeless` rules is
dropped, as is one that fails any on a bad host; a document that fails none is kept, whatever its host.

Everything is built-in expressions; only the failure bits of a document are exchanged, never its text: hosts are
aggregated partially first, and their few figures come back to the documents by a join that Spark broadcasts if their
size allows.

Edge cases: a null host is a host of its own; a null or empty text, and one of white space alone, fails the rule of too few
words and none of the ratios; repeated rows count each; where correlation can't be told, as with a single host or one document
on each, the prior is the corpus rate with the weight of `strength` documents; an empty table gives an empty table; only the
named columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrweave.llm.common import text_of, written

#: Rules, each a part of the characters, lines or words that is too much (or, in words, too little).
LEAST_WORDS, MOST_SIGNS, MOST_UPPER, MOST_DIGITS, MOST_REPEATED, MOST_BULLETS, MOST_ELLIPSES = 3, 0.15, 0.5, 0.3, 0.6, 0.9, 0.3
SIGNS = "#*%&$|{}<>=~^_"
DIGITS = "0123456789"
RULES = ("words", "signs", "upper", "digits", "repeated", "bullets", "ellipses")
WORST, HOPELESS, STRENGTH = 0.25, 2, 10.0
#: White space between words, as the inside of a class of characters, and lines that count as bullets or cut off.
SPACE = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BULLET, ELLIPSIS = r"^\s*[-*\x{2022}\x{25CF}]\s", r"(\.\.\.|\x{2026})\s*$"
_LEAST_SHARE, _MOST_SHARE = 1e-6, 1 - 1e-6


def _share(text: Column, letters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, letters, ""))) / F.greatest(F.length(text), F.lit(1))


def domain(url: Column) -> Column:
    """The host of a url in lower case, without user, port and a leading www.; null where there is none."""
    found = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", F.regexp_replace(F.lower(found), r"^www\.", ""))


def failures(text: Column) -> dict[str, Column]:
    """Whether a text, not null, fails each rule."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x != "")
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    # Possessive: a long word is read once.
    enough = rf"^[{SPACE}]*+" + rf"[^{SPACE}]++[{SPACE}]++" * (LEAST_WORDS - 1) + rf"[^{SPACE}]"
    return {
        "words": ~F.rlike(text, F.lit(enough)),
        "signs": _share(text, SIGNS) > MOST_SIGNS,
        "upper": upper / F.greatest(F.length(text), F.lit(1)) > MOST_UPPER,
        "digits": _share(text, DIGITS) > MOST_DIGITS,
        "repeated": (F.size(lines) > 2) & (F.size(F.array_distinct(lines)) < (1 - MOST_REPEATED) * F.size(lines)),
        "bullets": (F.size(lines) > 2) & (F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(BULLET)))) > MOST_BULLETS * F.size(lines)),
        "ellipses": (F.size(lines) > 2) & (F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(ELLIPSIS)))) > MOST_ELLIPSES * F.size(lines)),
    }


def host_rates(judged: DataFrame, strength: float = STRENGTH, worst: float = WORST) -> DataFrame:
    """Columns host, n, rate_<rule>, bad of rows with columns host and fail_<rule> (0 or 1)."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(f"fail_{r}").alias(f"k_{r}") for r in RULES])
    k = {r: F.col(f"k_{r}") for r in RULES}
    prior = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("n").alias("all_n"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
        *[x for r in RULES for x in (F.sum(k[r]).alias(f"all_k_{r}"), F.sum(k[r].cast("double") * k[r] / F.col("n")).alias(f"own_{r}"))],
    )
    rows = hosts.crossJoin(F.broadcast(prior))  # one row
    n, free, spread = F.col("all_n").cast("double"), F.col("hosts") - 1, F.col("all_n") - F.col("squares") / F.col("all_n")
    rates = {}
    for r in RULES:
        m = F.col(f"all_k_{r}") / n
        # Of the sum of n * (rate - m) ** 2 over hosts, chance alone makes m * (1 - m) * (hosts - 1).
        chance, seen = m * (1 - m), F.col(f"own_{r}") - n * m * m
        told = (spread - free > 1e-9) & (chance > 0)
        share = F.least(F.greatest((seen - chance * free) / (chance * (spread - free)), F.lit(_LEAST_SHARE)), F.lit(_MOST_SHARE))
        weight = F.when(told, 1 / share - 1).otherwise(F.lit(strength))
        rates[r] = F.round((k[r] + weight * m) / (F.col("n") + weight), 6)
    return rows.select("host", "n", *[v.alias(f"rate_{r}") for r, v in rates.items()], F.greatest(*[v for v in rates.values()], F.lit(0.0)).alias("worst_rate")).withColumn("bad", F.col("worst_rate") > worst)


def judge(docs: DataFrame, key: str = "doc_id", host: str | Column = "source", text: str = "text", worst: float = WORST, hopeless: int = HOPELESS, strength: float = STRENGTH) -> DataFrame:
    """Columns key, host, failed (names of rules, joined by commas), host_rate, host_bad, keep: a row for each document.

    host: a column, or an expression such as domain() of one with urls.
    """
    named = F.col(host) if isinstance(host, str) else host
    plain = text_of(docs, text)
    whose = F.when(named.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), named.cast("string")))
    judged = docs.select(F.col(key), whose.alias("host"), *[v.cast("int").alias(f"fail_{r}") for r, v in failures(plain).items()])
    judged = written(judged, "host-rules")  # the texts are read once, not for each of the figures
    rates = host_rates(judged, strength, worst).select("host", "worst_rate", "bad")
    joined = judged.join(rates, "host")
    count = sum(F.col(f"fail_{r}") for r in RULES)
    names = F.concat_ws(",", *[F.when(F.col(f"fail_{r}") == 1, F.lit(r)) for r in RULES])
    keep = (count == 0) | ((count < hopeless) & ~F.col("bad"))
    shown = F.when(F.col("host") != "0", F.expr("substring(host, 2)"))
    return joined.select(F.col(key), shown.alias("host"), names.alias("failed"), F.col("worst_rate").alias("host_rate"), F.col("bad").alias("host_bad"), keep.alias("keep"))


def _sql() -> str:
    share = lambda letters: f"(length(t) - length(translate(t, '{letters}', ''))) / greatest(length(t), 1)"
    space = SPACE.replace("\\x0B", "\\x{0B}")
    tests = {
        "words": f"len(list_filter(regexp_split_to_array(t, '[{space}]+'), lambda x: x <> '')) < {LEAST_WORDS}",
        "signs": f"{share(SIGNS)} > {MOST_SIGNS}",
        "upper": f"(length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g'))) / greatest(length(t), 1) > {MOST_UPPER}",
        "digits": f"{share(DIGITS)} > {MOST_DIGITS}",
        "repeated": f"len(l) > 2 AND len(list_distinct(l)) < {1 - MOST_REPEATED} * len(l)",
        "bullets": f"len(l) > 2 AND len(list_filter(l, lambda x: regexp_matches(x, '{BULLET}'))) > {MOST_BULLETS} * len(l)",
        "ellipses": f"len(l) > 2 AND len(list_filter(l, lambda x: regexp_matches(x, '{ELLIPSIS}'))) > {MOST_ELLIPSES} * len(l)",
    }
    fails = ", ".join(f"CAST({x} AS INT) AS fail_{r}" for r, x in tests.items())
    sums = ", ".join(f"sum(fail_{r}) AS k_{r}" for r in RULES)
    # The spread between hosts is summed host by host here, and the share that hosts explain is 1 - what they don't.
    means = ", ".join(f"sum(k_{r}) / sum(n) AS m_{r}" for r in RULES)
    spreads = ", ".join(f"sum(n * (k_{r} / n - m_{r}) ** 2) AS s_{r}, any_value(m_{r}) AS m_{r}" for r in RULES)
    weight = {r: f"(CASE WHEN b - (hosts - 1) > 1e-9 AND m_{r} > 0 AND m_{r} < 1 THEN 1 / least(greatest((s_{r} / (m_{r} * (1 - m_{r})) - (hosts - 1)) / (b - (hosts - 1)), {_LEAST_SHARE}), {_MOST_SHARE}) - 1 ELSE {STRENGTH} END)" for r in RULES}
    rate = ", ".join(f"round((k_{r} + {weight[r]} * m_{r}) / (n + {weight[r]}), 6)" for r in RULES)
    named = ", ".join(f"CASE WHEN fail_{r} = 1 THEN '{r}' END" for r in RULES)
    count = " + ".join(f"fail_{r}" for r in RULES)
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS l FROM documents
), j AS (SELECT doc_id, source, {fails} FROM d),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, {sums} FROM j GROUP BY source),
m AS (SELECT {means} FROM h),
p AS (SELECT count(*) AS hosts, sum(n * (1 - n / (SELECT sum(n) FROM h))) AS b, {spreads} FROM h CROSS JOIN m),
r AS (SELECT source, greatest({rate}, 0.0) AS host_rate FROM h CROSS JOIN p)
SELECT doc_id, j.source AS host, concat_ws(',', {named}) AS failed, host_rate, host_rate > {WORST} AS host_bad,
       ({count} = 0) OR ({count} < {HOPELESS} AND NOT host_rate > {WORST}) AS keep
FROM j JOIN r ON j.source IS NOT DISTINCT FROM r.source
"""


SQL = _sql()
