import hashlib
import math
from collections import Counter, defaultdict

from attrweave.llm import mixing
from tests.llm.cases import docs, hard


def brute(rows, weights=None, total=None, seed=mixing.SEED):
    """Copies of each row, by its place."""
    by = defaultdict(list)
    for k, (_, text, _, source) in enumerate(rows):
        by[source].append((k, len(bin(len(text or ""))) - 2))
    weights = {s: 1.0 for s in by} if weights is None else {s: w for s, w in weights.items() if s in by and w > 0}
    total = len(rows) if total is None else total
    out = Counter()
    shares = {s: w / sum(weights.values()) * total for s, w in weights.items()}
    sizes = {s: math.floor(x) for s, x in shares.items()}
    for s in sorted(shares, key=lambda s: (-(shares[s] - sizes[s]), s is not None, s or ""))[: total - sum(sizes.values())]:
        sizes[s] += 1
    for s in weights:
        share, sum_x, odds, left = shares[s], sum(x for _, x in by[s]), [], sizes[s]
        for k, x in by[s]:
            lam = share * x / sum_x
            out[k] += math.floor(lam)
            left -= math.floor(lam)
            if p := lam - math.floor(lam):
                doc, text = rows[k][0], rows[k][1] or ""
                h = hashlib.md5(f"{seed}|{'' if doc is None else doc}|{len(text)}".encode()).hexdigest()
                u = (int(h[:13], 16) + 0.5) / 2**52
                odds.append(((u / (1 - u)) / (p / (1 - p)), doc is not None, doc or 0, len(text), text, k))
        for *_, k in sorted(odds)[:left]:
            out[k] += 1
    return out


def counted(table, **options):
    return Counter((r.doc_id, r.text, r.source) for r in mixing.mix(table, **options).collect())


def check(spark, rows, **options):
    want = Counter()
    for k, n in brute(rows, **options).items():
        want[rows[k][0], rows[k][1], rows[k][3]] += n
    assert counted(docs(spark, rows), **options) == +want


def test_against_brute_force(spark):
    rows = [(k, "x" * (k * 37 % 900), "en", f"s{k % 7 // 3}") for k in range(400)]
    check(spark, rows)
    check(spark, rows, total=1234)
    check(spark, rows, total=60, weights={"s0": 3.0, "s2": 1.0, "none": 5.0, "s1": 0.0})


def test_ties_and_repeated_rows(spark):
    rows = [(1, "same", "en", "s")] * 9 + [(1, "sane", "en", "s")] * 3 + [(2, "other", "en", "t")] * 2
    check(spark, rows, total=7)


def test_sizes_are_fixed(spark):
    rows = [(k, "word " * (k % 50), "en", "a" if k < 300 else "b") for k in range(400)]
    for seed in range(3):
        n = Counter()
        for (_, _, s), c in counted(docs(spark, rows), seed=seed).items():
            n[s] += c
        assert n == {"a": 200, "b": 200}


def test_the_total_is_exact(spark, monkeypatch):
    rows = [(k, "x" * (k * 37 % 900), "en", f"s{k % 7}" if k % 7 else None) for k in range(100)]
    for total in (10, 25, 100, 333):
        check(spark, rows, total=total)
        assert sum(counted(docs(spark, rows), total=total).values()) == total
    monkeypatch.setattr(mixing, "MOST_LITERAL", 3)  # more sources than are ranked in one task
    check(spark, rows, total=25)


def test_a_column_named_copy_stays(spark):
    table = docs(spark, [(k, "text", "en", "s") for k in range(3)]).selectExpr("*", "'mine' AS copy", "'too' AS COPY_")
    out = mixing.mix(table, total=6)
    assert out.columns == [*table.columns, "copy__"] and {(r["copy"], r["copy__"]) for r in out.collect()} == {("mine", 1), ("mine", 2)}


def test_copies_are_numbered(spark):
    rows = [(k, "text", "en", "s") for k in range(3)]
    found = sorted((r.doc_id, r["copy"]) for r in mixing.mix(docs(spark, rows), total=6).collect())
    assert found == [(k, c) for k in range(3) for c in (1, 2)]


def test_edge_cases(spark):
    rows = hard("word " * 20_000)
    check(spark, rows)
    table = docs(spark, rows, extra=True)
    out = mixing.mix(table)
    assert out.columns == [*table.columns, "copy_"] and out.count() == 9
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, rows), weights={"nowhere": 1.0}).count() == 0
