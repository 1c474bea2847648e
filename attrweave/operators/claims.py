"""Claims: one row (site, category, url, name, value) for each attribute of each page, and what is counted over them.

An attribute is (site, category, name). linkage has rows (pid, site, category, url).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrweave.functions import text as T
from attrweave.operators.shared import cut, width

SA = ["site", "category", "name"]
PAGE = ["site", "category", "url"]


def from_wide(table: DataFrame, site: Column, category: Column, url: Column, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Claims of the columns of a table, which are stacked; nulls make no claim. keep: columns that stay beside them."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = table.select(site.cast("string").alias("site"), category.cast("string").alias("category"), url.cast("string").alias("url"), *keep, F.inline(pairs))
    return rows.filter("value is not null")


def without_names(claims: DataFrame, excluded: list[str]) -> DataFrame:
    return claims.filter(~F.col("name").isin(excluded)) if excluded else claims


def last_wins(claims: DataFrame, order: str) -> DataFrame:
    """One claim for each page and name: the last in the order."""
    w = Window.partitionBy(*PAGE, "name").orderBy(F.col(order).desc())
    return claims.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def transformed(claims: DataFrame, common_ratio: float = 0.0) -> DataFrame:
    """value as its token set: folded, cut, numbers rounded to two digits.

    Each different string is transformed once. common_ratio: drop tokens in at least this part of an attribute's values
    (0: keep all), where it has three at least, but never all tokens of a value.
    """
    strings = claims.select("value").distinct()
    sets = strings.select("value", F.array_sort(F.array_distinct(F.transform(T.tokens(T.fold(F.col("value"))), lambda x: x))).alias("__raw"))
    numbers = sets.select(F.explode("__raw").alias("__t")).distinct().filter(T.is_number(F.col("__t"))).select("__t", T.round_significant(F.col("__t")).alias("__r"))
    cut = sets.select("value", F.explode_outer("__raw").alias("__t")).join(numbers, "__t", "left")
    done = cut.groupBy("value").agg(F.array_sort(F.collect_set(F.coalesce("__r", "__t"))).alias("tokens"))
    rows = claims.join(done, "value").withColumn("raw_value", F.col("value")).withColumn("value", F.col("tokens")).drop("tokens")
    if common_ratio <= 0:
        return rows
    size = rows.groupBy(*SA).agg(F.count("*").alias("__n"))
    seen = rows.select(*SA, F.explode("value").alias("__t")).groupBy(*SA, "__t").agg(F.count("*").alias("__c")).join(size, SA)
    common = seen.filter((F.col("__n") >= 3) & (F.col("__c") >= common_ratio * F.col("__n"))).groupBy(*SA).agg(F.collect_set("__t").alias("__common"))
    left = F.array_except("value", F.coalesce("__common", F.array().cast("array<string>")))
    return rows.join(common, SA, "left").withColumn("value", F.when(F.size(left) > 0, left).otherwise(F.col("value"))).drop("__common")


def domains(claims: DataFrame) -> DataFrame:
    """Occurrences of each value of each attribute."""
    return claims.groupBy(*SA, "value").agg(F.count("*").alias("occs"))


def sizes(claims: DataFrame) -> DataFrame:
    """Claims, different values and pages of each attribute."""
    return claims.groupBy(*SA).agg(F.count("*").alias("size"), F.countDistinct("value").alias("cardinality"), F.countDistinct("url").alias("pages"))


def value_attributes(claims: DataFrame) -> DataFrame:
    """In how many attributes and sources each value of a category occurs."""
    return claims.groupBy("category", "value").agg(F.countDistinct("site", "name").alias("attrs"), F.countDistinct("site").alias("sources"))


def common_values(claims: DataFrame, least: int = 15, ratio: float = 0.2) -> DataFrame:
    """Values of more than `least` attributes and more than `ratio` of all attributes of the category."""
    whole = claims.groupBy("category").agg(F.countDistinct("site", "name").alias("all_attrs"))
    return value_attributes(claims).join(F.broadcast(whole), "category").filter((F.col("attrs") > least) & (F.col("attrs") > ratio * F.col("all_attrs"))).select("category", "value", "attrs")


def non_isolated_values(claims: DataFrame) -> DataFrame:
    """Values of two sources or more."""
    return value_attributes(claims).filter("sources > 1").select("category", "value", "sources")


def top_values(claims: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values of each attribute; ties by value."""
    w = Window.partitionBy(*SA).orderBy(F.col("occs").desc(), "value")
    return domains(claims).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def common_tokens(claims: DataFrame, ratio: float) -> DataFrame:
    """Tokens in at least `ratio` of an attribute's values, where it has three at least; value holds token sets."""
    size = claims.groupBy(*SA).agg(F.count("*").alias("size")).filter("size >= 3")
    seen = claims.select(*SA, F.explode("value").alias("token")).groupBy(*SA, "token").agg(F.count("*").alias("occs"))
    return seen.join(size, SA).filter(F.col("occs") >= ratio * F.col("size")).select(*SA, "token", "occs", "size")


def head_tail(table: DataFrame, size: str, by: list[str] = ()) -> DataFrame:
    """table with `part`: HEAD while what is larger sums to less than half of all, else TAIL; equal sizes stay together."""
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    # Sizes are summed by value first: the window then runs over different sizes, not over rows.
    groups = table.groupBy(*by, size).agg(F.sum(size).alias("__s"))
    before = F.sum("__s").over(over.orderBy(F.col(size).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__s")
    parts = groups.withColumn("part", F.when(before < F.sum("__s").over(over) / 2, "HEAD").otherwise("TAIL")).drop("__s")
    return table.join(parts, [*by, size])


def with_pids(claims: DataFrame, linkage: DataFrame, how: str = "left") -> DataFrame:
    """Claims with the entities of their pages; pages without any stay."""
    return claims.join(linkage, PAGE, how)


def linked(claims: DataFrame, linkage: DataFrame) -> DataFrame:
    """Claims of pages with an entity; the others are kept aside in a run and come back at its end."""
    return claims.join(linkage.select(*PAGE).distinct(), PAGE, "left_semi")


def frequent_core(claims: DataFrame, least: int = 3) -> DataFrame:
    """Attributes on `least` pages, pages of `least` attributes, again and again until nothing goes; then sources with
    as many of both."""
    rows, before = cut(claims), -1
    while True:
        now = rows.count()
        if now == before:
            break
        before = now
        names = rows.groupBy(*SA).agg(F.countDistinct("url").alias("n")).filter(F.col("n") >= least)
        rows = rows.join(names, SA, "left_semi")
        pages = rows.groupBy(*PAGE).agg(F.countDistinct("name").alias("n")).filter(F.col("n") >= least)
        rows = cut(rows.join(pages, PAGE, "left_semi"))
    sources = rows.groupBy("site", "category").agg(F.countDistinct("url").alias("u"), F.countDistinct("name").alias("n")).filter((F.col("u") >= least) & (F.col("n") >= least))
    return rows.join(sources, ["site", "category"], "left_semi")


def good_attribute(name: Column) -> Column:
    """Short names of two letters at least that aren't a price or a call to act."""
    folded = T.fold(name)
    words = F.split(folded, " ")
    calls = F.array_contains(words, "please") | F.array_contains(words, "select") | (F.array_contains(words, "click") & F.array_contains(words, "here"))
    return (F.length(name) < 50) & (F.length(folded) >= 2) & ~folded.rlike(r"^(usd|eur|gbp)? ?[0-9]+[.,]?[0-9]*$") & ~calls


def split_colons(claims: DataFrame, names: list[str], order: int = 3) -> DataFrame:
    """Repairs values like `a: x b: y`: where words before a colon are a known name, they start an attribute of their own."""
    known = "|".join(sorted((r"\Q" + n + r"\E" for n in names), key=len, reverse=True))
    if not known:
        return claims
    marked = F.regexp_replace(F.col("value"), rf"(?:^|(?<=\s))({known})\s*:\s*", "\u0001$1\u0002")
    parts = F.filter(F.split(marked, "\u0001"), lambda x: F.trim(x) != "")
    pieces = F.transform(parts, lambda x: F.struct(F.when(x.contains("\u0002"), F.substring_index(x, "\u0002", 1)).otherwise(F.col("name")).alias("name"), F.trim(F.substring_index(x, "\u0002", -1)).alias("value")))
    return claims.select("site", "category", "url", F.inline(pieces)).filter("value <> ''")


def contained_sets(table: DataFrame, key: str, element: str) -> DataFrame:
    """Keys whose set of elements is part of another's; of equal sets all but the greatest key."""
    rows = table.select(F.col(key).alias("k"), F.col(element).alias("e")).filter("k is not null").distinct()
    # Keys of equal sets are one set; a set is looked for among those that have its rarest element, until the first is found. A
    # null is an element that no other set has.
    own = cut(rows.groupBy("k").agg(F.array_sort(F.collect_set("e")).alias("set"), F.count("*").alias("n")))
    often = rows.groupBy("e").agg(F.count("*").alias("often"))
    sets = cut(own.groupBy("set", "n").agg(F.max("k").alias("last")))
    each = sets.select("set", "n", F.explode("set").alias("e"))
    rarest = each.filter(F.size("set") == F.col("n")).join(often, "e").groupBy("set", "n").agg(F.min(F.struct("often", "e"))["e"].alias("e"))
    parts = width(table.sparkSession)
    one, two = rarest.repartition(parts, "e"), each.select(F.col("set").alias("whole"), F.col("n").alias("m"), "e").repartition(parts, "e")
    inside = one.join(two, (one.e == two.e) & (F.col("n") < F.col("m")) & (F.size(F.array_except("set", "whole")) == 0), "left_semi").select("set", "n", F.lit(True).alias("inside"))
    judged = sets.filter(F.size("set") == F.col("n")).join(inside, ["set", "n"], "left")
    return own.join(judged, ["set", "n"]).filter("inside or k < last").select(F.col("k").alias(key))


def linked_often(linkage: DataFrame, claims: DataFrame, least: int = 2, shortest: int = 1, longest: int = 100) -> DataFrame:
    """Linkage of entities with `least` urls overall, whose id has a length in bounds, on pages that there are claims of."""
    many = linkage.groupBy("pid").agg(F.countDistinct("url").alias("n")).filter(F.col("n") >= least).select("pid")
    fit = linkage.filter(F.length("pid").between(shortest, longest)).join(many, "pid", "left_semi")
    return fit.join(claims.select(*PAGE).distinct(), PAGE, "left_semi")


def cleaned(claims: DataFrame) -> DataFrame:
    """Claims of sites without www., without empty values; pages of a url become one, of whose values the least stays."""
    rows = claims.select(F.regexp_replace("site", r"^www\.", "").alias("site"), "category", "url", "name", "value").filter(F.trim("value") != "")
    return rows.groupBy("site", "category", "url", "name").agg(F.min("value").alias("value"))


def head_attributes(claims: DataFrame) -> DataFrame:
    """Claims of the attributes that are the head of their source by pages."""
    size = claims.groupBy(*SA).agg(F.countDistinct("url").alias("n"))
    head = head_tail(size, "n", ["site", "category"]).filter("part = 'HEAD'").select(*SA)
    return claims.join(head, SA, "left_semi")


def attribute_values(claims: DataFrame, linkage: DataFrame, linked_only: bool = False) -> DataFrame:
    """Rows site, category, name, url, value, pid, others: of a page's entities the least is its main one."""
    ids = linkage.groupBy(*PAGE).agg(F.array_sort(F.collect_set("pid")).alias("ids"))
    rows = claims.join(ids, PAGE, "inner" if linked_only else "left")
    return rows.select(*SA, "url", "value", F.get("ids", 0).alias("pid"), F.slice(F.coalesce("ids", F.array().cast("array<string>")), 2, 2**31 - 1).alias("others"))
