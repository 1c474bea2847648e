"""Strings, tokens and token sets as column expressions.

Token sets are sorted arrays without repetitions, so equal sets are equal values and may be grouped and joined on.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A number, a word, or a sign that stands alone in a folded text.
FOLD = r"[0-9]+[.,]?[0-9]*|[a-zA-Z]+"
SEPARATOR = "#-#"


@F.pandas_udf(StringType())
def _ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def ascii_only(s: Column) -> Column:
    """Letters without their accents; what has no ASCII form goes. Only texts that need it go through Python."""
    plain = s.rlike(r"^\p{ASCII}*$")
    return F.when(plain, s).otherwise(_ascii(F.when(~plain, s)))


def fold(s: Column) -> Column:
    """Words and numbers in lower case, one space between them."""
    return F.lower(F.array_join(F.regexp_extract_all(ascii_only(s), F.lit(FOLD), F.lit(0)), " "))


def normalize_keyvalue(s: Column) -> Column:
    """Lower case, without signs at the ends, white space collapsed."""
    return F.trim(F.regexp_replace(F.btrim(F.lower(s), F.lit(" ,.;:")), r"\s+", " "))


def normalize_url(s: Column) -> Column:
    """http scheme, no www., no fragment, slashes of the path collapsed; params and query stay."""
    bare = F.regexp_replace(s, "#.*$", "")
    rest = F.regexp_replace(bare, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", "//")
    host = F.when(rest.startswith("//"), F.regexp_extract(rest, r"^//([^/?]*)", 1)).otherwise(F.lit(""))
    tail = F.when(rest.startswith("//"), F.regexp_replace(rest, r"^//[^/?]*", "")).otherwise(rest)
    path, query = F.regexp_extract(tail, r"^([^?]*)", 1), F.regexp_extract(tail, r"^[^?]*(\?.+)$", 1)
    path = F.btrim(F.regexp_replace(path, "/+", "/"), F.lit("/"))
    return F.concat(F.lit("http://"), F.replace(host, F.lit("www."), F.lit("")), F.when(path != "", F.concat(F.lit("/"), path)).otherwise(F.lit("")), query)


def short_site_name(site: Column, tlds: tuple[str, ...] = ("com", "net", "org", "edu", "gov", "info", "biz", "co", "uk", "de", "fr", "it", "es", "eu", "us", "au", "ca", "in", "jp", "cn", "ru", "br", "nl", "se", "ch", "at", "be", "www")) -> Column:
    """The last label of a site's name that isn't a top-level domain; the whole name if there is none."""
    labels = F.filter(F.split(site, r"\."), lambda x: ~x.isin(*tlds))
    return F.coalesce(F.try_element_at(labels, F.lit(-1)), site)


def weighted_length(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0.0), lambda a, x: a + F.least(F.length(x) / 10.0, F.lit(3.0)))


def tokens(folded: Column) -> Column:
    """Words of a folded text: numbers lose a last comma or point, and contractions are cut in two."""
    text = F.regexp_replace(folded, r"\b(can)(not)\b|\b(gon)(na)\b|\b(got)(ta)\b|\b(gim)(me)\b|\b(lem)(me)\b|\b(wan)(na)\b", "$1$3$5$7$9$11 $2$4$6$8$10$12")
    text = F.regexp_replace(text, r"([0-9])([,.])(?= |$)", "$1 $2")
    return F.filter(F.split(F.trim(text), " +"), lambda x: x != "")


def is_number(token: Column) -> Column:
    return F.replace(token, F.lit(","), F.lit(".")).rlike(r"^[0-9]+([.][0-9]*)?$")


@F.pandas_udf(StringType())
def _two_digits(s: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        if x is None:
            return None
        value = float(x.replace(",", "."))
        if value in (float("inf"), float("-inf")) or value != value:
            return x
        return "0" if value == 0 else str(float(f"{value:.1e}"))

    return s.map(one)


def round_significant(token: Column) -> Column:
    """A number of two significant digits, as text; other tokens stay. Only numbers go through Python."""
    return F.when(is_number(token), _two_digits(F.when(is_number(token), token))).otherwise(token)


def ngrams(words: Column, n: int) -> Column:
    """Arrays of n words in a row."""
    # The words are bound by a lambda, else they would be made anew for each n-gram.
    whole = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array(*[F.get(w, i + k) for k in range(n)]))
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, whole(w)).otherwise(F.array().cast("array<array<string>>"))), 0)


def token_weight(words: Column) -> Column:
    """Numbers weigh 1, other tokens a half."""
    return F.aggregate(words, F.lit(0.0), lambda a, x: a + F.when(is_number(x), 1.0).otherwise(0.5))


def _share(common: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(common / whole)


def weighted_jaccard(a: Column, b: Column) -> Column:
    return _share(token_weight(F.array_intersect(a, b)), token_weight(F.array_union(a, b)))


def weighted_containment(a: Column, b: Column) -> Column:
    return _share(token_weight(F.array_intersect(a, b)), F.least(token_weight(a), token_weight(b)))


def original_name(name: Column) -> Column:
    return F.substring_index(name, SEPARATOR, 1)


def is_virtual(name: Column) -> Column:
    return name.contains(SEPARATOR)


def model_codes(title: Column, code: str = r"[A-Za-z]+[0-9]+[A-Za-z0-9]*|[0-9]+[A-Za-z]+[A-Za-z0-9]*", exclude: str = r"(?i)^[0-9]+(mp|gb|mb|mm|cm|x|hz|in)$") -> Column:
    """Model codes in a title, but those that are measures."""
    return F.array_distinct(F.filter(F.regexp_extract_all(title, F.lit(code), F.lit(0)), lambda x: ~x.rlike(exclude)))


def numberless(s: Column) -> Column:
    """Digits as letters, for knowledge bases that allow none; an empty name is NO_."""
    return F.coalesce(F.nullif(F.translate(s, "0123456789", "ABCDEFGHIJ"), F.lit("")), F.lit("NO_"))
