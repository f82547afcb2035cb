"""Text expressions for names and addresses. All run in the JVM but transliteration of non-ASCII strings."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from matchloom.functions import rules

COUNTRIES = ("us", "india", "france")
#: Letters that do not decompose.
LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "þ": "th", "ı": "i", "’": "'", "–": "-", "—": "-"}


def to_ascii(s: str | None) -> str:
    """Latin text without accents; null is empty. Other scripts go by the names that Unicode gives their letters."""
    if not s or s.isascii():
        return s or ""
    out = []
    for c in unicodedata.normalize("NFKD", "".join(LETTERS.get(c, c) for c in s)):
        if c.isascii():
            out.append(c)
        elif not unicodedata.combining(c) and c.isalpha():
            words = unicodedata.name(c, "").split()
            if "LETTER" in words:
                out.append(words[-1].lower())
    return "".join(out)


@F.pandas_udf(StringType())
def _transliterate(s: pd.Series) -> pd.Series:
    return s.map(to_ascii, na_action="ignore")


def _accents() -> dict[str, str]:
    """Letters of the Latin blocks that are one ASCII letter with marks, by their decomposition."""
    table = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base, *marks = unicodedata.normalize("NFKD", chr(code))
        if base.isascii() and base.isalpha() and marks and all(map(unicodedata.combining, marks)):
            table[chr(code)] = base
    return table


ACCENTS = _accents()


def _translated(c: Column, table: dict[str, str]) -> Column:
    return F.translate(c, "".join(table), "".join(table.values()))


def transliterate(c: Column) -> Column:
    """ASCII form. Accents and letters that do not decompose are folded in the JVM; only strings with still other characters go to Python, all others as nulls."""
    plain, ascii_only = F.coalesce(c, F.lit("")), r"^[\x00-\x7F]*$"
    one = {k: v for k, v in LETTERS.items() if len(v) == 1}
    folded = _translated(plain, ACCENTS | one)
    for k, v in LETTERS.items():
        if len(v) > 1:
            folded = F.replace(folded, F.lit(k), F.lit(v))
    folded = F.when(plain.rlike(ascii_only), plain).otherwise(folded)
    return F.coalesce(_transliterate(F.when(~folded.rlike(ascii_only), folded)), folded)


def clean(c: Column, drop_dots: bool) -> Column:
    """Lower case, & to and, anything but a-z0-9 to single spaces. drop_dots, for names: dots and apostrophes are deleted before, so that l.l.c. is llc; in addresses they part words."""
    c = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    if drop_dots:
        c = F.regexp_replace(c, r"[.'`]", "")
    return F.trim(F.regexp_replace(c, r"[^a-z0-9]+", " "))


def clean_text(text: str | None, drop_dots: bool = False) -> str:
    """transliterate() and clean() of one string, for tables and settings on the driver."""
    out = to_ascii(text).lower().replace("&", " and ")
    out = "".join(c for c in out if not (drop_dots and c in ".'`"))
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in out).split())


def normal(c: Column) -> Column:
    """Plain form that keeps scripts: Latin letters without accents, lower case, & to and, all but letters, marks and digits to single spaces."""
    bare = F.regexp_replace(_translated(c, ACCENTS), r"(\p{IsLatin})\p{M}+", "$1")
    return F.trim(F.regexp_replace(F.replace(F.lower(bare), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{M}\p{N}]+", " "))


def plain_ascii(c: Column) -> Column:
    """transliterate(), then lower case, & to and, all but a-z0-9 to single spaces."""
    return clean(transliterate(c), False)


def raw_name(c: Column) -> Column:
    """A name as it was written, but for case and blanks."""
    return F.trim(F.regexp_replace(F.lower(c), "[ \t]+", " "))


def text_views(core: Column, city: Column, addr: Column) -> dict[str, Column]:
    """The three texts that forward searches compare; parts that are null are left out."""
    return {"name": core, "name_city": F.trim(F.concat_ws(" ", core, city)), "name_addr": F.trim(F.concat_ws(" ", core, F.replace(addr, F.lit(","), F.lit(""))))}


def ce_text(core: Column, addr: Column, country: Column) -> Column:
    """One side of a pair as a second scorer reads it."""
    return F.concat_ws(" | ", *[F.coalesce(x, F.lit("")) for x in (core, addr, country)])


def country_key(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def by_country(key: Column, make: Callable[[str], Column]) -> Column:
    """An expression for each country with a table, and one for all others."""
    out = make("")
    for name in COUNTRIES:
        out = F.when(key == name, make(name)).otherwise(out)
    return out


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a key in a fixed table; null where it has none."""
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def map_tokens(c: Column, table: dict[str, str]) -> Column:
    """Tokens replaced by a fixed table."""
    return F.array_join(F.transform(F.split(c, " "), lambda t: F.coalesce(lookup(table, t), t)), " ")


def tokens(c: Column) -> Column:
    """Distinct tokens, in order of their first place."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda t: t != ""))


def skeleton(c: Column) -> Column:
    """Consonant skeleton: sounds merged, vowels after a token's first letter dropped, repeats collapsed."""
    for a, b in rules.SKELETON:
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, r"[^a-z0-9 ]+", "")
    c = F.regexp_replace(c, r"(?<=[a-z0-9])[aeiouy]", "")
    return F.regexp_replace(c, r"([a-z])\1+", "$1")


def char_grams(c: Column, low: int, high: int) -> Column:
    """Character n-grams of each word, padded with a space at both ends; words that repeat keep their repeats."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")

    def runs(padded: Column, n: int, count: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        parts = []
        for n in range(low, high + 1):
            count = F.length(padded) - (n - 1)
            one = F.array(padded) if n == low else F.array().cast("array<string>")
            parts.append(F.when(count >= 1, runs(padded, n, count)).otherwise(one))
        return F.concat(*parts)

    return F.flatten(F.transform(words, of))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; null if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union)


def grams3(c: Column) -> Column:
    """Distinct character 3-grams of the text padded with a space at both ends. Characters are taken apart once and put together side by side: taking substrings would walk from the start for each."""
    chars = F.split(F.concat(F.lit(" "), c, F.lit(" ")), "")
    rest = lambda k: F.slice(chars, k, F.greatest(F.size(chars), F.lit(1)))
    three = F.zip_with(F.zip_with(chars, rest(2), lambda x, y: F.concat(x, y)), rest(3), lambda x, y: F.concat(x, y))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(three, lambda x: x.isNotNull())))


def same(a: Column, b: Column) -> Column:
    """1 or 0; null if either is null or empty."""
    return F.when((a != "") & (b != ""), (a == b).cast("double"))


def number_tokens(c: Column) -> Column:
    """Distinct runs of digits without leading zeros, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: F.regexp_replace(x, r"^0+(\d)", "$1")))
