"""Text normalisation and word matching, as column expressions."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_WORD, PREFIX = 3, 4
#: What Python's \w holds less digits and the underscore; Java's own classes differ on thousands of code points.
LETTERS = r"[\p{L}\p{Nl}\p{No}]{%d,}+" % MIN_WORD
_BLANK = r"(?U)[\s\x1c-\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; written out, each mention would compute it again."""
    return F.transform(F.array(value), lambda x: body(x))[0]


@lru_cache(maxsize=1)
def _foldings() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """What case folding changes beyond lower-casing: one-to-one, and one-to-several."""
    single, several = {}, []
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if c.lower() == c != c.casefold():
            if len(c.casefold()) == 1:
                single[c] = c.casefold()
            else:
                several.append((c, c.casefold()))
    return "".join(single), "".join(single.values()), tuple(several)


def casefold(c: Column) -> Column:
    """Full case folding in the JVM: lower-casing, and the whole table only where a text holds a letter that it changes."""
    ones, folded, several = _foldings()
    rare = "[" + "".join(c for c in ones if c != "µ") + "".join(c for c, _ in several if c != "ß") + "]"

    def fold(low):
        short = F.replace(F.translate(low, "µ", "μ"), F.lit("ß"), F.lit("ss"))
        whole = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), several, F.translate(low, ones, folded))
        return F.when(low.rlike(r"[^\x00-\xFF]") & low.rlike(rare), whole).when(low.rlike("[ßµ]"), short).otherwise(low)

    return let(F.lower(c), fold)


def normalised(c: Column) -> Column:
    """Case-folded, with the two spellings of one Cyrillic vowel as one; null becomes empty."""
    return F.replace(casefold(F.coalesce(c, F.lit(""))), F.lit("ё"), F.lit("е"))


def split_letters(norm: Column) -> Column:
    """Runs of letters of at least three in a normalised text."""
    return F.regexp_extract_all(norm, F.lit(LETTERS), F.lit(0))


def words(c: Column) -> Column:
    """Runs of letters of at least three, in order, repeats kept."""
    return split_letters(normalised(c))


def prefix_overlap(a: Column, b: Column, n: int = PREFIX) -> Column:
    """Words of at least ``n`` letters match by their first ``n``, shorter ones as a whole."""
    return F.when((F.length(a) >= n) & (F.length(b) >= n), F.left(a, F.lit(n)) == F.left(b, F.lit(n))).otherwise(a == b)


def match_key(word: Column, n: int = PREFIX) -> Column:
    """Equal for two words just if they match by ``prefix_overlap``: the first ``n`` letters, a shorter word as a whole."""
    return F.left(word, F.lit(n))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{_BLANK}+$|^{_BLANK}+", "")


def split_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def has_cjk(description: Column, keywords: Column) -> Column:
    """A stray ideograph in the description or a keyword, a known slip of describing models."""
    text = F.concat_ws(" ", F.coalesce(description, F.lit("")), F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), " "))
    return text.rlike(r"[一-鿿]")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, with invalid ones left out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
