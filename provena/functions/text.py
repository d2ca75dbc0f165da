"""Tokenising and counting as column expressions, all inside the JVM and without a shuffle.

Regular expressions name their character classes: Java, Python and RE2 disagree on ``\\w`` and ``\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, for use inside a character class.
WS = r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
TOKEN = WORD + r"|[^\p{L}\p{N}_" + WS + "]|_"
PARAGRAPH_BREAK = r"\n[ \t]*\n+"
PUNCTUATION = r"[\p{P}$+<=>^`|~]"
CODE_BLOCK = r"(?ms)^[ \t]*(`{3,}|~{3,})[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\z)"
#: General categories, fixed by Unicode; unassigned code points have no class in every engine.
CATEGORIES = ("Cc", "Cf", "Co", "Cs", "Ll", "Lm", "Lo", "Lt", "Lu", "Mc", "Me", "Mn", "Nd", "Nl", "No", "Pc", "Pd", "Pe", "Pf", "Pi", "Po", "Ps", "Sc", "Sk", "Sm", "So", "Zl", "Zp", "Zs")

#: Those that ASCII characters have, as character classes.
ASCII_CATEGORIES = {
    "Cc": r"[\x00-\x1F\x7F]", "Ll": "[a-z]", "Lu": "[A-Z]", "Nd": "[0-9]", "Pc": "_", "Pd": "-", "Pe": r"[)\]}]", "Po": r"[!\"#%&'*,./:;?@\\]",
    "Ps": r"[(\[{]", "Sc": r"[$]", "Sk": r"[\^`]", "Sm": "[+<=>|~]", "Zs": " ",
}


def whole(text: Column | str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def lower_words(text: Column) -> Column:
    return words(F.lower(text))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, PARAGRAPH_BREAK), lambda p: p.rlike(f"[^{WS}]"))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def neighbours(ordered: str, make) -> Column:
    """make(previous, this, next) for each entry of a column; null beyond the ends.

    Takes a column by name: a lambda that held the expression would sort again for each entry."""
    c = F.col(ordered)
    return F.transform(c, lambda x, i: make(F.get(c, i - 1), x, F.get(c, i + 1)))


def hapax(ordered: str) -> Column:
    """How many entries of a sorted array occur once: both neighbours differ."""
    alone = neighbours(ordered, lambda a, x, b: (a.isNull() | (a != x)) & (b.isNull() | (b != x)))
    return F.size(F.filter(alone, lambda x: x))


def positioned(list_: str) -> Column:
    """Sorted (entry x, position i) of an array column."""
    return F.array_sort(F.transform(list_, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))


def moving_ttr(ordered: str, window: int = 50) -> Column:
    """Mean share of distinct entries over all full windows, from positioned(); null if there is none.

    An entry at i whose last equal entry is at p is the first of its kind in the windows that start in
    (max(p, i - window), i]; summing their number over i counts all distinct entries of all windows
    after one sort, instead of looking at each window."""
    n = F.size(ordered)

    def starts(a: Column, x: Column, _: Column) -> Column:
        before = F.when(a["x"] == x["x"], a["i"]).otherwise(F.lit(-1))
        low = F.greatest(before + 1, x["i"] - (window - 1), F.lit(0))
        return F.greatest(F.least(x["i"], n - window) - low + 1, F.lit(0)).cast("long")

    total = F.aggregate(neighbours(ordered, starts), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.when(n >= window, total / (F.lit(window).cast("double") * (n - window + 1)))


def ngrams(list_: str, n: int) -> Column:
    """The n-grams of an array column, joined by spaces."""
    k = F.size(list_) - n + 1
    return F.when(k > 0, F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(list_, i, n), " "))).otherwise(F.array().cast("array<string>"))
