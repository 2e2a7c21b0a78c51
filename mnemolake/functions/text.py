"""Text functions as Column expressions: no Python runs on the executors."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Latin letters with one mark, and the letters below them.
MARKED = "".join(c for c in map(chr, range(0xC0, 0x180)) if len(unicodedata.normalize("NFD", c)) > 1)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else; for ASCII alone the faster built-in does the same."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def like(content: Column, needle: Column) -> Column:
    """Literal substring, ignoring the case of A-Z alone."""
    return ascii_lower(content).contains(ascii_lower(needle))


def any_of(text: Column, words) -> Column:
    """Whether the text holds one of the words."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def first_of(text: Column, table: dict[str, list[str]], default: str) -> Column:
    """The first key, in order, with a word in the text."""
    out = F.lit(default)
    for key, words in reversed(table.items()):
        out = F.when(any_of(text, words), key).otherwise(out)
    return out


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normal(c: Column) -> Column:
    """Words joined by single spaces, split at all that Python's split() takes for white space; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))


def fts_tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, without marks."""
    low = F.lower(text)
    plain = F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, MARKED.lower(), PLAIN.lower()))  # ASCII has no marks
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def probe(content: Column) -> Column:
    """The leading clause of 6 to 24 characters, separators tried in order, or else 14 characters."""
    s = collapse(F.coalesce(content, F.lit("")))
    out = F.substring(s, 1, 14)
    for sep in reversed("，。；;！？"):
        at = F.locate(sep, s) - 1
        out = F.when(at.between(6, 24), s.substr(F.lit(1), at)).otherwise(out)
    return out


def _repeat_words(text: Column) -> Column:
    """CJK characters first, then Latin words of two characters and more, as they stand."""
    return F.concat(F.regexp_extract_all(text, F.lit("[一-鿿　-〿]"), F.lit(0)), F.regexp_extract_all(text, F.lit("[a-zA-Z0-9_]{2,}"), F.lit(0)))


def repeat_tokens(text: Column) -> Column:
    return F.transform(_repeat_words(text), F.lower)


def repeat_grams(text: Column, n: int) -> Column:
    """The n-grams of repeat_tokens, joined by a space; too few tokens give none. One pattern that looks n tokens ahead of each."""
    return F.regexp_extract_all(F.lower(F.array_join(_repeat_words(text), " ")), F.lit(rf"(?=((?:[^ ]+ ){{{n - 1}}}[^ ]+))[^ ]+"), F.lit(1))


def tree_tokens(text: Column) -> Column:
    """Pieces of two characters and more between anything but a-z, 0-9 and CJK."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9一-龥]+"), lambda w: F.length(w) > 1)


def query_tokens(text: Column) -> Column:
    """ASCII words of two characters and more; runs of CJK and, from three characters, their 2-grams; each once, in order."""
    parts = F.regexp_extract_all(F.lower(text), F.lit("[一-鿿]+|[a-z0-9]+(?:-[a-z0-9]+)*"), F.lit(0))

    def expand(p: Column) -> Column:
        n = F.length(p)
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: p.substr(i, F.lit(2)))
        cjk = p.rlike("^[一-鿿]")
        return F.when(cjk & (n >= 3), F.concat(F.array(p), pairs)).when(n >= 2, F.array(p)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(parts, expand)))


def period(hour: Column) -> Column:
    """Part of the day."""
    return F.when(hour < 5, "深夜").when(hour < 8, "清晨").when(hour < 11, "上午").when(hour < 13, "中午").when(hour < 18, "下午").when(hour < 22, "晚上").otherwise("深夜")


def gap(seconds: Column) -> Column:
    """A span of time in words."""
    h, m = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60)
    return (
        F.when(seconds < 60, "刚刚").when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("分钟")))
        .when(seconds < 86400, F.when(m > 0, F.concat(h.cast("string"), F.lit("小时"), m.cast("string"), F.lit("分"))).otherwise(F.concat(h.cast("string"), F.lit("小时"))))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("天")))
    )


def step_label(value: Column, table: list[tuple[float, str]]) -> Column:
    """The label of the last threshold at or below the value; below all, the first."""
    out = F.lit(table[0][1])
    for t, name in table:
        out = F.when(value >= t, name).otherwise(out)
    return out


def bit_length(n: Column) -> Column:
    return F.length(F.bin(n.cast("long")))


def importance(weight: Column, access: Column, last: Column, now: float, reinforcement: Column) -> Column:
    """Clamped weight x reinforcement x access x 30-day half-life since the last access (none if never accessed)."""
    days = F.greatest(F.lit(0.0), (F.lit(now) - last) / 86400.0)
    decay = F.when(last > 0, F.pow(F.lit(0.5), days / 30.0)).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight)) * (1 + F.least(F.lit(0.5), reinforcement * 0.5)) * F.greatest(F.lit(1), bit_length(access + 1)) * decay
