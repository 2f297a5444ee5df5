"""Text normalisation as native column expressions.

Character classes are spelled out because Java's ``\\w``, ``\\d`` and ``\\s`` are ASCII-only; the
classes below mean the same in Java and RE2 and match Unicode word, digit and space characters.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CHARS = r"[\p{L}\p{N}_]+"
SPACE_CLASS = r" \t\n\x0B\f\r\x1C\x1D\x1E\x1F\x{85}\p{Z}"
# What counts as a link and what is cut from topic words.  Both are spelled for the two
# engines that must agree: one class for a link, which Java matches without deep recursion and RE2 reads
# alike; and [^a-zA-Z\s] written out, which Java tests with one table lookup (0.5 s against 2.3-2.7 s
# for the short form on the sf0.1 texts).
URL = r"https?://[!a-z$-_]+"
MENTION = "@" + WORD_CHARS
HASHTAG = f"#({WORD_CHARS})"
NUMBER = r"\p{Nd}+"
SPACES = f"[{SPACE_CLASS}]+"
NOT_SPACE = f"[^{SPACE_CLASS}]"
NOT_LETTERS = f"[^{string.ascii_letters}" + r" \t\n\x0B\f\r]"
TOKEN_SPLIT = r"\s+"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_blank(text: Column | str) -> Column:
    """True for null, empty and whitespace-only text; stops at the first visible character."""
    text = _column(text)
    return F.coalesce(~text.rlike(NOT_SPACE), F.lit(True))


def clean_text(
    text: Column | str,
    *,
    remove_urls: bool = True,
    remove_mentions: bool = True,
    remove_hashtags: bool = False,
    lowercase: bool = True,
    remove_punctuation: bool = False,
    remove_numbers: bool = False,
) -> Column:
    """Normalise post text; null becomes ``""``.

    ``remove_hashtags=False`` keeps the word and drops only the ``#``.
    """
    cleaned = F.coalesce(_column(text), F.lit(""))
    if remove_urls:
        cleaned = F.regexp_replace(cleaned, URL, "")
    if remove_mentions:
        cleaned = F.regexp_replace(cleaned, MENTION, "")
    cleaned = F.regexp_replace(cleaned, HASHTAG, "" if remove_hashtags else "$1")
    if remove_numbers:
        cleaned = F.regexp_replace(cleaned, NUMBER, "")
    if remove_punctuation:
        cleaned = F.translate(cleaned, string.punctuation, "")
    if lowercase:
        cleaned = F.lower(cleaned)
    return F.trim(F.regexp_replace(cleaned, SPACES, " "))


def preview(text: Column | str, width: int = 200) -> Column:
    """First ``width`` characters followed by ``...`` when the text is longer (display only)."""
    text = _column(text)
    return F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))
    ).otherwise(text)


def tokens(text: Column | str, *, clean_first: bool = False) -> Column:
    """Lowercase ASCII-letter tokens of the whole text; may hold empty strings at the ends.

    ``clean_first`` removes URLs, mentions and hashtag signs before the letters are cut out;
    without it a URL turns into one long word.
    """
    text = clean_text(text) if clean_first else _column(text)
    return F.split(F.lower(F.regexp_replace(text, NOT_LETTERS, "")), TOKEN_SPLIT)


def topic_tokens(
    text: Column | str, stops: list[str], *, min_length: int = 4, clean_first: bool = False
) -> Column:
    """Tokens longer than ``min_length`` and not in ``stops``, in text order and with repeats."""
    return F.filter(
        tokens(text, clean_first=clean_first),
        lambda word: (F.length(word) > min_length) & ~word.isin(stops),
    )


def ngrams(words: Column | str, n: int) -> Column:
    """All runs of ``n`` neighbouring words, joined by one space."""
    words = _column(words)
    if n == 1:
        return words
    last = F.size(words) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def histogram(words: Column | str) -> Column:
    """Distinct words of an array with their counts, as ``array<struct<word, n>>``; none for null.

    The array is sorted; each word starts where its predecessor differs and ends where the next
    begins, so a long text costs a sort and two passes.
    """
    words = _column(words)
    ordered = F.when(F.size(words) > 0, F.array_sort(words))

    def starts(word: Column) -> Column:
        first = F.sequence(F.lit(0), F.size(word) - 1)
        return F.filter(first, lambda i: (i == 0) | (F.get(word, i) != F.get(word, i - 1)))

    boxed = F.transform(F.array(ordered), lambda word: F.struct(word.alias("word"), starts(word).alias("starts")))
    counted = F.transform(boxed, lambda box: F.transform(
        box["starts"],
        lambda at, k: F.struct(
            F.get(box["word"], at).alias("word"),
            (F.coalesce(F.get(box["starts"], k + 1), F.size(box["word"])) - at).cast("long").alias("n"),
        ),
    ))
    return F.when(F.size(words) > 0, F.get(counted, 0))
