"""String and JSON functions as column expressions; all but the HTML unescape stay in the JVM."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# One word character: Java's own word class is ASCII only.
WORD = r"[\p{L}\p{N}_]"

# Fixed value: the published rule for quoted lines in news messages, as it stands in scikit-learn (BSD 3-Clause), since results must agree.
QUOTE_LINE = r"(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)"


def strip_spaces(c: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_number(values: Column) -> Column:
    """Digits of the first array element as a number; null if there are none."""
    return F.regexp_replace(F.get(values, 0), r"\D", "").try_cast("double")


def unknown_if_short(c: Column, least: int = 2, label: str = "unknown") -> Column:
    return F.when(F.length(c) < least, label).otherwise(c)


def drop_long_spaces(c: Column) -> Column:
    """Remove runs of two or more white-space characters."""
    return F.regexp_replace(c, r"\s{2,}", "")


def between_markers(c: Column, start: str, end: str) -> Column:
    """Text after the first `start` up to the first `end` behind it; null if either is missing."""
    after = F.when(F.locate(start, c) > 0, F.substring(c, F.locate(start, c) + F.lit(len(start)), F.length(c)))
    return F.when(F.locate(end, after) > 0, F.substring(after, F.lit(1), F.locate(end, after) - 1))


def drop_class_attribute(c: Column) -> Column:
    return F.regexp_replace(c, r'\s*class="[\w\s]+"\s*', "")


def brazilian_number(c: Column) -> Column:
    """'1.059,46' -> '1059.46'."""
    return F.translate(F.translate(c, ".", ""), ",", ".")


def _unescape_batch(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_unescape(c: Column) -> Column:
    """All named, decimal and hexadecimal character references of the HTML standard.

    Its rules (2,231 names, longest name first, replaced and forbidden code points) are the standard library's, applied to
    Arrow batches.
    """
    return F.pandas_udf(_unescape_batch, "string")(c)


def obfuscate_words(c: Column) -> Column:
    """Keep at most two leading and the last word characters; what lies between becomes XX."""
    return F.regexp_replace(c, f"({WORD}{{0,2}}){WORD}+({WORD}{{1,3}})", "$1XX$2")


def mask_word_characters(c: Column, sign: str = "x") -> Column:
    return F.regexp_replace(c, WORD, sign)


def characters(c: Column) -> Column:
    """Array of the characters of a text."""
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


def _once(value: Column, body) -> Column:
    """body(value) with value computed once per row, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _starts(size: Column, n: int) -> Column:
    """0-based start positions of the runs of n that fit into size elements."""
    last = size - n
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _run(items: Column, start: Column, n: int, glue: str) -> Column:
    """n elements from start on, joined. Indexing is constant time; slice() would copy the array."""
    return F.concat_ws(glue, *[F.get(items, start + i) for i in range(n)])


def char_ngrams(c: Column, low: int, high: int) -> Column:
    """n-grams of low..high characters at every position where the longest one still fits."""
    # takes one character and looks ahead for the run that starts with it
    longest = F.coalesce(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{high}}}))."), 1), F.array().cast("array<string>"))
    if low == high:
        return longest
    return F.flatten(F.transform(longest, lambda run: F.array(*[F.substring(run, 1, n) for n in range(low, high)], run)))


def runs(items: Column, low: int, high: int, glue: str) -> Column:
    """Every run of low..high neighbouring items, joined; the short ones first."""
    def of_length(a: Column, n: int) -> Column:
        return F.transform(_starts(F.size(a), n), lambda t: _run(a, t, n, glue))

    return _once(items, lambda a: F.flatten(F.array(*[of_length(a, n) for n in range(low, high + 1)])))


def all_char_ngrams(c: Column, low: int, high: int) -> Column:
    """n-grams of low..high characters at every position, the short ones at the tail included."""
    return runs(characters(c), low, high, "")


def keep_vocabulary(grams: Column, vocabulary: list[str]) -> Column:
    """Entries of the array found in a short fixed vocabulary, repeats kept."""
    return F.filter(grams, lambda g: g.isin(vocabulary))


def word_tokens(c: Column) -> Column:
    """Tokens of two or more word characters."""
    return F.regexp_extract_all(c, F.lit(f"{WORD}{{2,}}"), 0)


def word_ngrams(tokens: Column, low: int, high: int) -> Column:
    """Space-joined runs of low..high tokens."""
    return runs(tokens, low, high, " ")


def trim_to(c: Column, width: int = 80) -> Column:
    """Shorten to width with an ellipsis."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def strip_headers(c: Column) -> Column:
    """Drop everything up to and including the first blank line; a text without one is kept."""
    return F.when(F.locate("\n\n", c) > 0, F.substring(c, F.locate("\n\n", c) + F.lit(2), F.length(c))).otherwise(c)


def strip_quotes(c: Column) -> Column:
    """Drop quoted lines, which start with > or |, and the attribution lines above them."""
    return F.array_join(F.filter(
        F.split(c, "\n"),
        lambda line: ~line.rlike(QUOTE_LINE)), "\n")


def strip_footer(c: Column) -> Column:
    """Drop the signature: the last block set off by a blank or all-dashes line."""
    lines = F.split(F.regexp_replace(c, r"^\s+|\s+$", ""), "\n")
    flags = F.transform(lines, lambda line: line.rlike(r"^\s*-*\s*$"))
    # last separating line that is not the first line
    last = F.array_max(F.transform(flags, lambda flag, i: F.when(flag, i).otherwise(F.lit(0))))
    return F.when(last > 0, F.array_join(F.slice(lines, F.lit(1), last), "\n")).otherwise(c)


def strip_message(c: Column, parts: tuple[str, ...] = ("headers", "footers", "quotes")) -> Column:
    """Remove the named parts of a mail-like message."""
    if "headers" in parts:
        c = strip_headers(c)
    if "footers" in parts:
        c = strip_footer(c)
    if "quotes" in parts:
        c = strip_quotes(c)
    return c


def url_path(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("PATH"))


def url_file(c: Column) -> Column:
    """Last part of the URL path."""
    return F.regexp_extract(url_path(c), "[^/]+$", 0)


def date_parts(c: Column) -> list[Column]:
    """year, month, day of a text that starts with YYYY-MM-DD."""
    return [F.substring(c, 1, 4).alias("year"), F.substring(c, 6, 2).alias("month"), F.substring(c, 9, 2).alias("day")]


def megabytes(c: Column) -> Column:
    return F.octet_length(c) / 1e6


def percent_label(c: Column) -> Column:
    return F.format_string("%.0f%%", c * 100)


def minutes_seconds(seconds: Column) -> Column:
    """'02m and 05s'."""
    whole = F.round(seconds).cast("long")
    return F.format_string("%02dm and %02ds", F.floor(whole / 60), F.pmod(whole, F.lit(60)))


def parse_jsonp(c: Column, schema: str, prefix: int = 22, suffix: int = 1) -> Column:
    """Body of a JSONP answer: strip, drop the call around it, parse."""
    body = strip_spaces(c)
    return F.from_json(F.substring(body, F.lit(prefix + 1), F.length(body) - prefix - suffix), schema)
