"""Text expressions: tokens, stems, buckets. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z][A-Za-z'\-]{1,}"  # a fixed value
# Suffixes of the word-family stemmer, of the coverage stemmer and of the verb-root stemmer.
FAMILY_SUFFIXES = ["ed", "ing", "ly", "tion", "sion", "ness", "able", "ful", "less", "ment", "ity", "er", "or", "ive", "ous", "ic", "al", "en"]
COVERAGE_SUFFIXES = ["ed", "ing", "ly", "tion", "sion", "ness", "able", "ful", "less", "ment", "ity", "er", "or", "ive", "ous", "ic", "al", "en", "s", "es"]
ROOT_SUFFIXES = ["ation", "ment", "ness", "ity", "able", "ful", "less", "ing", "ed", "ly", "s"]


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    """Lower-case tokens; null has none. The default pattern is cut out of runs of its characters, which is
    many times faster than regexp_extract_all on long texts."""
    text = F.coalesce(text, F.lit(""))
    if pattern != TOKEN:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)
    runs = F.transform(F.split(text, r"[^A-Za-z'\-]+"), lambda x: F.lower(F.ltrim(x, F.lit("'-"))))
    return F.filter(runs, lambda x: F.length(x) >= 2)


def stem(word: Column, suffixes: list[str], least: int, shortest: int = 0, longest_first: bool = True) -> Column:
    """word without the first suffix, longest first or as listed, that leaves `least` letters; without
    one the word itself, or an empty string if it has under `shortest` letters. C04, C05, C06."""
    out = None
    for s in sorted(suffixes, key=len, reverse=True) if longest_first else suffixes:
        hit = word.endswith(s) & (F.length(word) - len(s) >= least)
        cut = F.substring(word, F.lit(1), F.length(word) - len(s))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(F.when(F.length(word) >= shortest, word).otherwise(""))


def family_stem(word: Column) -> Column:
    return stem(F.lower(word), FAMILY_SUFFIXES, 4, 4)


def coverage_stem(word: Column) -> Column:
    return stem(F.lower(word), COVERAGE_SUFFIXES, 3)


def verb_root(word: Column) -> Column:
    return stem(word, ROOT_SUFFIXES, 3, longest_first=False)


def length_bucket(text: Column, easy: int = 100, mid: int = 400) -> Column:
    n = F.length(text)
    return F.when(n < easy, "easy").when(n < mid, "mid").otherwise("hard")


def strip_html(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", " ")


def concept_kind(cid: Column) -> Column:
    return F.substring_index(cid, ":", 1)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
