"""Token-level text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The characters that count as blanks, as in ECMAScript.
BLANKS = ("\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f"
          "\u3000\ufeff")
#: The same characters as a Java class that is done with any other character below U+1680 after two tests.
BLANK = "[\\t-\\r \\x{a0}[\\x{1680}-\\x{feff}&&[\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]]]"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def tokens(text: Column) -> Column:
    """Blank-separated words of the trimmed text."""
    return F.split(trimmed(text), f"{BLANK}+")


def with_word(text: Column, at: Column, word: Column) -> Column:
    """The trimmed text with word number ``at`` (from 0) replaced; all blanks stay as they are."""
    gaps = F.split(trimmed(text), f"[^{BLANKS}]+")
    words = F.transform(tokens(text), lambda w, i: F.when(i == at, word).otherwise(w))
    return F.array_join(F.zip_with(gaps, words, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def clean_token(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[^a-z0-9]", "")


def collapse_repeats(clean: Column) -> Column:
    """Runs of three or more equal characters shortened to two."""
    return F.regexp_replace(clean, r"(.)\1{2,}", "$1$1")


def gibberish_reason(clean: Column, word: Column) -> Column:
    """``repeat``, ``consonants``, ``mixed_case`` or null, first rule wins."""
    return (F.when(clean.rlike(r"(.)\1{2,}"), F.lit("repeat"))
             .when(clean.rlike("[bcdfghjklmnpqrstvwxyz]{4,}"), F.lit("consonants"))
             .when((F.length(word) >= 4) & word.rlike("[a-z][A-Z][a-z]"), F.lit("mixed_case")))


def match_case(original: Column, target: Column) -> Column:
    """Target rewritten in the upper, title or lower form of the original."""
    head = F.substring(original, 1, 1)
    title = F.concat(F.upper(F.substring(target, 1, 1)), F.lower(F.substring(target, 2, 1 << 20)))
    return (F.when(original == F.upper(original), F.upper(target))
             .when(head == F.upper(head), title)
             .otherwise(F.lower(target)))


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^/.]+$", "")


def safe_file_part(name: Column) -> Column:
    """Everything outside word characters, CJK ideographs and ``-`` becomes ``_``."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_一-龥-]", "_")


def first_word(s: Column) -> Column:
    return F.split_part(s, F.lit(" "), F.lit(1))


def html_escape(s: Column) -> Column:
    for raw, esc in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(raw), F.lit(esc))
    return s


def delta_label(delta: Column) -> Column:
    return (F.when(delta > 0, F.concat(F.lit("+"), delta.cast("string")))
             .when(delta == 0, F.lit("±0")).otherwise(delta.cast("string")))


def region_confidence(edge_score: Column) -> Column:
    return F.least(F.lit(0.99), F.greatest(F.lit(0.65), edge_score * 0.2 + 0.75))


def is_blurry(edge_score: Column) -> Column:
    return edge_score < 0.15
