"""Cleaning and tokenising of post text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these exact patterns.
LINK_PATTERN = "(//t.co/)(.*)"
LINK_MARK = " Link"
SCHEME = "https:"
TAG_PATTERN = "<[^>]+>"
NOT_LOWER_LATIN = "[^a-z]"

# Words are cut as by the Unicode word boundaries (annex 29): a full stop or an apostrophe joins two letters, these, a
# comma or a semicolon two digits, an underscore anything; ideographs and hiragana stand singly, katakana in runs.
# The quantifiers are possessive, so that java.util.regex loops over a text such as "a.a.a.…" where backtracking ones
# would recurse and overflow the executor's stack. Below U+2E80 no letter's script needs to be looked up.
_SINGLE = r"\p{IsHan}\p{IsHiragana}"
_KATAKANA = r"\p{IsKatakana}\x{30FC}"
_LETTER = rf"[a-z[\p{{L}}&&[\x{{0}}-\x{{2E7F}}]][\p{{L}}&&[^\x{{0}}-\x{{2E7F}}{_SINGLE}{_KATAKANA}]]]"
_LETTERS = rf"{_LETTER}[a-z{_LETTER}\p{{M}}]*+"
_DIGITS = r"\p{N}[0-9\p{N}\p{M}]*+"
# The common case first: plain letters before a blank.
TOKEN_PATTERN = (
    r"(?=[a-z\p{L}\p{N}_])(?:[a-z]++(?=[ ,\n])"
    rf"|(?:{_LETTERS}(?:['’.]{_LETTERS})*+|{_DIGITS}(?:['’.,;]{_DIGITS})*+|_\p{{M}}*+)++"
    rf"|[\p{{L}}&&[{_SINGLE}]]\p{{M}}*+|(?:[\p{{L}}&&[{_KATAKANA}]]\p{{M}}*+)++)"
)

# White space including the Unicode separators, which java's \s leaves out.
SPACE_PATTERN = r"[\t\n\f\r\p{Z}]+"


def strip_links(text: Column) -> Column:
    """Replace a short link and the rest of its line with " Link".

    The byte search skips the regex for the texts, mostly all, that hold no such link.
    """
    return F.when(text.contains("//t"), F.regexp_replace(text, LINK_PATTERN, LINK_MARK)).otherwise(text)


def clean_text(text: Column) -> Column:
    """Strip links, then the https scheme, then markup tags, in that order."""
    without_links = F.regexp_replace(text, LINK_PATTERN, LINK_MARK)
    without_scheme = F.replace(without_links, F.lit(SCHEME), F.lit(""))
    return F.regexp_replace(without_scheme, TAG_PATTERN, "")


def lower_text(text: Column) -> Column:
    """Lower-case the text before matching."""
    return F.lower(text)


def words(text: Column) -> Column:
    """The lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def blank_separated(text: Column) -> Column:
    """The lower-cased pieces of a text between white space, in order; empty pieces are left out."""
    return F.array_remove(F.split(F.lower(text), SPACE_PATTERN), "")


def first_word(ngram: Column) -> Column:
    """What precedes the first character that is neither letter nor digit."""
    return F.regexp_extract(ngram, r"^[\p{L}\p{N}]*", 0)


def normalise_handle(token: Column) -> Column:
    """Turn all but a-z into blanks and trim; "@john_doe9" becomes "john doe"."""
    return F.trim(F.regexp_replace(token, NOT_LOWER_LATIN, " "))
