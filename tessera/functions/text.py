"""Article text features as native Column expressions (no Python UDF).

Every function maps Column -> Column, so the whole feature set compiles into
one whole-stage-codegen projection and also works on streaming frames.

NULL model: lengths, counts and ratios are NULL for NULL input, except
``special_char_count`` (0), ``has_url`` (0), ``keyword_hits`` (NULL counts
as "") and ``clean_text`` ("").
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from tessera.functions.lexicon import SPLIT_CONTRACTIONS, default_stopwords, matchable_stopwords

# --- fixed values -----------------------------------------------------------
# Characters that are neither alphanumeric nor whitespace in the Python
# ``str.isalnum`` / ``str.isspace`` sense: letters (L*), numbers (N*),
# separators (Z*) and the extra C0/C1 whitespace controls
# (TAB..CR = U+0009..U+000D, U+001C..U+001F, NEL = U+0085).
# Letters and numbers that Unicode added from version 14.0 to 15.1, in code-point order: a JVM of Java 17 (Unicode 13.0)
# has no category for them. Newer JVMs count them already, so the class is the same there.
_NEWER_LETTERS_AND_NUMBERS = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7D0-A7D1 A7D3 A7D5-A7D9 A7F2-A7F4 "
    "10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 10780-10785 10787-107B0 "
    "107B2-107BA 10F70-10F81 11071-11072 11075 1123F-11240 11740-11746 11AB0-11ABF 11F02 11F04-11F10 11F12-11F33 11F50-11F59 "
    "12F90-12FF0 1342F 13441-13446 16A70-16ABE 16AC0-16AC9 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 "
    "1D2C0-1D2D3 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E4F0-1E4F9 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE "
    "1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF")
# Cleaning keeps ASCII letters and Java ``\s`` whitespace (space, TAB, LF,
# VT, FF, CR) only. It runs on lower-cased text, where no ASCII capital is
# left, so the class lists a-z alone; spelled like this it measured about 9x
# faster in the JVM regex engine than with ``A-Z`` or ``\s`` inside.
_NOT_LOWER_LETTER_OR_SPACE_RUN = r"[^a-z\t\n\x0B\f\r ]+"
_WHITESPACE_RUN = r"\s+"
# ---------------------------------------------------------------------------


def _alnum_or_space_run() -> str:
    """The class of alphanumerics and white space. The newer ranges are asked only beyond U+0870."""
    newer = "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in _NEWER_LETTERS_AND_NUMBERS.split())
    return rf"[\p{{L}}\p{{N}}\p{{Z}}\x09-\x0d\x1c-\x1f\x85[\x{{870}}-\x{{323AF}}&&[{newer}]]]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def char_length(c: Column | str) -> Column:
    """Number of characters (code points); INT, NULL on NULL."""
    return F.length(_col(c))


def word_count(c: Column | str) -> Column:
    """Pieces after splitting on a single space: runs of spaces give empty
    words, tabs/newlines do not split, "" has one word. INT."""
    return F.array_size(F.split(_col(c), " "))


def smoothed_ratio(a: Column | str, b: Column | str) -> Column:
    """a / (b + 1) as DOUBLE, NULL when either side is NULL."""
    return F.try_divide(_col(a), F.try_add(_col(b), F.lit(1)))


def count_char(c: Column | str, ch: str) -> Column:
    """Occurrences of one literal character; INT, NULL on NULL.

    Uses split + array_size, the cheapest form measured for a single
    character (no regex backtracking, one pass).
    """
    if len(ch) != 1:
        raise ValueError("count_char expects exactly one character")
    return F.try_subtract(F.array_size(F.split(_col(c), re.escape(ch))), F.lit(1))


def _strip_count(c: Column, keep_run_regex: str) -> Column:
    """Length of what is left after deleting runs of the given class."""
    return F.length(F.regexp_replace(c, keep_run_regex, ""))


def caps_ratio(c: Column | str) -> Column:
    """ASCII capitals A-Z / (length + 1); accented capitals do not count."""
    c = _col(c)
    return F.try_divide(_strip_count(c, r"[^A-Z]+"), F.try_add(F.length(c), F.lit(1)))


def digit_count(c: Column | str) -> Column:
    """ASCII digits 0-9; INT, NULL on NULL."""
    return _strip_count(_col(c), r"[^0-9]+")


def special_char_count(c: Column | str) -> Column:
    """Characters that are neither Unicode alphanumeric nor whitespace; NULL -> 0."""
    return F.coalesce(_strip_count(_col(c), _alnum_or_space_run()), F.lit(0))


def has_url(c: Column | str) -> Column:
    """1 when ``http://`` or ``https://`` occurs (case-sensitive), else 0 (also for NULL).

    Same matches as the regex ``http[s]?://`` but as two substring searches,
    which stay out of the regex engine.
    """
    c = _col(c)
    hit = c.contains("http://") | c.contains("https://")
    return F.when(hit, F.lit(1)).otherwise(F.lit(0))


def keyword_hits(cols: Iterable[Column | str], keywords: Iterable[str]) -> Column:
    """For each keyword and each column: +1 when the keyword is a substring of
    the lower-cased column (presence, not occurrences). NULL counts as "". INT."""
    lowered = [F.coalesce(F.lower(_col(c)), F.lit("")) for c in cols]
    terms = [x.contains(k).cast("int") for k in keywords for x in lowered]
    if not terms:
        return F.lit(0)
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def stopword_array(stopwords: Iterable[str] | None = None) -> Column:
    """The stop-word list as an ARRAY<STRING> literal (one value per row)."""
    words = default_stopwords() if stopwords is None else list(stopwords)
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _split_contractions(c: Column) -> Column:
    """Split the six apostrophe-free contractions the Treebank tokeniser splits
    (cannot -> can not, gimme -> gim me, ...) in lower-cased letters-only
    text. One regex pass: the lookahead checks the whole token, the group
    captures its first piece. Texts containing none of the six words as a
    substring skip the regex (plain substring tests are far cheaper; this
    measured ~25% off the whole cleaning step)."""
    words = "|".join(w for w, _, _ in SPLIT_CONTRACTIONS)
    heads = "|".join(h for _, h, _ in SPLIT_CONTRACTIONS)
    split = F.regexp_replace(c, rf"(?<![a-z])(?=(?:{words})(?![a-z]))({heads})", "$1 ")
    maybe = None
    for w, _, _ in SPLIT_CONTRACTIONS:
        maybe = c.contains(w) if maybe is None else (maybe | c.contains(w))
    return F.when(maybe, split).otherwise(c)


def word_alternation(words: Iterable[str]) -> str:
    """A regex matching exactly the given words, factored as a prefix trie
    (``a(?:bout|bove|...)?``) so a match costs one pass over the word
    instead of one attempt per listed word."""
    trie: dict = {}
    for w in words:
        node = trie
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        end = "" in node
        branches = [re.escape(ch) + emit(child) for ch, child in sorted(node.items()) if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        if end:
            return (body if len(branches) > 1 else "(?:" + body + ")") + "?"
        return body

    return emit(trie)


def letters_of(c: Column | str) -> Column:
    """Lower-cased ASCII letters and white space of a text, contractions split; words are its runs of letters."""
    return _split_contractions(F.regexp_replace(F.lower(_col(c)), _NOT_LOWER_LETTER_OR_SPACE_RUN, ""))


def clean_text(c: Column | str, stopwords: Iterable[str] | None = None) -> Column:
    """lower -> delete everything outside ASCII letters and whitespace ->
    tokenise on whitespace (with the contraction splits) -> drop stop words
    (exact match) -> join with one space. NULL -> "".

    After the letter filter a token is a maximal run of letters, so the
    whole step stays a chain of string rewrites inside generated code:
    whole-token stop words are deleted (a trie-shaped alternation between
    letter-boundary lookarounds), whitespace runs become one space and the
    ends are trimmed. No per-word array or lambda is built. (A single pass
    repeating a group of "stop word or blank" would recurse once per
    repetition in the JVM regex engine and overflow the stack on long
    texts; a repeated character class does not.)
    """
    words = matchable_stopwords(default_stopwords() if stopwords is None else list(stopwords))
    text = letters_of(c)
    if words:
        text = F.regexp_replace(text, rf"(?<![a-z])(?:{word_alternation(words)})(?![a-z])", "")
    return F.coalesce(F.trim(F.regexp_replace(text, r"[\t\n\x0B\f\r ]+", " ")), F.lit(""))


def clean_text_tokens(c: Column | str, stopwords: Iterable[str] | None = None) -> Column:
    """Same result as ``clean_text`` through an explicit token array
    (split -> filter -> join). Kept as the readable reference form; the
    ``filter`` lambda is interpreted per word, so it is the slower one."""
    words = matchable_stopwords(default_stopwords() if stopwords is None else list(stopwords))
    tokens = F.split(letters_of(c), _WHITESPACE_RUN)
    if words:
        kept = F.filter(tokens, lambda w: (w != F.lit("")) & ~w.isin(words))
    else:
        kept = F.filter(tokens, lambda w: w != F.lit(""))
    return F.coalesce(F.array_join(kept, " "), F.lit(""))
