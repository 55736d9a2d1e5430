"""SQL (DuckDB dialect) equivalents of the feature expressions, for the oracle.

These build SQL *text* for the cross-check only; Spark never parses them.
Regex classes are spelled out so Java and RE2 read them the same way
(RE2's ``\\s`` lacks vertical tab, so whitespace is written as a class).
"""

from __future__ import annotations

from collections.abc import Iterable

from tessera.functions.lexicon import SPLIT_CONTRACTIONS, default_stopwords

WS = r"\t\n\x0b\f\r "


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words: Iterable[str]) -> str:
    return "[" + ", ".join(sql_str(w) for w in words) + "]"


def length(c: str) -> str:
    return f"CAST(length({c}) AS INT)"


def word_count(c: str) -> str:
    return f"CAST(len(string_split({c}, ' ')) AS INT)"


def ratio(a: str, b: str) -> str:
    return f"(({a}) / (({b}) + 1))"


def exclamation_count(c: str) -> str:
    return f"CAST(len(string_split({c}, '!')) - 1 AS INT)"


def question_count(c: str) -> str:
    return f"CAST(length({c}) - length(replace({c}, '?', '')) AS INT)"


def caps_ratio(c: str) -> str:
    return f"(length(regexp_replace({c}, '[^A-Z]', '', 'g')) / (length({c}) + 1))"


def digit_count(c: str) -> str:
    return f"CAST(length(regexp_replace({c}, '[^0-9]', '', 'g')) AS INT)"


def special_char_count(c: str) -> str:
    cls = r"[\p{L}\p{N}\p{Z}\x09-\x0d\x1c-\x1f\x85]"
    return f"CAST(coalesce(length(regexp_replace({c}, '{cls}', '', 'g')), 0) AS INT)"


def has_url(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, 'http[s]?://') THEN 1 ELSE 0 END"


def keyword_hits(cols: Iterable[str], keywords: Iterable[str]) -> str:
    lowered = [f"coalesce(lower({c}), '')" for c in cols]
    terms = [f"CAST(contains({x}, {sql_str(k)}) AS INT)" for k in keywords for x in lowered]
    return "CAST(" + (" + ".join(terms) or "0") + " AS INT)"


def clean_text(c: str, stopwords: Iterable[str] | None = None) -> str:
    words = default_stopwords() if stopwords is None else list(stopwords)  # the raw list: the oracle shares no list handling
    y = f"regexp_replace(lower({c}), '[^a-zA-Z{WS}]', '', 'g')"
    for whole, head, tail in SPLIT_CONTRACTIONS:
        y = f"regexp_replace({y}, '\\b{whole}\\b', '{head} {tail}', 'g')"
    cond = "w <> ''"
    if words:
        cond += f" AND NOT list_contains({sql_list(words)}, w)"
    return (f"coalesce(array_to_string(list_filter(regexp_split_to_array({y}, '[{WS}]+'), "
            f"lambda w: {cond}), ' '), '')")
