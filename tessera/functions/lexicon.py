"""Word lists used by the article features.

Both lists are parameters of the feature functions; these are only defaults.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# Default "fake news" keywords counted by ``keyword_hits`` (lower case; a hit
# is a substring match, once per keyword and per column).
DEFAULT_KEYWORDS = ["breaking", "urgent", "exclusive", "shocking", "leaked", "exposed", "viral"]

# Word pieces the Penn-Treebank tokeniser splits without an apostrophe:
# (whole word, first piece, second piece).
SPLIT_CONTRACTIONS = [
    ("cannot", "can", "not"),
    ("gimme", "gim", "me"),
    ("gonna", "gon", "na"),
    ("gotta", "got", "ta"),
    ("lemme", "lem", "me"),
    ("wanna", "wan", "na"),
]

# English stop words as shipped with Spark ML
# (pyspark.ml.feature.StopWordsRemover.loadDefaultStopWords("english")),
# in the order Spark lists them; a test checks the two stay equal.
SPARK_ENGLISH_STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for",
    "with", "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd",
    "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're",
    "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't", "weren't",
    "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't",
    "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's", "how's", "let's",
    "ought", "that's", "there's", "what's", "when's", "where's", "who's", "why's", "would",
]
# ---------------------------------------------------------------------------


def default_stopwords() -> list[str]:
    """De-duplicated default stop-word list (order kept)."""
    return list(dict.fromkeys(SPARK_ENGLISH_STOPWORDS))


def matchable_stopwords(stopwords: list[str]) -> list[str]:
    """Stop words that can still occur after the ASCII-letter filter.

    Cleaning deletes every character outside ``[a-zA-Z\\s]`` before the
    stop-word test, so words with an apostrophe (or any other such
    character) can never match; dropping them keeps the literal set small.
    """
    import re

    keep = re.compile(r"^[a-z]+$")
    return [w for w in dict.fromkeys(stopwords) if keep.match(w)]
