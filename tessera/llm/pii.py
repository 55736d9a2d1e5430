"""Personal data: fixed formats first, then candidate spans scored by gradient boosting.

Base spans (email, ip, card, phone) are found by format and check and always stay. High-recall
generators propose further, overlapping candidates (loose number groups, dotted numbers, mail-like
words, long mixed tokens); boosted trees score their format and context; a candidate is added where
its kind's calibrated threshold selects it and no selected span overlaps it.

The trees are trained here on weak labels from a bounded, hash-chosen sample of documents
(``sample_docs``). No label of an email, ip, card or phone rests on the base format, and no feature
shows it: positive are copies of base spans rewritten in other formats in their own context
(``rewritten``: plus stripped, @ as (at), other separators) and candidates right after a word like
"phone:"; negative are copies made wrong (check digit, range, dates) and candidates that cannot be
of the kind. What could be either is left out. A secret is a random token assigned to a secret's
name. Two thirds of the sample train, one third calibrates the thresholds to ``precision``.
Kinds without positives add nothing.

A null text is empty and has no spans. Rows are judged one by one: repeated rows and ties give equal
results, extra columns do not matter. Every pattern works in linear time on very long texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.boosting import BoostedTrees, calibrated_threshold, fit_boosted_trees
from tessera.llm.common import first_by_hash

Span = tuple[str, int, int]
KINDS = ("email", "ip", "card", "phone", "secret")

# fixed values: the base formats. A number's match can only begin where its digits begin.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# generators of candidates
NUMBERS = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,4}(?:(?:\.|\s?(?:\[\.\]|\(\.\)|\(dot\)|\[dot\])\s?)[0-9]{1,4}){3,}", re.I)
AT = re.compile(r"\(at\)|\[at\]", re.I)
MAILISH = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}\s?(?:\(at\)|\[at\])\s?[\w-]{1,64}(?:(?:\.|\s?(?:\(dot\)|\[dot\])\s?)[\w-]{1,64})+", re.I)
TOKEN = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
SECRET_NAME = re.compile(r"(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|key)\W{0,4}[=:]\W{0,3}$", re.I)
CUES = {"card": re.compile(r"card|visa|credit|carte|karte|tarjeta", re.I), "phone": re.compile(r"phone|tel|call|fax|mobil", re.I),
        "ip": re.compile(r"\bip\b|addr|host|server", re.I), "email": re.compile(r"mail|contact|kontakt", re.I),
        "secret": re.compile(r"token|secret|passw|key|auth|bearer", re.I)}
#: Words that name the kind of what follows at once.
LEADS = {k: re.compile(rf"\b(?:{words})(?:\s?(?:number|address|no|nr))?\W{{1,4}}$", re.I) for k, words in (
    ("email", "e-?mail|mail|contact|kontakt"), ("ip", "ip|host|server"), ("card", "(?:credit|visa)?\\s?card|visa|karte|carte|tarjeta"),
    ("phone", "(?:tele)?phone|tel|telefon|call|fax|mobile?"))}
BEFORE = 24


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost, non-overlapping: for each @, the run of local characters before it and a dotted domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[Span]:
    """Spans (kind, start, end) in code points, by kind as listed, then start."""
    out = list(emails(text))
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of every kind, wide on purpose."""
    out = [("email", *m.span()) for m in MAILISH.finditer(text)] if AT.search(text) else []
    out += [x for x in emails(text)]
    if DIGIT.search(text):
        for m in NUMBERS.finditer(text):
            out += [("card", *m.span()), ("phone", *m.span())]
        out += [("ip", *m.span()) for m in DOTTED.finditer(text)]
    out += [("secret", *m.span()) for m in TOKEN.finditer(text) if not m[0].isdigit()]
    return out


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    s, before, after = text[start:end], text[max(0, start - BEFORE):start], text[end:end + 1]
    n, digits = len(s), digits_of(s)
    counts = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    groups = re.split(r"[^0-9]+", s)
    small = sum(0 < len(g) < 9 and int(g) <= 255 for g in groups)
    return [
        n, len(digits), len(digits) / n, sum(map(str.isalpha, s)) / n, sum(map(str.isupper, s)) / n, entropy,
        sum(c in "0123456789abcdefABCDEF" for c in s) / n, len([g for g in groups if g]), max(map(len, groups)), s.count("."), s.count("-"),
        s.count(" "), s.count("("), s.lower().count("dot"), len(re.split(r"[^\w]+", s)[-1]), 13 <= len(digits) <= 19 and luhn(digits),
        small, len(s.split(".")),
        bool(CUES[kind].search(before)), bool(SECRET_NAME.search(before)), before[-1:] in "\"'" and bool(before), after in ("\"", "'"),
        before[-1:].isalnum(), after.isalnum(), sum(c in "aeiouAEIOU" for c in s) / n,
    ]


def possible(kind: str, s: str) -> bool:
    """Whether the digits of ``s`` can be of this kind, whatever their format."""
    digits, groups = digits_of(s), re.findall("[0-9]+", s)
    return {"email": True, "ip": len(groups) == 4 and all(len(g) < 9 and int(g) <= 255 for g in groups),
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def group_sizes(s: str) -> tuple[int, ...]:
    return tuple(len(g) for g in re.findall("[0-9]+", s))


def rewritten(kind: str, s: str, words: list[str]) -> list[tuple[str, bool]]:
    """Copies of a base span in formats beyond the base, True; and look-alikes that are wrong, False.

    ``words``: words near the span, for sentences that only look like an address.
    """
    if kind == "email":
        local, _, domain = s.partition("@")
        plain = re.sub("[^A-Za-z]+", "", local) or "x"
        short = ".".join(domain.split(".")[-2:])
        ends = [w for w in words if len(w) >= 5]
        return [(f"{a}{at}{d.replace('.', dot)}", True) for a in dict.fromkeys((local, plain)) for d in dict.fromkeys((domain, short))
                for at, dot in ((" (at) ", " (dot) "), ("(at)", "."), (" [at] ", "[dot]"), (" (at) ", "."))
                ] + [(f"{a} (at) {b}.{c}", False) for a, b, c in zip(words, words[1:], ends)][:8]
    if kind == "ip":
        g = [x.lstrip("0") or "0" for x in s.split(".")]
        wrong = [[*g, "7"], *([*g[:k], str(int(g[k]) + 256), *g[k + 1:]] for k in range(4))]
        return [(sep.join(x), x is g) for x in (g, *wrong) for sep in ("[.]", "(.)", "[dot]", " (dot) ")] + [(f"{'.'.join(g[:3])}[.]{g[3]}", True)]
    if kind == "card":
        d = digits_of(s)
        wrong = d[:-1] + str((int(d[-1]) + 5) % 10)
        return [(sep.join(re.findall("[0-9]{1,4}", x)), x is d) for x in (d, wrong) for sep in (".", "  ", ". ", "--")]
    g = re.findall("[0-9]+", s)
    forms = [s[1:], "00" + s[1:], *(sep.join(x) for x in (g, g[1:]) if len(x) > 1 for sep in (" ", "-", ".")), *([f"({g[1]}) {'-'.join(g[2:])}"] if len(g) > 3 else [])]
    n = int("".join(g))
    year, month, day = 1900 + n % 200, 1 + n % 12, 1 + n % 28
    wrong = [f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{year}-{month:02}-{day:02} {n % 24:02}", f"{n % 10**8:,}".replace(",", "."), "-".join([*g, *g])]
    return [(x, True) for x in forms if possible("phone", x)] + [(x, False) for x in wrong]


def weak_label(text: str, span: Span, shapes: set[tuple[int, ...]]) -> bool | None:
    """The label that training uses for a candidate of the sample that is no base span; None if it could be either.

    ``shapes``: sizes of the digit groups of rewritten phones; others without a leading word count as plain numbers.
    """
    kind, start, end = span
    s, before = text[start:end], text[max(0, start - BEFORE):start]
    if kind == "secret":
        return bool(SECRET_NAME.search(before)) and len(set(s)) >= 10
    if not possible(kind, s):
        return False
    if LEADS[kind].search(before):
        return True
    return False if kind == "phone" and group_sizes(s) not in shapes else None


def labelled(text: str, shapes: set[tuple[int, ...]]) -> Iterator[tuple[Span, int, list[float], bool]]:
    """(span, number of its family, features, label) of the training cases in ``text``; copies of one span are one family."""
    base = base_spans(text)
    for k, c in enumerate(dict.fromkeys(candidates(text))):
        if c[0] == "secret" or all(c[2] <= s or e <= c[1] for _, s, e in base):
            if (label := weak_label(text, c, shapes)) is not None:
                yield c, k, features(text, c), label
    for k, (kind, start, end) in enumerate(base):
        left, right = text[max(0, start - 4 * BEFORE):start], text[end:end + 4 * BEFORE]
        copies = [(left, *x) for x in rewritten(kind, text[start:end], re.findall(r"[^\W\d_]+", left + " " + right))]
        if kind == "phone":  # after a leading word any grouping will do
            d = digits_of(text[start:end])
            copies += [(left + lead, x, True) for lead in (" phone: ", " tel. ") for x in (d[-9:], f"{d[:3]} {d[3:]}", f"{d[:4]} {d[4:7]} {d[7:]}")]
            copies += [(f"{b} phone: ", x, False) for b, x, label in copies if not label]
        for before, copy, label in copies:
            near, place = before + copy + right, (len(before), len(before) + len(copy))
            taken = [x[1:] for x in base_spans(near)]
            for c in dict.fromkeys(candidates(near)):
                if c[1:] == place and c[0] != "secret" and all(c[2] <= s or e <= c[1] for s, e in taken):
                    if c[0] == kind or not possible(c[0], copy):
                        yield c, -1 - k, features(near, c), label and c[0] == kind


@dataclass
class SpanModel:
    """Trees and calibrated thresholds by kind."""

    trees: dict[str, BoostedTrees] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans); both by kind, then start."""
        base = base_spans(text)
        by_kind: dict[str, list[Span]] = {}
        for c in dict.fromkeys(candidates(text)):
            if c[0] in self.trees and all(c[2] <= s or e <= c[1] for _, s, e in base):
                by_kind.setdefault(c[0], []).append(c)
        scored = []
        for kind, found in by_kind.items():
            prob = self.trees[kind].probabilities(np.array([features(text, c) for c in found], float))
            scored += [(-p, c) for p, c in zip(prob, found) if p >= self.thresholds[kind]]
        taken = sorted((s, e) for _, s, e in base)
        added: list[Span] = []
        for _, c in sorted(scored):
            if all(c[2] <= s or e <= c[1] for s, e in taken):
                taken.append(c[1:])
                added.append(c)
        return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), *x[1:]))


def train(docs: DataFrame, sample_docs: int = 3000, per_kind: int = 4000, precision: float = 0.98) -> SpanModel:
    """Fit on the candidates of ``sample_docs`` distinct texts at most, the first by a hash of their text.

    Only documents with a digit or an @ can hold candidates worth learning from, so the sample is
    drawn from those, and of those of at most 20,000 characters (longer texts are searched like any other, but
    teach nothing); at most ``per_kind`` candidates of a kind are used. Both bounds keep the
    training set on the driver small at any input size; thresholds come from the held-out third.
    """
    rows = first_by_hash(docs.select("text").where(F.length("text") <= 20_000).where(F.col("text").rlike("[0-9@]")), ["text"], sample_docs).collect()
    shapes = {group_sizes(copy) for row in rows for kind, start, end in base_spans(row.text) if kind == "phone"
              for copy, label in rewritten(kind, row.text[start:end], []) if label}
    data: dict[str, list[tuple[list[float], bool, int]]] = {k: [] for k in KINDS}
    families: dict[str, dict[tuple[int, int], int]] = {k: {} for k in KINDS}
    for n, row in enumerate(rows):
        for c, family, found, label in labelled(row.text, shapes):
            if len(data[c[0]]) < per_kind:
                data[c[0]].append((found, label, families[c[0]].setdefault((n, family), len(families[c[0]]))))
    model = SpanModel()
    for kind, found in data.items():
        x, y = np.array([f for f, _, _ in found], float), np.array([t for _, t, _ in found], float)
        held = np.array([g % 3 == 0 for _, _, g in found], bool)  # copies of one span stay on one side
        if len(y) < 12 or not 0 < y[~held].sum() < len(y[~held]):
            continue
        trees = fit_boosted_trees(x[~held], y[~held])
        threshold = calibrated_threshold(trees.probabilities(x[held]), y[held], precision)
        if threshold is not None:
            model.trees[kind], model.thresholds[kind] = trees, threshold
    return model


SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPAN_SQL = "array<struct<kind:string,start:bigint,end:bigint>>"


def find_spans(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """Every row with ``base_spans`` and ``spans``, arrays of (kind, start, end)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # trees of a fixed size

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.spans(t or "") for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            as_rows = lambda k: pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f[k]] for f in found], SPAN_ARROW)
            yield pa.RecordBatch.from_arrays([*b.columns, as_rows(0), as_rows(1)], names=[*b.schema.names, "base_spans", "spans"])

    rest = docs.drop("base_spans", "spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + f", base_spans {SPAN_SQL}, spans {SPAN_SQL}"
    return rest.mapInArrow(find, schema)


def redact(text: str, spans: list, mark: Callable[[str], str] = lambda kind: f"<{kind.upper()}>") -> str:
    """``text`` with every span replaced; overlapping spans become one mark, that of the first."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at:s["start"]], mark(s["kind"])]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: SpanModel) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` (a null text stays null); same columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index("text")
            out = [t and redact(t, [dict(zip(("kind", "start", "end"), s)) for s in sent.value.spans(t)[1]]) for t in b.column(k).to_pylist()]
            yield b.set_column(k, "text", pa.array(out, b.schema.field(k).type))

    return docs.mapInArrow(clean, docs.schema)
