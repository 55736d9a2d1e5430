"""Ranked search, quality classifier and spelling variants: brute force on small rows, odd rows, empty tables, held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from tessera.llm import catalog, discriminant, lexical, spelling
from tessera.llm.common import ship_package
from tessera.sources.tables import load_table

DOCS = "doc_id long, text string, score string, word string, id string, n long"
ITEMS = "item_id long, text string, doc_id string, rank string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def frame(spark, rows, schema=DOCS, parts=3):
    more = len(schema.split(",")) - 2
    clash = [0 if c.strip().endswith("long") else "clash" for c in schema.split(",")[2:]]
    return spark.createDataFrame([(*r, *clash[:more]) for r in rows], schema).repartition(parts)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- ranked search

def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def ranked(docs, items, k=10):
    words = [(d, terms_of(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    counted = [(d, len(w), Counter(w)) for d, w in words if w]
    df = Counter(t for _, _, c in counted for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, n, c in counted:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                    for t in terms_of(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def search_rows(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" if k % 5 else f"Ñw{k}" for k in range(120)]
    weights = [1 / (k + 1) for k in range(120)]
    docs = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 3, 20, 60, 200])))) for k in range(n)]
    docs += [(4, docs[4][1]), (900, docs[7][1]), (901, None), (902, ""), (903, "?! --"), (None, docs[9][1]), (904, "W1, w2;W1 " * 4000)]
    items = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 4, 12, 30])))) for k in range(25)]
    items += [(3, items[3][1]), (3, "w7 W7 w8"), (50, None), (51, ""), (52, "nowhere"), (None, "w1 w30")]
    return docs, items


@pytest.mark.parametrize("shard_bytes", [500, 20_000, 4 << 20])
def test_search_equals_scoring_every_document(spark, shard_bytes):
    docs, items = search_rows(shard_bytes)
    got = lexical.ranked_search(frame(spark, docs), frame(spark, items, ITEMS, 2), shard_bytes=shard_bytes).collect()
    assert sorted(map(tuple, got), key=repr) == ranked(docs, items)


def test_search_in_blocks_of_items(spark):
    docs, items = search_rows(5, 80)
    n_docs, n_terms = lexical.corpus_figures(frame(spark, docs))
    index = lexical.build_index(frame(spark, docs), n_docs, n_terms, 2000)
    got = lexical.search(index, n_docs, frame(spark, items, ITEMS, 2), k=3, block_bytes=300).collect()
    assert sorted(map(tuple, got), key=repr) == ranked(docs, items, 3)


def test_search_of_empty_tables(spark):
    docs, items = search_rows(1, 20)
    assert lexical.ranked_search(frame(spark, []), frame(spark, items, ITEMS)).count() == 0
    assert lexical.ranked_search(frame(spark, docs), frame(spark, [], ITEMS)).count() == 0
    assert lexical.ranked_search(frame(spark, []), frame(spark, [], ITEMS)).count() == 0


def test_block_maxima_spare_blocks():
    """Strong lists set the threshold; blocks of common terms are then left packed, and the result stays exact."""
    rng = random.Random(2)
    texts = [(" ".join(rng.choices("abcdefgh", k=rng.randint(4, 30))) + (" rare" * rng.randint(1, 3) if k % 97 == 0 else "")).encode() for k in range(6000)]
    words = [t.split() for t in texts]
    row = lexical.shard_row(list(range(6000)), texts, 6000, sum(map(len, words)))
    shard = lexical.Shard(dict(zip(lexical.INDEX.names, row)))
    df = Counter(t for w in words for t in set(w))
    query = {t: math.floor(1000 * math.log(12002 / (2 * df[t] + 1))) for t in (b"rare", b"a", b"b", b"c")}
    best = lexical.Best(10, np.zeros(0, np.int64), np.zeros(0, np.int64))
    lexical.search_shard(shard, query, best)
    first = shard.decoded
    again = lexical.Best(10, best.scores.copy(), best.ids.copy() + 10_000)
    lexical.search_shard(shard, query, again)
    assert shard.decoded - first < first / 4
    norms = lexical.length_norms([len(w) for w in words], 6000, sum(map(len, words)))
    scores = sorted(((-sum(c * (1000000000 * w.count(t) // (1000 * w.count(t) + 8 * int(m))) for t, c in query.items() if t in w), k)
                     for k, (w, m) in enumerate(zip(words, norms))))[:10]
    assert [(-s, k) for s, k in scores] == list(zip(best.scores.tolist(), best.ids.tolist()))


def test_packing_of_blocks_round_trips():
    rng = random.Random(3)
    texts = [b"x"] * 70_000 + [b"big " * 70_000, b"big x " * 300]
    rng.shuffle(texts)
    row = lexical.shard_row(list(range(len(texts))), texts, len(texts), 100_000)
    shard = lexical.Shard(dict(zip(lexical.INDEX.names, row)))
    for term in (b"x", b"big"):
        t = shard.number[term]
        doc, impact = shard.postings(np.arange(shard.of_term[t], shard.of_term[t + 1]))
        want = [(k, x.split().count(term)) for k, x in enumerate(texts) if term in x]
        assert doc.tolist() == [k for k, _ in want]
        assert impact.tolist() == lexical.impacts(np.array([n for _, n in want]), shard.norms[doc]).tolist()


# -- quality classifier

def test_classifier_on_held_out_labels(spark):
    got = catalog.QUERIES["op12_quality_classifier"](spark, SF01)
    labels = load_table(spark, SF01, "labels").select("doc_id", "quality")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) >= 50
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    assert right >= 0.95
    ones, zeros = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert sum(a > b for a in ones for b in zeros) >= 0.97 * len(ones) * len(zeros)
    for r in got.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def quality_rows(n=400):
    rng = random.Random(4)
    clean = lambda: " ".join(rng.choice(["stone", "river", "of", "the", "house", "green", "walks"]) for _ in range(rng.randint(5, 80))) + "."
    junk = lambda: " ".join(rng.choice(["BUY!!", "$$$", "x###", "NOW!!", "||"]) for _ in range(rng.randint(5, 80)))
    docs = [(k, clean() if k % 3 else junk()) for k in range(n)]
    return docs, [(k, int(k % 3 > 0), 0) for k in range(n)]


def test_classifier_ignores_held_out_labels_and_odd_rows(spark):
    docs, labels = quality_rows()
    odd = [(1000, None), (1001, ""), (None, docs[1][1]), (2, docs[2][1]), (1002, "é" * 100_000), (1003, "\x00 \n\n")]
    schema = "doc_id long, quality int, toxic int"
    base = discriminant.score_quality(frame(spark, docs + odd), spark.createDataFrame(labels, schema))
    want = {(r.doc_id, r.score, r.predicted) for r in base.collect()}
    assert base.count() == len(docs) + len(odd)
    assert sum(p == (d % 3 > 0) for d, _, p in want if d is not None and d < 400) >= 396
    out = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    turned = [(d, 1 - q if out(d) else q, t) for d, q, t in labels] + [(1000, None, 0), (None, 1, 0), (1003, 0, 0), (1003, 1, 0)]
    again = discriminant.score_quality(frame(spark, docs + odd, parts=2), spark.createDataFrame(turned, schema))
    close = lambda rows: sorted((str(d), round(s, 4), p) for d, s, p in rows)
    assert close((r.doc_id, r.score, r.predicted) for r in again.collect()) == close((r.doc_id, r.score, r.predicted) for r in base.collect())
    by = {r.doc_id: r.score for r in base.collect()}
    assert by[None] == by[1] and by[1000] == by[1001]


@pytest.mark.parametrize("classes", [(), (1,), (0,)])
def test_classifier_without_both_classes(spark, classes):
    docs, labels = quality_rows(60)
    rows = [x for x in labels if x[1] in classes]
    got = discriminant.score_quality(frame(spark, docs), spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 60 and len({r.score for r in got}) == 1
    assert got[0].score == 0.5 if not classes else (got[0].score > 0.5) == (classes == (1,))


def test_classifier_of_an_empty_table(spark):
    _, labels = quality_rows(20)
    assert discriminant.score_quality(frame(spark, []), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_discriminant_scores_equal_log_densities():
    rng = np.random.default_rng(1)
    p = len(discriminant.STATISTICS)
    x = [rng.normal(c, 1 + c, (300, p)) for c in (0, 1)]
    sums = {c: (300, x[c].sum(0), x[c].T @ x[c]) for c in (0, 1)}
    model = discriminant.discriminant(sums, 0.0, 0.0)
    few = p / (p + 300)
    pooled = sum(np.cov(v.T, bias=True) for v in x) / 2
    at = rng.normal(0, 2, (20, p))
    logs = []
    for v in x:
        c = (1 - few) * np.cov(v.T, bias=True) + few * pooled
        c = (1 - few) * c + few * np.diag(np.diag(pooled)) + 1e-6 * np.eye(p)
        d = at - v.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(model.differences(at), logs[1] - logs[0])


# -- spelling variants

def variants(docs, every=199, least_length=6, least=5, times=5):
    counts = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least}
    alphabet = sorted(set("".join(words)))

    def near(w):
        made = {w[:i] + w[i + 1:] for i in range(len(w))}
        made |= {w[:i] + a + w[i + 1:] for i in range(len(w)) for a in alphabet} | {w[:i] + a + w[i:] for i in range(len(w) + 1) for a in alphabet}
        return [x for x in made if x != w and x in words]

    form = {}
    for w, n in words.items():
        best = min(near(w), key=lambda u: (-words[u], u), default=None)
        form[w] = best if best and words[best] >= times * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near(w)), words[form[w]] if form[w] else None) for w, n in words.items()}


def spelled(seed):
    rng = random.Random(seed)
    base = ["aabbcc", "aabbccd", "letters", "setting", "êtrange", "ÊTRANGE", "balloon", "zzzzzz", "zzzzzzz"]
    docs = []
    for k in range(200):
        words = []
        for w in rng.choices(base, [40, 9, 30, 8, 20, 4, 25, 30, 3], k=40):
            if rng.random() < 0.3:
                i, a = rng.randrange(len(w)), rng.choice("abzé")
                w = rng.choice([w[:i] + w[i + 1:], w[:i] + a + w[i:], w[:i] + a + w[i + 1:]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((k, rng.choice([" ", "-", "\n", "1"]).join(words)))
    return docs + [(1, docs[1][1]), (None, docs[2][1]), (300, None), (301, ""), (302, "123 $ ._"), (303, "balloon " * 20_000), (304, "q" * 50_000)]


@pytest.mark.parametrize("every", [199, 3, None])
def test_variants_equal_brute_force(spark, every):
    docs = spelled(every or 0)
    got = [tuple(r) for r in spelling.spelling_variants(frame(spark, docs), drop_every=every).collect()]
    assert len(got) == len(set(got)) and set(got) == variants(docs, every)


def test_chains_of_forms_reach_their_root(spark):
    chain = ["aaaaaab", "aaaaaabc", "aaaaaabcd", "aaaaaabcde", "aaaaaabcdef"]
    docs = [(k, " ".join([w] * 5 ** (k + 1))) for k, w in enumerate(chain)]
    got = {r.word: r for r in spelling.spelling_variants(frame(spark, docs), drop_every=None).collect()}
    assert [got[w].root for w in chain] == [chain[-1]] * 5 and got[chain[0]].form == chain[1]


def test_variants_of_empty_and_short_tables(spark):
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
    assert spelling.spelling_variants(frame(spark, [(1, "one two")])).count() == 0


def test_prefix_ranges_hold_one_word_a_character(spark):
    words = spark.createDataFrame([(w, 5) for w in ("letter", "better", "etter", "lettter")], "word string, n long")
    ranges = spelling.rotations(words).groupBy("prefix").agg(F.collect_list("skipped").alias("s")).collect()
    assert all(len(r.s) == len(set(r.s)) for r in ranges)
    assert sorted(next(r.s for r in ranges if r.prefix == "etter$")) == ["", "b", "l"]
