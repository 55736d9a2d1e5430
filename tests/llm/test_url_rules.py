"""Mined URL rules: brute force, independence of other labels and of the table's size, long URLs, redundant rules."""

import itertools
import random

import pytest

from conftest import SF001, SF01
from tessera.llm import catalog, url_filter
from tessera.sources.tables import load_table

PAGES, LABELS = "page_id long, url string", "doc_id long, quality int, toxic int"


def site(seed, n=120):
    rng = random.Random(seed)
    pages, labels = [], []
    for k in range(n):
        host = rng.choice(["shop", "blog", "casino"]) + rng.choice([".a", ".b"]) + ".net"
        pages.append((k, f"http://{host}/{rng.choice(['win', 'news', 'x'])}/{k}?{rng.choice(['ref', 'page'])}=1"))
        if rng.random() < 0.7:
            bad = rng.random() < (0.9 if "casino" in host else 0.15)
            labels.append((k, int(not bad), 0))
    return pages, labels


def tokens(url):
    host, _, rest = url.removeprefix("http://").partition("/")
    path, _, query = rest.partition("?")
    return sorted({*("h:" + x for x in host.split(".")), *("p:" + ("#" if x.isdigit() else x) for x in path.split("/") if x), "q:" + query.split("=")[0]})


def brute(pages, labels, min_bad=3, confidence=0.5):
    bad = {d: q == 0 or t == 1 for d, q, t in labels}
    known = [(set(tokens(u)), bad[k]) for k, u in pages if k in bad]
    sets = {c for t, b in known if b for r in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), r)}
    rules = []
    for s in sets:
        held = [b for t, b in known if t >= set(s)]
        if sum(held) >= min_bad and sum(held) >= confidence * len(held):
            rules.append(s)
    return {s for s in rules if not any(set(o) < set(s) for o in rules)}


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_equal_brute_force(spark, seed):
    pages, labels = site(seed)
    known = url_filter.labelled_pages(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS))
    want = brute(pages, labels)
    assert {tuple(r.tokens) for r in url_filter.mine_rules(known).collect()} == want and want
    out = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS), []).collect()}
    assert out == {k: "block" if any(set(s) <= set(tokens(u)) for s in want) else "allow" for k, u in pages}


def test_unrelated_labels_change_no_verdict(spark):
    pages, labels = site(3)
    more = [(1000 + k, f"http://other{k % 7}.org/t{k % 11}") for k in range(900)]
    verdicts = lambda p, x: {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(p, PAGES), spark.createDataFrame(x, LABELS), []).collect()}
    before = verdicts(pages, labels)
    after = verdicts(pages + more, labels + [(d, 1, 0) for d, _ in more[:700]])
    assert {k: after[k] for k in before} == before and "block" in before.values()


@pytest.mark.parametrize("folder", [SF001, SF01, "/root/testdata/sf0.1"])
def test_rules_and_blocks_at_every_size(spark, folder):
    pages, labels = load_table(spark, folder, "pages"), load_table(spark, folder, "labels")
    assert url_filter.mine_rules(url_filter.labelled_pages(pages, labels)).count() > 0
    assert url_filter.judge_urls(pages, labels, []).where("verdict = 'block'").count() > 0


def test_long_urls_and_nulls(spark):
    long = "http://farm.net/" + "/".join(f"w{k}" for k in range(80))
    pages = [(k, f"{long}/{k}") for k in range(6)] + [(10 + k, f"http://ok.net/v{k}") for k in range(20)] + [(50, None), (50, None), (51, "x"), (None, long)]
    labels = [(k, 0, 0) for k in range(5)] + [(10 + k, 1, 0) for k in range(20)] + [(50, 0, 0), (None, 0, 0)]
    out = url_filter.judge_urls(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS), []).collect()
    assert len(out) == len(pages)
    assert all(r.verdict == ("block" if r.host == "farm.net" else "allow") for r in out)
    none = url_filter.judge_urls(spark.createDataFrame([], PAGES), spark.createDataFrame(labels, LABELS), catalog.URL_RULES)
    assert none.count() == 0


def test_no_token_of_a_long_url_is_left_out(spark):
    # w0..w12 are in more pages than the token that tells bad pages apart: that one is the 13th and later of its pages
    common = "/".join(f"w{k}" for k in range(13))
    pages = [(k, f"http://a.net/{common}/win/pair/{k}") for k in range(4)] + [(10 + k, f"http://a.net/{common}/{k}") for k in range(20)]
    pages += [(40 + k, f"http://a.net/{common}/{w}/{k}") for w, f in (("win", 0), ("pair", 9)) for k in range(f, f + 6)] + [(90, "http://b.net/pair/win"), (91, "http://b.net/win")]
    labels = [(k, 0, 0) for k in range(4)] + [(p, 1, 0) for p, _ in pages[4:-2]] + [(11, 0, 0), (12, 0, 0)]
    out = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS), []).collect()}
    assert out == {p: "block" if p < 4 or p == 90 else "allow" for p, _ in pages}


@pytest.mark.parametrize("seed", [1, 4])
def test_level_by_level_equals_brute_force(spark, seed):
    pages, labels = site(seed)
    known = url_filter.labelled_pages(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS))
    rules = url_filter.level_rules(known, 3, 0.5)
    assert {tuple(r.tokens) for r in rules.collect()} == brute(pages, labels)
    assert rows(rules) == rows(url_filter.mine_rules(known))


def rows(rules):
    return sorted((tuple(r.tokens), r.n_bad, r.n_all) for r in rules.collect())
