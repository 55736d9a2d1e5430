"""Texts that once ended a job or took quadratic time, through the registered operators' own code."""

import random
import struct
import time
from itertools import zip_longest

import pytest

from tessera.llm import catalog, html_text, packing, pii
from tessera.llm.common import first_by_hash, ship_package


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def test_packing_of_very_long_blank_runs(spark):
    path = catalog.tokenizer_path()
    texts = ["x" + "\n" * 1_000_000 + "y", "a" + " " * 900_000, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in packing.pack_documents(docs, path).collect():
        got.setdefault(r.doc_id, {})[r.start] = bytes(r.ids)
        assert 0 < r.length <= 2048 and r.offset + r.length <= 2048
    slow = packing.encoder(path).slow
    for k, t in enumerate(texts):
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 1]
        assert b"".join(got[k][s] for s in sorted(got[k])) == struct.pack(f"<{len(ids)}I", *ids)


def test_registered_packing_query(spark, tmp_path):
    """ids_crc32, lengths of 2048 and gapless offsets of the query itself."""
    import zlib
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "1"]) for _ in range(rng.choice([0, 5, 900, 5000]))) for _ in range(40)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.QUERIES["op1_packing"](spark, str(tmp_path)).collect()
    slow = packing.encoder(catalog.tokenizer_path()).slow
    ids = {k: [*slow.encode(t, add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    seen, fill = {k: 0 for k in ids}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        seen[r.doc_id] += len(part)
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {k: len(v) for k, v in ids.items()}
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert any(r.length == 2048 for r in rows)
    assert sum(seen.values()) >= 0.95 * 2048 * (len(fill) - 1)


def test_personal_data_in_very_long_digit_runs(spark):
    zeros = "0" * 5000
    texts = [zeros + "1.2.3.4", "1" * 5000 + ".2.3.4", f"a@{zeros}.com", "+" + "1" * 6000, zeros + "." + zeros + ".0." + zeros + "255", None, ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 3)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_spans(docs, pii.train(docs)).collect()}
    base = lambda k: [(s.kind, s.start, s.end) for s in rows[k].base_spans]
    assert base(0) == [("ip", 0, 5007)] and base(1) == [] and base(2) == [("email", 0, 5006)] and base(3) == [] and base(5) == base(6) == []
    assert base(4) == [("ip", 0, len(texts[4]))]
    assert {t for _, t in pii.rewritten("ip", zeros + "1.2.3.4", [])} == {True, False}


def test_first_by_hash_is_small_and_without_copies(spark):
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, 'copy', cast(id as string)) as text").repartition(7)
    got = [r.text for r in first_by_hash(rows, ["text"], 500).collect()]
    assert len(got) == len(set(got)) == 500
    again = [r.text for r in first_by_hash(rows.repartition(2), ["text"], 500).collect()]
    assert got == again
    assert first_by_hash(rows.limit(0), ["text"], 5).count() == 0
    assert first_by_hash(rows, ["text"], 50_000).count() == 20_001


# -- pages

text = lambda page: html_text.html_to_text(page)[1]


def test_numbers_of_lists():
    assert text("<ol start=" + "9" * 5000 + "><li>a</ol>") == "1. a"
    assert text("<ol start=-2><li>a<li>b<li value=7>c<li>d</ol>") == "-2. a\n-1. b\n7. c\n8. d"
    assert text("<ol start=x><li value=>a</ol><ol start='+4'><li>b</ol>").split() == ["1.", "a", "4.", "b"]


@pytest.mark.parametrize("page", [
    "<a " * 100_000, "<b>" * 100_000 + "<hr>" * 100_000, '<a "' * 100_000 + ">", "<script>" + "</script " * 100_000, "<b>" * 100_000 + "</i>" * 100_000,
    "<p><button>" + "<b>" * 100_000 + "<hr>" * 100_000, "<table>" * 30_000, "<table><tr>" + "<td rowspan=60000 colspan=1000>x" * 2000, "<!--" * 100_000,
    "<ul>" + "<li>" * 100_000, "<dl>" + "<dt><b><dd>" * 50_000, "<svg>" * 50_000 + "<text>" * 50_000])
def test_time_of_hostile_pages(page):
    begun = time.time()
    html_text.html_to_text(page)
    assert time.time() - begun < 30


def test_inherited_visibility_svg_and_buttons():
    assert text('<div style="visibility:hidden">a<b style="visibility:visible">B</b>c<i style="visibility:inherit">d</i></div>e') == "B\ne"
    assert text('<div style="display:none">a<b style="visibility:visible">B</b></div>e') == "e"
    assert text("<svg><title>no</title><g><text>one <tspan>two</tspan></text></g><defs><text>no</text></defs></svg>") == "one two"
    assert text("<input type=submit value=Go> <input type=reset> <input value=secret>") == "Go Reset"
    assert text("<details><summary>S</summary>body</details><details open><summary>T</summary>in</details>") == "S\nT\nin"
    assert text("<dialog>no</dialog><dialog open>yes</dialog>") == "yes"


def test_spans_and_nested_tables():
    page = "<table><tr><td>a<td>b<td>c<tr><td colspan=2>wide<td>z<tr><td rowspan=2>r<td>s<td>t<tr><td>u<td>v</table>"
    assert text(page) == "a | b | c\nwide  | z\nr | s | t\n  | u | v"
    nested = "<table><tr><td>left<td><table><tr><td>1<td>2<tr><td>333<td>4</table><td>right</table>"
    assert text(nested) == "left | 1   | 2 | right\n     | 333 | 4 |"


def holds_table(nodes):
    return any(not isinstance(n, str) and (n[0] == "table" or holds_table(n[1])) for n in nodes)


def plain_layout(tree):
    """(lines) of a tree of ("div", children), ("table", rows of cells) and strings, written without the renderer's flows."""
    lines, inline = [], ""
    kind, children = tree
    for c in children:
        if isinstance(c, str):
            inline = " ".join(x for x in (inline, c) if x)
            continue
        if inline:
            lines.append(inline)
            inline = ""
        if c[0] == "div":
            lines += plain_layout(c)
        else:
            grid = [[plain_layout(("div", cell)) for cell in row] for row in c[1]]
            flat = [[x if holds_table(cell) else [" ".join(x)] for x, cell in zip(r, row)] for r, row in zip(grid, c[1])]
            wide = [max((len(line) for r in flat if k < len(r) for line in r[k]), default=0) for k in range(max(map(len, flat)))]
            for r in flat:
                if any(line for cell in r for line in cell):
                    for parts in zip_longest(*r, fillvalue=""):
                        lines.append(" | ".join(x.ljust(wide[k]) for k, x in enumerate(parts)).rstrip())
    if inline:
        lines.append(inline)
    return [x for x in lines if x.strip()]


def as_html(node):
    if isinstance(node, str):
        return f" {node} "
    kind, children = node
    if kind == "div":
        return "<div>" + "".join(map(as_html, children)) + "</div>"
    return "<table>" + "".join("<tr>" + "".join("<td>" + "".join(map(as_html, cell)) + "</td>" for cell in row) + "</tr>" for row in children) + "</table>"


def random_tree(rng, depth):
    def children(d):
        out = []
        for _ in range(rng.randint(1, 3)):
            what = rng.random()
            if d == 0 or what < 0.5:
                out.append(rng.choice(["aa", "b", "cccc", "dd ee"]))
            elif what < 0.75:
                out.append(("div", children(d - 1)))
            else:
                out.append(("table", [[children(d - 1) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))]))
        return out
    return ("div", children(depth))


def test_layout_of_random_trees():
    rng = random.Random(6)
    for _ in range(300):
        tree = random_tree(rng, 3)
        assert [x for x in text(as_html(tree)).split("\n") if x.strip()] == plain_layout(tree), as_html(tree)
