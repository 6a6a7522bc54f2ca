"""Operators 11 to 13 against brute force and SQL: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pytest
from oracle import compare

from vettra.llm import html_extraction, merkle_manifest, periodic_runs, queries

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
DOCS = [
    (i, t, s, g, n)
    for i, (t, s, g, n) in enumerate(
        [(None, None, None, None), ("", "", "", 0), ("Ä b C", "x", "en", 5), (LONG, "x", "en", len(LONG)), ("a a a a a a", "x", "de", 11), ("A\tB\nA B\x0bA B A  B", None, "de", 9)]
        + [(f"Text {i % 7} and MORE", "y", "en", i) for i in range(90)]
    )
] + [(3, "Tie", "x", "en", 3), (3, "Tie", "x", "en", 3), (None, "No id", "x", "en", 5), (None, "No id", "x", None, 5)]
CLASHING = ", key long, leaf string, grp string, i long, n long, u long, runs string, collapsed string, blocks string"


def table(spark, rows):
    extra = (7, "l", "g", 1, 2, 3, "r", "c", "b")
    return spark.createDataFrame([r + extra for r in rows], "doc_id long, text string, source string, lang string, n_chars long" + CLASHING)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """Of each row (doc_id, leaf, subroot, root, proof, folded, verified), every tree built whole."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, s, g, n: h(*map(field, (d, s, g, n, t)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][j : j + 8]) for j in range(0, len(out[-1]), 8)])
        return out

    groups = sorted({r[3] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees, placed = {}, []
    for g in groups:
        own = sorted((r for r in rows if r[3] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[g] = levels([leaf(*r) for r in own])
        placed += [(g, i, r) for i, r in enumerate(own)]
    top = levels([trees[g][-1][0] for g in groups])
    out = []
    for g, i, (d, t, s, _, n) in placed:
        hit = d is not None and t is not None and zlib.crc32(str(d).encode()) % 3 == 0
        folded, proof = leaf(d, lower(t) if hit else t, s, g, n), ""
        for tree, at in ((trees[g], i), (top, groups.index(g))):
            for level in tree[:-1]:
                first = at - at % 8
                before, after = level[first:at], level[at + 1 : first + 8]
                proof += "".join(before + after)
                folded, at = h(*before, folded, *after), at // 8
        out.append((d, leaf(d, t, s, g, n), trees[g][-1][0], top[-1][0], h(proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk_levels", [1, 2, 5])
def test_manifest(spark, monkeypatch, chunk_levels):
    monkeypatch.setattr(merkle_manifest, "ROWS_PER_TASK", 20)
    docs = table(spark, DOCS).repartition(5)
    rows, nodes, found = merkle_manifest.manifest(docs, claimed=merkle_manifest.tampered(docs), chunk_levels=chunk_levels)
    assert sorted(map(tuple, merkle_manifest.proofs(rows, nodes, found, "claimed", chunk_levels).collect()), key=str) == brute_manifest(DOCS)
    published = merkle_manifest.subroots(rows, found).collect()
    assert sum(r.leaves for r in published) == len(DOCS) and {r.root for r in published} == {found.root.decode()}


def test_manifest_of_nothing_one_and_many_groups(spark):
    none = table(spark, DOCS[:0])
    rows, nodes, found = merkle_manifest.manifest(none)
    assert merkle_manifest.proofs(rows, nodes, found, "claimed").count() == 0
    one = DOCS[4:5]
    many = [(i, "t", "s", f"g{i % 70:03}", 1) for i in range(200)]
    for part in (one, many):
        docs = table(spark, part)
        rows, nodes, found = merkle_manifest.manifest(docs, claimed=merkle_manifest.tampered(docs))
        assert sorted(map(tuple, merkle_manifest.proofs(rows, nodes, found, "claimed").collect()), key=str) == brute_manifest(part)


def test_forest_is_a_commutative_monoid():
    leaves = [f"{i}".encode() for i in range(75)]
    want = merkle_manifest.Forest(1)
    for i, x in enumerate(leaves):
        want.add(0, len(leaves), 0, i, x)
    rng = random.Random(5)
    for _ in range(20):
        rng.shuffle(order := list(range(len(leaves))))
        parts = []
        for k in range(0, len(order), 9):
            part = merkle_manifest.Forest(1)
            for i in order[k : k + 9]:
                part.add(0, len(leaves), 0, i, leaves[i])
            parts.append(part)
        while len(parts) > 1:
            a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
            parts.append(a.merge(b).merge(merkle_manifest.Forest(1)))
        assert (parts[0].root, parts[0].runs, parts[0].nodes) == (want.root, want.runs, {})


class ArticleText(HTMLParser):
    """Brute force for pages whose parts are elements: the text in the article, outside the parts to leave out."""

    LEFT = {"script", "style", "nav", "header", "footer", "aside", "form"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.left, self.text = 0, 0, []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.left += tag in self.LEFT or (tag == "div" and bool(attrs))
        self.text.append("" if tag in ("b", "i") else " ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.left -= tag in self.LEFT or tag == "div"
        self.text.append("" if tag in ("b", "i") else " ")

    def handle_data(self, data):
        if self.depth and not self.left:
            self.text.append(data)


def test_pages_against_a_tree_walk():
    rng = random.Random(11)
    word = lambda: rng.choice(["alpha", "b&amp;c", "d &lt; e", "é", "&nbsp;", "x\ny", "&quot;q&quot;", "&#8364;"])
    text = lambda: " ".join(word() for _ in range(rng.randint(1, 12)))
    inside = [
        lambda: f"<p>{text()}<br>{text()}</p>", lambda: f"<p>in<b>line</b> {text()}</p>", lambda: f"<h2>{text()}</h2>", lambda: f"<ul><li>{text()}</li><li>one</li></ul>", lambda: "<p></p>",
        lambda: f'<div class="ad">{text()}</div>', lambda: f"<aside>{text()}</aside>", lambda: '<script>if (a < b) { x("</p><p>") }</script>', lambda: f"<!-- {text()} -->",
        lambda: f"<form><p>{text()}</p></form>", lambda: f'<div id="comments"><p>{text()}</p></div>', lambda: f"<blockquote>{text()}</blockquote>", lambda: f"<p>a<!-- {text()} -->b</p>",
    ]
    around = [lambda: f"<nav><a>{text()}</a></nav>", lambda: f"<footer>{text()}</footer>", lambda: f"<header><h1>{text()}</h1></header>", lambda: f'<div class="cookie-notice">{text()}</div>', lambda: f"<aside>{text()}</aside>"]
    for _ in range(300):
        outer = lambda: "".join(rng.choice(around)() for _ in range(rng.randint(0, 3)))
        page = f"<html><body>{outer()}<article><h1>{text()}</h1>{''.join(rng.choice(inside)() for _ in range(rng.randint(0, 8)))}</article>{outer()}</body></html>"
        got = " ".join(html_extraction.main_blocks(pd.Series([page])).iloc[0])
        assert got == " ".join("".join(ArticleText(page).text).split()), page


def blocks(page):
    return html_extraction.main_blocks(pd.Series([page])).iloc[0]


def test_pages_without_marks_or_whole_markup():
    long = "words of a paragraph that is long enough " * 4
    assert blocks(f"<body><div class=menu>Home</div><div><h1>Title</h1><p>{long}</p><p>end.</p></div><div class='sidebar'>{long}</div>") == ["Title", long.strip(), "end."]
    assert blocks(f"<ul><li><a>Home</a></li><li><a>News</a></li></ul><p>{long}</p>") == [long.strip()]
    assert blocks("<p>short") == ["short"]
    assert blocks("<article>a < b <i>c</i>d<p>e</article><p>f") == ["a < b cd", "e"]
    assert blocks("<article>a<p>b <b unclosed='") == ["a", "b"]
    assert blocks("plain &amp;amp; text") == ["plain &amp; text"]
    assert blocks('<div class="no-sidebar content"><p>x</p></div><div class="comments">y</div>') == ["x"]
    assert blocks('<article><header><h1>T</h1><span>by A</span></header><div class="post-header"><div><h2>S</h2></div><p>posted today</p></div><p>x</p><header>late</header></article>') == ["T", "S", "x"]
    assert blocks('<article><p>x</p><ol class="commentlist"><li>y</li></ol><section class="commentary"><p>z</p></section><div id="cookieBar">c</div></article>') == ["x", "z"]
    assert blocks('<body><div class="page-header">h</div><article><p>x</p></article></body>') == ["x"]
    assert blocks("<article><script>unclosed <p>x</p>") == [] and blocks("") == [] and blocks(None) == []
    assert blocks('<main><div class="notice"><p>All there is</p></div></main>') == ["All there is"]


@pytest.mark.parametrize("page", ['<a x="' * 20_000, '<a "' * 20_000, "<b>" * 9_000 + "</i>" * 9_000, "<div>" * 20_000 + "x", "<" * 50_000, "<!--" * 5_000 + ">", "<i><div>" * 5_000 + "</i>" * 5_000 + ">"])
def test_hostile_pages_end_soon(page):
    blocks(page)


def test_pages_keep_rows_and_columns(spark):
    long = "<article>" + "<p>some text of a block</p>" * 20_000 + "</article>"
    pages = spark.createDataFrame([(1, None, "r"), (2, "", "r"), (3, long, "r"), (3, long, "r"), (None, "<p>x", None)], "page_id long, html string, text string")
    found = html_extraction.extract(pages)
    assert found.columns == ["page_id", "html", "text", "blocks"]
    assert sorted((str(r.page_id), len(r.blocks)) for r in found.collect()) == [("1", 0), ("2", 0), ("3", 20_000), ("3", 20_000), ("None", 1)]
    assert html_extraction.extract(pages.limit(0)).count() == 0


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_batches():
    rng = random.Random(7)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 6)):
            n, v = rng.choice([0, 1, 5, 6, 7, 12, 30, 60, 150]), rng.choice([1, 2, 3, 5, 40])
            w = [rng.randrange(v) for _ in range(n)]
            if n > 10 and rng.random() < 0.7:
                a = rng.randrange(n)
                p = 1 + rng.randrange((n - a) // 3 + 1)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
                for _ in range(rng.randrange(3)):
                    w[rng.randrange(n)] = rng.randrange(v)
            docs.append(w)
        sizes = np.array([len(d) for d in docs])
        got = periodic_runs.runs_of_batch(np.array([x for d in docs for x in d], np.int64), np.cumsum(sizes) - sizes)
        assert got == [brute_runs(d) for d in docs]


def test_runs_of_long_repetitive_texts():
    rng = np.random.default_rng(3)
    for ids, want in ((np.zeros(100_000, np.int64), [(0, 100_000, 1)]), (np.arange(100_000) % 900, [(0, 100_000, 900)]), (np.arange(50_000), [])):
        assert periodic_runs.runs_of_batch(ids, np.array([0]))[0] == want
    few = rng.integers(0, 2, 3000)
    assert periodic_runs.runs_of_batch(few, np.array([0]))[0] == brute_runs(few.tolist())


def test_runs_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", 50)
    found = periodic_runs.periodic_runs(table(spark, DOCS), change=periodic_runs.planted).collect()
    want = []
    for d, t, *_ in DOCS:
        w = (t or "").encode().split()
        if (order := periodic_runs.planted(d, len(w))) is not None:
            w = [w[i] for i in order]
        runs = brute_runs(w) if len(w) < 1000 else periodic_runs.runs_of_batch(np.unique(w, return_inverse=True)[1], np.array([0]))[0]
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        want.append((d, len(w), runs, b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found), key=str) == sorted(want, key=str)
    assert periodic_runs.periodic_runs(table(spark, DOCS[:0])).count() == 0


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_html_extraction", "op13_periodic_runs"])
def test_equals_sql(spark, name):
    compare(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])
    compare(spark, LARGER, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_very_long_texts(spark):
    """One text of some megabytes among short ones, through the operators on texts: taken whole by each."""
    from vettra.llm import decontamination, language_id, license_scan, line_dedup, sentencepiece_codec

    words = " ".join(f"word{i % 5003}" for i in range(150_000))
    lines = "\n".join(f"line {i} of a long text" for i in range(60_000))
    docs = spark.createDataFrame([(1, words, "en"), (2, lines, "en"), (3, "short text", "en"), (4, "line 59999 of a long text", "en")], "doc_id long, text string, lang string")
    dropped = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, min_docs=2).select("row.doc_id", "n_lines", "n_dropped").collect()}
    assert dropped == {1: (1, 0), 2: (60_000, 1), 3: (1, 0), 4: (1, 1)}
    tail = " ".join(words.split()[-13:])
    bench = spark.createDataFrame([(9, tail)], "item_id long, text string")
    hits = {r.id: r.n_hit for r in decontamination.contamination(docs, bench).select("id", "n_hit").collect()}
    assert hits[1] >= 13 and hits[3] == 0
    import public_tokenizers

    ids = sentencepiece_codec.digests(sentencepiece_codec.encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))).collect()
    assert all(r.round_trip for r in ids) and max(r.n_ids for r in ids) > 150_000
    assert {r.n_paragraphs for r in license_scan.scan(docs.where("doc_id = 1")).collect()} == {1}
    assert language_id.lettered(docs).count() == 4
