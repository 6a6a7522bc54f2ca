"""Winnowing against brute force over all windows."""

import hashlib
import random
import re

from vettra.llm import decontamination as dc


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    """{doc_id: (n_words, n_hit, n_items, sha, contaminated)}"""
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n and item is not None else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = {}
    for doc, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    ids |= found
        out[doc] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def result(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = dc.contamination(d, b).collect()
    return {r.id: (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in out}


def test_against_all_windows(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["é1", "ÄB", "x", "7"]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(draw(n))) for i, n in enumerate([40, 13, 14, 30, 12, 7, 20, 1, 0, 25])] + [(3, " ".join(draw(16))), (None, "w1 w2"), (10, None), (11, "zz " * 30)]
    items = [(i, "Q" + t if i == 7 else t) for i, t in items]
    docs = []
    for i in range(120):
        w = draw(rng.randrange(0, 90))
        for _ in range(rng.randrange(0, 3)):
            item = (rng.choice(items)[1] or "").split()
            a = rng.randrange(0, max(1, len(item)))
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = item[a : a + rng.randrange(8, 30)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).title()))
    docs += [(1000, None), (1001, ""), (1002, "... --"), (1003, "zz " * 50)]
    want = brute(docs, items)
    assert result(spark, docs, items) == want
    assert sum(v[1] > 0 for v in want.values()) > 20 and any(v[1] > 0 and not v[4] for v in want.values())


def test_edge_cases(spark):
    item = [(1, " ".join(f"a{i}" for i in range(13)))]
    assert result(spark, [(1, item[0][1])], []) == {1: (13, 0, 0, hashlib.sha256(b"").hexdigest(), False)}
    docs = spark.createDataFrame([(1, item[0][1], "x"), (1, item[0][1], "x"), (None, "clean", None), (None, item[0][1], "y")], "doc_id long, text string, items string")
    bench = spark.createDataFrame(item, "item_id long, text string")
    assert sorted(r.n_hit for r in dc.contamination(docs, bench).collect()) == [0, 13, 13, 13]
    kept = dc.decontaminate(docs, bench)
    assert kept.columns == docs.columns and [r.text for r in kept.collect()] == ["clean"]
    assert dc.contamination(docs.limit(0), bench).count() == 0


def test_files_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.op2_decontamination(spark, sf).collect()}
    rows = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*c).collect()]
    want = brute(rows("documents", "doc_id", "text"), rows("benchmark", "item_id", "text"))
    assert got == want and any(v[4] for v in want.values())
