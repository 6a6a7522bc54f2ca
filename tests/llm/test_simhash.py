"""SimHash near-dedup against brute force over all pairs."""

import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from vettra.llm import simhash_dedup as sh
from vettra.llm.components import connected_components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_roots(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 3) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("heavy", [1, 3, 20, 50_000])
def test_links_span_the_components_of_all_pairs(spark, heavy):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(40):
        x = rng.integers(0, 2**64, dtype=np.uint64)
        for _ in range(rng.integers(1, 60)):
            y = x
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                y ^= np.uint64(1) << np.uint64(b)
            rows.append(y)
    prints = np.unique(np.array(rows, np.uint64))
    df = spark.createDataFrame(pd.DataFrame({"fp": prints.view(np.int64)}))
    got = {r.node: r.root for r in connected_components(sh.near_links(df, heavy)).collect()}
    want = brute_roots(prints)
    signed = prints.view(np.int64)
    groups_want, groups_got = {}, {}
    for i, r in enumerate(want):
        groups_want.setdefault(r, set()).add(int(signed[i]))
    for x in signed:
        groups_got.setdefault(got.get(int(x), int(x)), set()).add(int(x))
    assert sorted(map(sorted, groups_want.values())) == sorted(map(sorted, groups_got.values()))
    assert len(groups_want) < len(prints)


def test_edge_cases(spark):
    texts = [None, "", " \t\n", "One two", "one  TWO", "Ä b c d", "a b c d e f g h"] + ["x y z w v u"] * 3
    rows = [(i if i != 4 else None, t, "s") for i, t in enumerate(texts)] + [(7, texts[7], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sh.near_components(docs).collect()
    assert len(got) == len(rows)
    want = {i: brute_fingerprint(t) for i, t, _ in rows}
    for r in got:
        assert r.fp % 2**64 == want[r.id]
    by = {r.id: r.component_id for r in got}
    assert by[0] == by[1] == by[2] == 0 and by[7] == by[8] == by[9] == 7 and by[None] == by[3] == 3
    kept = sh.dedup_near(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == [0, 3, 5, 6, 7]
    assert sh.near_components(docs.limit(0)).count() == 0


def test_unlinked_components_of_one_id_or_none_all_stay(spark):
    texts = ["the cat sat on a mat today", "rain fell over seven grey hills", "copper prices rose again in march", "she paints boats in the old harbour"]
    prints = np.array([brute_fingerprint(t) for t in texts], np.uint64)
    assert brute_roots(prints) == [0, 1, 2, 3]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3])]
    docs = spark.createDataFrame([*rows, rows[0], (7, texts[2])], "doc_id long, text string")
    assert sorted(map(tuple, sh.dedup_near(docs).collect()), key=str) == sorted(rows, key=str)
    assert {r.component_id for r in sh.near_components(docs).collect()} == {None, 7}


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(1000))
    whole = sh.fingerprint(text)
    monkeypatch.setattr(sh, "SHINGLES_AT_ONCE", 64)
    assert sh.fingerprint(text) == whole and whole % 2**64 == brute_fingerprint(text)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 63 and got[60] == 0
