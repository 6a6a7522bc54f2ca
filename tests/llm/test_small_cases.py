"""Operators 1, 3 and 5 to 10 and the pipeline on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from oracle import compare

from vettra.llm import language_id, license_scan, line_dedup, queries, sentencepiece_codec, sharding, token_records, topk_search, toxicity

SF, LARGER, LARGEST = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
LONG = "\n".join(f"line {i} of a long text" for i in range(20_000))
TEXTS = [None, "", "\n", "Shared\t\nown 1", " shared \nown 2", "SHARED", "é ü 中文 \x01", LONG, LONG, "own 3\n\n"]
ROWS = [(i, t, "x", "y", i) for i, t in enumerate(TEXTS)] + [(5, "SHARED", "x", "y", 5), (None, "shared", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, row string, kept string, rk1 long")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_lines(rows, least):
    split = [(t or "").split("\n") for _, t in rows]
    keys = [[lower(x).strip(" \t\n\v\f\r") for x in ls] for ls in split]
    count = {}
    for ks in keys:
        for k in set(ks):
            count[k] = count.get(k, 0) + 1
    return [(d, "\n".join(x for x, k in zip(ls, ks) if not k or count[k] < least), len(ls), sum(bool(k) and count[k] >= least for k in ks)) for (d, _), ls, ks in zip(rows, split, keys)]


def by_text(rows):
    return sorted(rows, key=str)


def test_line_dedup(spark, docs):
    found = line_dedup.dedup_lines(docs, min_docs=3).select("row.doc_id", "kept", "n_lines", "n_dropped").collect()
    assert by_text(map(tuple, found)) == by_text(brute_lines([r[:2] for r in ROWS], 3))
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_probes_spread_over_places(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PROBES_PER_PLACE", 50)
    monkeypatch.setattr(line_dedup, "HOT_COPIES", 2)
    rows = [(i, "\n".join(f"line {(i + j) % 1500}" for j in range(6))) for i in range(1500)] + [(i, "the same\n" * 40) for i in range(1500, 1510)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.dedup_lines(docs, min_docs=6).select("row.doc_id", "kept", "n_lines", "n_dropped").collect()
    assert by_text(map(tuple, found)) == by_text(brute_lines(rows, 6))
    seen = []
    deal = type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, *a: seen.append(self.groupBy("place", "kind").count().collect()) or deal(self, *a))
    line_dedup.shared_lines(docs, "doc_id", "text", 6, 1)
    probes = {r.place: r["count"] for r in seen[0] if r.kind == 1}
    assert sum(probes.values()) == 9400 and max(probes.values()) < 200
    assert set(probes) <= {r.place for r in seen[0] if r.kind == 0}


def test_lines_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 100)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 50)
    rows = [(i, "\n".join(["Hot line", *(f"line {(i * 7 + j) % 900}" for j in range(5))])) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.dedup_lines(docs, min_docs=4).select("row.doc_id", "kept", "n_lines", "n_dropped").collect()
    assert by_text(map(tuple, found)) == by_text(brute_lines(rows, 4))
    index = line_dedup.line_index(line_dedup.line_hashes(docs, "doc_id", "text", 1))
    assert index.shards > 5 and index.hot.count() == 1 and {r.shard for r in index.blobs.select("shard").collect()} >= {-1, 0, 1}


def test_perfect_hash():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    n = rng.integers(1, 100_000, 5000)
    made = line_dedup.PerfectHash.from_bytes(line_dedup.PerfectHash.build(h1, h2, n).to_bytes())
    assert (made.count(h1, h2) == np.minimum(n, line_dedup.COUNT_MAX)).all() and not made.count(h2, h1).any()


def test_sharding(spark, docs):
    tree = sharding.regular_tree(4)
    out = sharding.assign_shards(docs, "doc_id", "text", tree, sharding.grown_tree(tree)).collect()
    assert len(out) == len(ROWS) and {r.size for r in out if r.doc_id == 0} == {1}
    assert all(r.grown_shard in (r.shard, 4) for r in out)
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sorted((r.doc_id, r.text_crc32) for r in out if r.doc_id is not None) == sorted((d, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS if d is not None)
    assert sharding.assign_shards(docs.limit(0), "doc_id", "text", tree, sharding.grown_tree(tree)).count() == 0


def test_one_more_shard_takes_rows_only_into_itself(spark):
    keys = spark.range(3000).selectExpr("cast(id AS string) AS k")
    for n in (16, 17, 18, 21):
        moved = sharding.descend(sharding.descend(keys, "k", sharding.sized_tree(n), "a"), "k", sharding.sized_tree(n + 1), "b")
        steps = moved.where("a <> b").groupBy("b").count().collect()
        assert [r.b for r in steps] == [n] and steps[0]["count"] > 3000 / (n + 1) / 2
    assert sharding.sized_tree(17) == sharding.grown_tree(sharding.regular_tree(16)) and sharding.sized_tree(3) == sharding.regular_tree(3)


def test_blocks_out_of_reach_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 200)
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in 20 * np.eye(40)[i // 50] + rng.normal(0, 0.1, 40)]) for i in range(2000)] + [(7, [0.5] * 40), (7, [0.5] * 40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 50 = 0 AND vec_id < 500")
    counted, reach = [], topk_search.in_reach
    monkeypatch.setattr(topk_search, "in_reach", lambda asked, blocks, n: counted.append((blocks.count() * asked.select("group").distinct().count(), reach(asked, blocks, n).count())) or reach(asked, blocks, n))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.search(vectors, asked, 5).collect()}
    v = np.floor(256 * np.array([x for _, x in rows])).astype(np.int64)
    ids = np.array([i for i, _ in rows])
    for q in range(0, 500, 50):
        score = v @ v[q]
        best = sorted((-int(s), int(i)) for s, i in zip(score, ids) if i != q)[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -s) for s, i in best]
    ((blocks, sent),) = counted
    assert 0 < 2 * sent < blocks  # pairs of groups and blocks beyond the first round


@pytest.mark.parametrize("shard_rows", [16_384, 40])
def test_topk(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", min(topk_search.BLOCK_ROWS, shard_rows // 2))
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 8)]) for i in range(300)]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, None), (303, [1.0, None]), (304, [float("nan")] * 8), (305, [float("inf")] * 8), (None, [1.0] * 8), (306, [])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, id int")
    got = {}
    for r in topk_search.search(vectors, vectors.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: np.floor(256 * np.array(v + [0.0] * (8 - len(v)))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {q: [(k + 1, c, int(-s)) for k, (s, c) in enumerate(sorted((-float(good[q] @ w), c) for c, w in good.items() if c != q)[:5])] for q in good if q % 50 == 0}
    assert {q: sorted(x) for q, x in got.items()} == want
    assert topk_search.search(vectors.limit(0), vectors, 5).count() == 0 == topk_search.search(vectors, vectors.limit(0), 5).count()


def test_toxicity_distances_against_brute_force(spark):
    import zstandard as z

    words = ["alpha", "beta", "gamma", "delta", "vile", "rotten", "Ünfug"]
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(words[:4], 30)) + (" vile rotten ünfug" if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame([*rows, (3, "another text of id 3"), (None, "vile"), (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(5, 1), (5, 0), (7, None), (900, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, toxicity.learnable(toxicity.F.col("doc_id")))
    assert model.weights is not None and len(model.ordinary) == len(model.toxic)
    params = z.ZstdCompressionParameters(strategy=z.STRATEGY_LAZY2, window_log=17, chain_log=18, hash_log=18, search_log=6, min_match=4, target_length=16, write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS)

    def length(content, window):  # a fresh dictionary and compressor for each window
        return len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params).compress(window))

    known, n = toxicity.WordDistance(model.ordinary, model.toxic, model.frame), toxicity.FRAME_BYTES
    for text in ["alpha vile, VILE!", "", None, "x" * 5000, "Ünfug rotten beta", "1 2 3"]:
        found = re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        windows = [model.frame[:n] + b" " + w + b" " + model.frame[n:] for w in found]
        assert known.distances(text).tolist() == [length(model.ordinary, w) - length(model.toxic, w) for w in windows]
    clashing = spark.createDataFrame([("vile rotten alpha", 1.5, 2), (None, 1.5, 2)], "text string, score double, predicted int")
    out = toxicity.classify(clashing, model).collect()
    assert [r["row"].score for r in out] == [1.5, 1.5] and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert toxicity.classify(docs.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_sentencepiece(spark, docs, library):
    out = sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).select("row.text", "ids", "decoded").collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert (r.ids is None) == (r.text is None) and r.decoded == (r.text or "")
        assert r.text is None or r.ids == library.encode(r.text)


def test_sentencepiece_of_real_texts(spark, library):
    codec = sentencepiece_codec.load_codec(public_tokenizers.path("piece_bpe_32k.model"))
    for (text,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        ids = codec.encode(text)
        assert ids.tolist() == library.encode(text) and codec.decode(ids) == text


def test_sentencepiece_of_random_texts(library):
    codec = sentencepiece_codec.load_codec(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(8)
    bits = [*"aaabcdeehiilnoorsttu  ..,'\n\t", "é", "ß", "\u00a0", "\u2028", "e\u0301", "▁", "<|", "don't", "中", "👩‍👩‍👧", "\x01", "  ", "the ", "ing"]
    for _ in range(1500):
        t = "".join(rng.choice(bits, rng.integers(1, 40)))
        assert codec.encode(t).tolist() == library.encode(t), repr(t)


def test_unigram_viterbi_is_the_best_of_all_segmentations():
    pieces = {"a": (1, -2.0), "b": (2, -2.5), "ab": (3, -3.0), "ba": (4, -4.6), "aba": (5, -6.2), "▁": (6, -1.0)}
    codec = sentencepiece_codec.PieceCodec(pieces, None, bpe=False)

    def best(text):
        if not text:
            return 0.0
        return max(pieces[text[:k]][1] + best(text[k:]) for k in (1, 2, 3) if text[:k] in pieces and len(text) >= k)

    for text in ("a", "abab", "babaab", "▁abaabba"):
        parts = codec.segment(text)
        assert "".join(parts) == text and sum(pieces[p][1] for p in parts) == pytest.approx(best(text))


def test_token_records(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 1]
    manifest = token_records.write_records(docs, str(tmp_path / "edge"), path)
    out = token_records.read_records(manifest, str(tmp_path / "edge")).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, *sorted(r[0] for r in ROWS if r[0] is not None)]
    assert sorted(r.ids for r in out) == sorted(ids(r[1]) for r in ROWS)
    assert [r.start for r in out] == np.cumsum([0] + [r.n_tokens for r in out])[:-1].tolist()
    first = manifest.orderBy("part").first()
    assert token_records.read_at(str(tmp_path / "edge"), first.data, 0, first.width).tolist() == out[0].ids
    assert token_records.write_records(docs.limit(0), str(tmp_path / "none"), path).count() == 0

    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_records.op8_token_records(spark, SF).collect()}
    start = 0
    for d, t in sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())):
        x = ids(t)
        assert got[d] == (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)


def test_token_ids_of_odd_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), token_records.PieceEncoder(path)
    odd = ["a\u00a0b", "x\u2028y z\u0085w", "e\u0301 cafe\u0301.", "don't i'd they'll' 's 'tis", "a<|b <|endoftext|> <|ENDOFTEXT|>.", "\x00\x01 a\x1cb \x7f", "ΑΣ ΣΑΣ Σ", "İstanbul Straße DŽ ǅ", "word.) (word!?. ...", "ﬁn ℌ Å Å 가", "१२ 12a3 a_b-c's", "中文字。 日本", "a,b.c;d:", "'", "\u200d👩‍👩‍👧 🇩🇪."]
    rng = np.random.default_rng(4)
    bits = [c for t in odd for c in t] + list("abcdefgh .,'sS\n\tÀé")
    odd += ["".join(rng.choice(bits, rng.integers(1, 60))) for _ in range(600)]
    for t in [*odd, *odd]:
        assert np.frombuffer(encoder.encode(t.encode()), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_are_asked_for_whole_texts():
    """A tokenizer that keeps case and white space: its ids don't come from pieces."""
    from array import array

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), token_records.PieceEncoder(path)
    assert encoder.whole and not token_records.PieceEncoder(public_tokenizers.path("word_bpe_49k.json")).whole
    for text in ("", "  Two  Words\n", "don't STOP", "é ü 中文 \x01", LONG):
        assert array(encoder.kind, encoder.encode(text.encode())).tolist() == library.encode(text, add_special_tokens=False).ids


def test_damaged_records_are_found():
    data = bytearray(b"".join(token_records.frame(b"abcd")))
    assert token_records.unframe(bytes(data), 0) == b"abcd"
    data[13] ^= 1
    with pytest.raises(ValueError):
        token_records.unframe(bytes(data), 0)


def licences(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["row"].doc_id: [(x.paragraph, x.family) for x in r.licences] for r in license_scan.scan(rows).collect()}


def test_licence_scan(spark, docs):
    out = license_scan.scan(docs).collect()
    assert len(out) == len(ROWS) and not any(r.licences for r in out) and license_scan.scan(docs.limit(0)).count() == 0
    assert {r.n_paragraphs for r in out if not r["row"].text or r["row"].text == "\n"} == {0}
    texts = ["x\n\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.", "The license plate of the car was new.", None, "All rights reserved."]
    assert licences(spark, texts) == {0: [(1, "mit")], 1: [(0, "apache")], 2: [], 3: [], 4: [(0, "proprietary")]}


def test_wrapped_licence_notices(spark):
    import textwrap

    prose = "A story of seven hills.\n"
    found, want = [], []
    for family, texts in license_scan.NOTICES.items():
        for t in texts:
            for lead in ("", "# ", " * "):
                found.append(f"{prose}{lead.rstrip()}\n" + "\n".join(lead + x for x in textwrap.wrap(t, 72)) + "\n\nThe end.")
                want.append(family)
    got = licences(spark, found)
    # a notice that wraps at the end of a sentence is two paragraphs
    assert np.mean([family in {f for _, f in got[i]} for i, family in enumerate(want)]) >= 0.97


def test_held_out_licence_notices_and_sentences(spark):
    held = [(f, t) for f, texts in license_scan.HELD_NOTICES.items() for t in texts]
    got = licences(spark, [t for _, t in held])
    assert np.mean([[f for _, f in got[i]] == [family] for i, (family, _) in enumerate(held)]) >= 0.9
    assert not any(licences(spark, license_scan.HELD_OTHERS).values())


def test_toxicity_on_held_out_documents(spark, docs):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGEST}/labels.parquet").where("toxic IS NOT NULL").collect()}
    out = [r for r in toxicity.op7_toxicity(spark, LARGEST).collect() if r.held_out and r.doc_id in labels]
    ranks = np.argsort(np.argsort([r.score for r in out], kind="stable"), kind="stable") + 1
    toxic = np.array([labels[r.doc_id] for r in out]) == 1
    area = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert area >= 0.9
    nothing = toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), toxicity.learnable(toxicity.F.col("doc_id")))
    assert {(r.score, r.predicted) for r in toxicity.classify(docs, nothing).collect()} == {(0.0, 0)}


def test_language_on_held_out_documents(spark, docs):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in language_id.op10_language_id(spark, LARGER).collect() if r.held_out and langs[r.doc_id] is not None]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in out]) >= 0.97
    none = language_id.identify(docs, None).collect()
    assert len(none) == len(ROWS) and {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    real = spark.read.parquet(f"{SF}/documents.parquet")
    net = language_id.fit(real, language_id.learnable(language_id.F.col("doc_id")))
    by = {r["row"].doc_id: r.lang_pred for r in language_id.identify(docs, net).collect()}
    assert by[0] == by[1] == by[2] == "und" and by[7] == by[8] != "und"


def brute_language(net, text):
    """One window and one filter at a time."""
    if text is None or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    raw = text.encode().lower()
    total, weight = np.zeros(len(net.langs)), 0
    for a in range(0, len(raw), 256):
        x = np.frombuffer(raw[a : a + 256].ljust(256, b"\0"), np.uint8)
        pooled = [max(0.0, max(sum(float(t[j, x[i + j], k]) for j in range(len(t))) for i in range(257 - len(t)))) for t in net.tables for k in range(t.shape[2])]
        z = np.array(pooled) @ net.weights + net.bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        n = np.count_nonzero(x) if a + 256 >= len(raw) else 256
        total, weight = total + n * p, weight + n
    return net.langs[int(total.argmax())], float((total / weight).max())


def test_language_predictions_against_brute_force(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(3)
    monkeypatch.setattr(language_id, "FILTERS", 3)
    net = language_id.ByteConvNet(["a", "b", "c"], [rng.normal(0, 1, (w, 256, 3)).astype(np.float32) for w in (2, 3)], rng.normal(0, 1, (6, 3)).astype(np.float32), np.zeros(3, np.float32))
    texts = [None, "", "12", "Word", "x" * 256, "é" * 300, "long text " * 90, "Zwei\n", "\x00a"]
    for waiting in (1, 3, 4096):
        monkeypatch.setattr(language_id, "WAITING", waiting)
        got = language_id.predictor(net)(pd.Series(texts))
        for t, lang, score in zip(texts, got["lang_pred"], got["score"]):
            want = brute_language(net, t)
            assert lang == want[0] and score == pytest.approx(want[1], abs=1e-5)


def test_language_training_rows(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "de") for i in range(5000)] + [(1, "other", "en"), (None, "no id", "fr"), (None, "no id 2", "fr"), (9001, "", "es"), (9002, "u", "und"), (9003, None, "es")]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    chosen = [tuple(r) for r in language_id.chosen_ids(docs).collect()]
    assert len(chosen) == len(set(chosen))
    by = {lang: sum(x == lang for _, x in chosen) for lang in ("en", "de", "fr", "es")}
    assert by == {"en": 600, "de": 600, "fr": 1, "es": 2}


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_decontamination", "op3_sharding", "op5_topk_search", "op9_license_scan"])
def test_equals_sql(spark, name):
    compare(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_pipeline_against_brute_force(spark, library):
    import corpus_pipeline
    from llm.test_decontamination import brute as contaminated
    from llm.test_simhash import brute_fingerprint, brute_roots

    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*c).collect()]
    docs = [(d, t) for d, t in read("documents", "doc_id", "text") if t and re.search(r"[^\W\d_]", t)]
    docs = sorted((d, kept) for d, kept, _, _ in brute_lines(docs, 10))
    prints = np.array([brute_fingerprint(t) for _, t in docs], np.uint64)
    docs = [x for i, (x, root) in enumerate(zip(docs, brute_roots(prints))) if i == root]
    bad = contaminated(docs, read("benchmark", "item_id", "text"))
    want = {}
    for d, t in docs:
        if not bad[d][4]:
            ids = library.encode(t)
            want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), True)
    got = {r.doc_id: (r.n_ids, r.ids_sha256, r.decoded_sha256, r.round_trip) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("labelled", [0, 1])
def test_language_stage_without_a_network_keeps_lettered_texts(spark, labelled):
    import corpus_pipeline

    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    rows = [(100 + i, t, None, "s", 0) for i, t in enumerate(["Plain words.", "Ünïcode", "中文", "12 34 !?", "", None, "\n\t"])]
    rows += [(None, "no id", None, "s", 0), (held, "held out", "en" if labelled else None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    assert by_text(map(tuple, kept.collect())) == by_text([*rows[:3], *rows[7:]])
