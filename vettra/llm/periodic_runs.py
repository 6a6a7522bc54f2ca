"""Operator 13, periodic runs: Main-Lorentz divide and conquer over interned words.

A run is a maximal stretch of words with smallest period q (words q apart are the same)
that holds at least REPEATS periods and LEAST_WORDS words.

How it is found: words are interned to numbers. A stretch of the text is halved at its
midpoint; Z-functions over the right half and over the reversed left half give, for every
period, how far the words before and after the midpoint agree with those one period off,
and so the repetition of that period that touches the midpoint. The halves follow in the
same way. A run lies whole inside the highest stretch whose midpoint it contains, so
repetitions that go on beyond a stretch are left out there: they are found whole above.
Equal intervals keep their smallest period (by Fine and Wilf the others are multiples).

What is searched: a run of period q in [2**k, 2**(k+1)) has at least max(3 * 2**k, 5 for
k = 0) consecutive words that each come again within less than 2**(k+1) words. Next
occurrences come from one sort of a batch of documents, so stretches that cannot hold a
run of any scale are known before, and prose is rarely searched at all. This leaves out
no run. The search takes n log n steps in the worst case.

Texts are taken whole; a document is handled in one task, as runs do not pass document
borders, and a batch holds BATCH_WORDS words or one document.

Defined results: a null or empty text has no words, no runs, an empty collapsed text and
four nulls. A null id is kept and plants nothing. Overlapping runs are each returned.
Repeated rows are each returned. An empty table gives an empty result. Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vettra.llm.common import table

REPEATS, LEAST_WORDS = 4, 6
BATCH_WORDS = 400_000
#: Scale of a position that no stretch covers.
NONE = 99

Run = tuple[int, int, int]


def z_function(s: list[int], upto: int) -> list[int]:
    """How many words at i (below `upto`) agree with the beginning of s, whose last word occurs once only."""
    z = [0] * upto
    left = right = 0
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while s[k] == s[i + k]:
            k += 1
        z[i], left, right = k, i, i + k
    return z


def crossing(s: list[int], lo: int, mid: int, hi: int) -> Iterator[Run]:
    """(start, end, period) of the repetitions in s[lo:hi] that touch its midpoint and are long enough."""
    most = (hi - lo) // REPEATS
    left, right = min(most, mid - lo), min(most, hi - mid)  # periods on either side
    after, before = s[mid:hi], s[lo:mid][::-1]
    n_after, n_before = len(after), len(before)
    forward = z_function([*after, -1, *s[mid - left : hi], -2], n_after + 1 + left)
    backward = z_function([*before, -1, *s[lo : mid + right][::-1], -2], n_before + 1 + right)
    for q in range(1, left + 1):  # words from the midpoint on against those one period before
        on, back = forward[n_after + 1 + left - q], backward[q] if q < n_before else 0
        if on + back >= max((REPEATS - 1) * q, LEAST_WORDS - q):
            yield mid - q - back, mid + on, q
    for q in range(1, right + 1):  # and against those one period after
        on, back = forward[q] if q < n_after else 0, backward[n_before + 1 + right - q]
        if on + back >= max((REPEATS - 1) * q, LEAST_WORDS - q):
            yield mid - back, mid + q + on, q


def runs_within(s: list[int], scale: np.ndarray) -> list[Run]:
    """(start, length, period) of the runs of a stretch, by start and period; scale[i] is the least scale of the runs that may cover i."""
    n, found = len(s), {}
    parts = [(0, n)]
    while parts:
        lo, hi = parts.pop()
        if hi - lo < LEAST_WORDS or 1 << int(scale[lo:hi].min()) > (hi - lo) // REPEATS:
            continue
        mid = (lo + hi) // 2
        for a, b, q in crossing(s, lo, mid, hi):
            if (a > 0 and s[a - 1] == s[a - 1 + q]) or (b < n and s[b] == s[b - q]):
                continue  # goes on beyond this stretch
            if q < found.get((a, b), n):
                found[a, b] = q
        parts += [(lo, mid), (mid, hi)]
    return sorted((a, b - a, q) for (a, b), q in found.items())


def next_distance(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words up to the next occurrence of the same word in the same document, or a large number."""
    key = ids * (int(doc[-1]) + 1 if len(doc) else 1) + doc
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    out = np.full(len(ids), np.iinfo(np.int64).max)
    out[order[same]] = order[same + 1] - order[same]
    return out


def scales(gap: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least scale k of the runs that may cover each word (NONE: no run), from the gaps to its next occurrence."""
    out = np.full(len(gap), NONE, np.int8)
    ends = np.append(starts[1:], len(gap))
    longest = int((ends - starts).max(initial=0))
    top = 0
    while REPEATS << (top + 1) <= longest:
        top += 1
    edge = np.zeros(len(gap) + 1, bool)
    edge[starts] = True  # stretches end with their document
    for k in reversed(range(top + 1)):
        near = np.concatenate(([False], gap < 2 << k, [False]))
        flips = np.flatnonzero(near[1:] != near[:-1])
        a, b = flips[::2], flips[1::2]
        long = b - a >= max((REPEATS - 1) << k, LEAST_WORDS - 1 if k == 0 else 0)
        for x, y in zip(a[long].tolist(), b[long].tolist()):
            for u, v in split_at(x, y, edge):
                if v - u >= max((REPEATS - 1) << k, LEAST_WORDS - 1 if k == 0 else 0):
                    end = ends[np.searchsorted(starts, u, "right") - 1]
                    out[u : min(v + (2 << k), end)] = k
    return out


def split_at(a: int, b: int, edge: np.ndarray) -> list[tuple[int, int]]:
    """[a, b) cut where documents begin."""
    cuts = [a, *(a + 1 + np.flatnonzero(edge[a + 1 : b])).tolist(), b]
    return list(zip(cuts, cuts[1:]))


def runs_of_batch(ids: np.ndarray, starts: np.ndarray) -> list[list[Run]]:
    """The runs of each document of a batch: ids of all words, and where documents begin."""
    sizes = np.diff(np.append(starts, len(ids)))
    filled = np.flatnonzero(sizes)  # documents without words have no start of their own
    out: list[list[Run]] = [[] for _ in sizes]
    if not len(filled):
        return out
    doc = np.repeat(np.arange(len(filled)), sizes[filled])
    begin = starts[filled]
    scale = scales(next_distance(ids, doc), begin)
    covered = np.concatenate(([False], scale < NONE, [False]))
    flips = np.flatnonzero(covered[1:] != covered[:-1])
    edge = np.zeros(len(ids) + 1, bool)
    edge[begin] = True
    for x, y in zip(flips[::2].tolist(), flips[1::2].tolist()):
        for a, b in split_at(x, y, edge):
            d = int(doc[a])
            at = a - int(begin[d])
            out[filled[d]] += [(at + start, length, q) for start, length, q in runs_within(ids[a:b].tolist(), scale[a:b])]
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


Change = Callable[[object, int], np.ndarray | None]
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", change: Change | None = None) -> DataFrame:
    """(key, n_words, runs array<struct<start, length, period>>, collapsed) of every row.

    `collapsed` has the words that stay, joined by one space. change(key, n) may name the
    words, by number, that a text of n words is to have instead of its own.
    """
    kind = docs.schema[key].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in groups(batch):
                yield found(*rows)

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[list[bytes]]]]:
        words, begin, held = [], 0, 0
        for i, t in enumerate(batch.column(1)):
            words.append((t.as_py() or b"").split())
            held += len(words[-1])
            if held >= BATCH_WORDS:
                yield batch.column(0)[begin : i + 1], words
                words, begin, held = [], i + 1, 0
        if words:
            yield batch.column(0)[begin:], words

    def found(keys: pa.Array, words: list[list[bytes]]) -> pa.RecordBatch:
        known: defaultdict[bytes, int] = defaultdict(count().__next__)
        for i, k in enumerate(keys.to_pylist() if change else ()):
            if (order := change(k, len(words[i]))) is not None:
                words[i] = [words[i][j] for j in order.tolist()]
        sizes = np.array([len(w) for w in words], np.int64)
        ids = np.fromiter((known[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
        runs = runs_of_batch(ids, np.cumsum(sizes) - sizes)
        kept = [b" ".join(w if not r else [w[i] for i in np.flatnonzero(kept_words(len(w), r)).tolist()]) for w, r in zip(words, runs)]
        rows = [[{"start": a, "length": b, "period": q} for a, b, q in r] for r in runs]
        return pa.record_batch([keys, pa.array(sizes), pa.array(rows, pa.list_(RUN)), pa.array(kept, pa.binary()).cast(pa.string())], names=[key, "n_words", "runs", "collapsed"])

    schema = f"`{key}` {kind}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("binary")).mapInArrow(search, schema)


def planted(doc_id: object, n: int) -> np.ndarray | None:
    """The contract's planted repetition: a tenth of the documents repeat a period from some word on."""
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, planted ones included: their number, the longest one, and digests of all runs and of the words that stay."""
    found = periodic_runs(table(spark, sf_dir, "documents"), change=planted)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("best.shorter")
    return out.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(F.try_divide(1000 * length, F.col("best.period"))).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


#: Every pair of equal words up to a quarter of the text apart, and stretches of these by distance.
ORACLE_SQL = f"""
WITH bits AS (
  SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
         lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS t
  FROM range(256) r(i)),
crc AS (SELECT list(t ORDER BY i) AS tab FROM bits),
texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
  xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k::BIGINT, 1))::UBIGINT)),
    lambda c, b: xor(tab[(xor(c, b) & 255)::BIGINT + 1], c >> 8)), 4294967295::UBIGINT)::BIGINT AS h FROM documents, crc),
sized AS (SELECT *, len(words) AS n, coalesce(h % 10 = 0, false) AS hit, (h // 10) % nullif(len(words), 0) AS a FROM texts),
shaped AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM sized),
placed AS (SELECT r, n, words, hit, a, p, unnest(range(n)) AS i FROM shaped),
words AS (SELECT r, n, i, words[1 + CASE WHEN hit AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM placed),
pairs AS (SELECT x.r, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND {REPEATS} * (y.i - x.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest({LEAST_WORDS}, {REPEATS} * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, min({{'l': -length, 's': start, 'p': period}}) AS best FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s AS start, -best.l AS length, best.p AS period, (1000 * -best.l) // best.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""
