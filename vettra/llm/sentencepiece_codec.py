"""Operator 6, SentencePiece encoding and decoding.

An Aho-Corasick automaton over the vocabulary's pieces scans a text once. At each place its
output links give every piece that ends there, and each may extend the best segmentation
of the text before that piece:

* unigram models: the piece relaxes the best sum of scores (Viterbi); a character without
  a piece costs the lowest score less 10;
* BPE models: scores are merge ranks, and their sum is not what SentencePiece maximises.
  Exactly one piece that ends at a place continues the merge result of the text before
  it: the one for which merging the last two pieces' characters alone gives these two
  pieces again. The scan keeps that piece instead of the highest sum, so ids equal the
  library's. Answers about pairs of pieces are remembered.

Texts are scanned in units between which no piece can reach (before a word's blank, and
around marks that no piece holds together with other characters); a bounded cache keeps
the units' ids.
Blanks become U+2581 and one is put in front, as the model asks; characters without a
piece become byte pieces. Decoding reverses this exactly, except that U+2581 itself comes
back as a blank.

Defined results: null text encodes to no ids and decodes to an empty text; empty text has
no ids; ids are null only for null text in `encode`; long texts are encoded whole, unit by
unit; of equal sums (unigram models) the longest piece stays, a merge result has no ties;
repeated rows repeat their result; an empty table gives an empty result; other columns are
kept.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vettra.llm.common import small_batches, table

BLANK = "▁"
CACHE_UNITS = 300_000  # in each of two generations
CACHE_PAIRS = 300_000
UNKNOWN_COST = 10.0


def plain_char(c: str) -> bool:
    return c.isascii() or c.isalpha() or c == BLANK


class Known(dict):
    """Packed ids of units; asks `learn` for those that are missing."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self.learn = learn

    def __missing__(self, unit: str) -> bytes:
        found = self[unit] = self.learn(unit)
        return found


class PieceCodec:
    """pieces: {text: (id, score)}; byte_ids: the id of each of the 256 bytes, or None if there is no fallback."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int] | None, unknown_id: int = 0, bpe: bool = True):
        import ahocorasick

        self.score = {p: s for p, (_, s) in pieces.items()}
        self.ids = {p: i for p, (i, _) in pieces.items()}
        self.bpe, self.byte_ids, self.unknown_id = bpe, byte_ids, unknown_id
        self.low = min(self.score.values(), default=0.0) - UNKNOWN_COST
        surface = {i: p.encode() for p, i in self.ids.items()} | ({} if byte_ids is None else {i: bytes([b]) for b, i in enumerate(byte_ids)})
        self.surface = [surface.get(i, b"") for i in range(max([unknown_id, *surface]) + 1)]
        self.chars = frozenset(p for p in pieces if len(p) == 1)
        self.units = Known(self.learn)  # this and the last generation of the cache
        self.older: dict[str, bytes] = {}
        self.pairs: dict[str, dict[str, bool]] = {}  # by the later piece, then the one before
        self.n_pairs = 0
        # a piece that merging its own characters doesn't give can't be a result
        usable = [p for p in pieces if not bpe or len(p) == 1 or self.merge(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in usable:
            self.automaton.add_word(p, (p, len(p)))
        self.filled = bool(usable)
        if self.filled:
            self.automaton.make_automaton()
        self.plain, self.mixed = self.unit_patterns(pieces)

    @staticmethod
    def unit_patterns(pieces: dict) -> tuple[re.Pattern, re.Pattern]:
        """Units of texts of letters and ASCII only, and of others. No piece holds both characters at a cut."""
        inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        whole = re.compile(".+", re.S)
        if any(y == BLANK != x for x, y in inside):
            return whole, whole
        inside_plain = {pair for pair in inside if all(map(plain_char, pair))}
        marks = {chr(c) for c in range(1, 128) if not chr(c).isalnum() and c != 32} - {x for x, y in inside if y == BLANK}
        while mixed := {c for x, y in inside_plain if x != BLANK and (x in marks) != (y in marks) for c in (x, y) if c in marks}:
            marks -= mixed
        single = {c for c in marks if not any(c in pair for pair in inside)}
        plain, mixed = (re.escape("".join(sorted(x))) for x in (marks, single))
        pattern = lambda m: re.compile(f"{BLANK}*[{m}]+|{BLANK}+[^{BLANK}{m}]*|[^{BLANK}{m}]+" if m else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", re.S)
        return pattern(plain), pattern(mixed)

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging neighbours, the highest score first, the leftmost of ties."""
        parts, get = list(text), self.score.get
        scores = [get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            at, best = -1, None
            for i, x in enumerate(scores):
                if x is not None and (best is None or x > best):
                    at, best = i, x
            if at < 0:
                return parts
            parts[at] += parts.pop(at + 1)
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at])
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1])

    def joins(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a in a merge result."""
        if self.n_pairs > CACHE_PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        found = self.pairs.setdefault(b, {})[a] = self.merge(a + b) == [a, b]
        return found

    def segment(self, text: str) -> list[str]:
        """The pieces of a text; characters without a piece stand alone."""
        n, score = len(text), self.score
        last: list[str | None] = [None] * (n + 1)  # the piece that ends here in the best segmentation
        total = [0.0] + [-np.inf] * n
        found = self.automaton.iter(text) if self.filled else ()
        if self.bpe:
            if not self.chars.issuperset(text):
                for i, c in enumerate(text, 1):
                    if c not in score:  # no piece goes over it
                        last[i] = c
            pairs, none = self.pairs, {}
            for end, (piece, size) in found:
                end += 1
                if last[end] is None:
                    a = end - size
                    before = last[a]
                    if not a:
                        last[end] = piece
                    elif before is not None:
                        ok = pairs.get(piece, none).get(before)
                        if self.joins(before, piece) if ok is None else ok:
                            last[end] = piece
        else:
            # a character without a piece may be passed over at a cost
            alone = [(i, (c, 1)) for i, c in enumerate(text) if c not in score]
            for end, (piece, size) in sorted([*found, *alone], key=lambda x: x[0]):
                end += 1
                s = total[end - size] + score.get(piece, self.low)
                if s > total[end]:
                    total[end], last[end] = s, piece
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.unknown_id] if self.byte_ids is None else [self.byte_ids[b] for b in piece.encode("utf-8", "replace")]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        units = (self.plain if all(map(plain_char, set(text))) else self.mixed).findall(BLANK + text.replace(" ", BLANK))
        if len(self.units) > CACHE_UNITS:
            self.units, self.older = Known(self.learn), self.units
        return np.frombuffer(b"".join(map(self.units.__getitem__, units)), "<i4")

    def learn(self, unit: str) -> bytes:
        return dict.get(self.older, unit) or array("i", [i for p in self.segment(unit) for i in self.piece_ids(p)]).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; ids of no piece, such as control pieces, give nothing."""
        top = len(self.surface)
        known = ids.tolist() if not len(ids) or (0 <= ids.min() and ids.max() < top) else [i for i in ids.tolist() if 0 <= i < top]
        raw = b"".join(map(self.surface.__getitem__, known))
        text = raw.decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


def load_codec(path: str, bpe: bool = True) -> PieceCodec:
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    n = range(m.get_piece_size())
    byte_ids = [i for i in n if m.is_byte(i)]
    pieces = {m.id_to_piece(i): (i, m.get_score(i)) for i in n if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
    return PieceCodec(pieces, byte_ids if len(byte_ids) == 256 else None, m.unk_id(), bpe)


def codec_of(path: str, bpe: bool = True, made: dict = {}) -> PieceCodec:  # noqa: B006
    """One codec for each worker process."""
    if (path, bpe) not in made:
        made[path, bpe] = load_codec(path, bpe)
    return made[path, bpe]


def encoder(path: str, bpe: bool = True) -> Callable:
    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        codec = codec_of(path, bpe)
        return pd.Series([None if t is None else codec.encode(t) for t in texts], dtype=object)

    return encode


def decoder(path: str, bpe: bool = True) -> Callable:
    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        codec = codec_of(path, bpe)
        return pd.Series(["" if x is None else codec.decode(np.asarray(x)) for x in ids], dtype=object)

    return decode


def coder(path: str, bpe: bool = True) -> Callable:
    """Both ways in one pass: struct(ids, decoded)."""

    @F.pandas_udf("struct<ids: array<int>, decoded: string>")
    def code(texts: pd.Series) -> pd.DataFrame:
        codec = codec_of(path, bpe)
        ids = [None if t is None else codec.encode(t) for t in texts]
        return pd.DataFrame({"ids": ids, "decoded": ["" if x is None else codec.decode(x) for x in ids]})

    return code


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(row, ids, decoded): each row as a struct, its ids, and the text that they decode to."""
    small_batches(docs.sparkSession)
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    return docs.select(row, coder(path)(docs[text]).alias("x")).select("row", "x.ids", "x.decoded")


def digests(encoded: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return encoded.select(
        F.col(f"row.{id_col}").alias(id_col),
        F.size(ids).cast("long").alias("n_ids"),
        F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce(f"row.{text}", F.lit(""))).alias("round_trip"),
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded with the 32k piece vocabulary."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")))
