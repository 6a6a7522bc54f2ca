"""Operator 8, token-id output: length-delimited binary records with an offset index.

Documents are range-partitioned by id and sorted, encoded, and framed into one record
file for each partition, in the shared folder or any folder that pyarrow's file systems
reach. A record is

    length of payload   uint64, little-endian
    masked CRC-32       uint32 of those 8 bytes
    payload             the ids: uint16 if the vocabulary allows it, else uint32
    masked CRC-32       uint32 of the payload

where masked(c) = rotate-right(c, 15) + 0xA282EAD8 modulo 2**32. The index file beside it
has one (offset, number of ids, document id, flags) entry of 8-byte integers for each record, so a
reader can fetch records in any order. The manifest, a Parquet table that Spark commits,
lists the files of the attempts that succeeded; files of lost attempts are not in it.

Encoding splits texts at ASCII white space and before a word's closing marks, which the
tokenizer's own pre-tokens never span, and asks it once for each piece that the bounded cache
doesn't hold.

Defined results: a null text is empty and has only the end id; ids that are null come
first; repeated ids keep one record each, ordered by a hash of the text; an empty table
gives an empty manifest; texts of any length make one record each; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vettra.llm.common import fresh_path, table, written

MASK = 0xA282EAD8
CACHE_PIECES = 400_000  # in each of two generations
FRAME_BYTES = 16  # of a record besides its payload
INDEX = np.dtype([("offset", "<i8"), ("n", "<i8"), ("doc_id", "<i8"), ("flags", "<i8")])
NULL_ID = 1
MANIFEST = "part long, data string, index string, width int, n_records long, n_ids long"
RECORD = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> tuple[bytes, bytes, bytes]:
    """The parts of a record, so that the payload is not copied once more."""
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))


def unframe(data: bytes, at: int) -> bytes:
    """The payload of the record at this offset; ValueError if a checksum differs."""
    head = data[at : at + 8]
    (n,) = struct.unpack("<Q", head)
    payload = data[at + 12 : at + 12 + n]
    if struct.unpack_from("<I", data, at + 8)[0] != masked(head) or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload


#: A word's closing ASCII marks before white space: the pre-tokenizer cuts in front of them too.
#: Apostrophes stay, for it knows contractions.
CLOSING = re.compile(rb"(?<=[a-z0-9])([!-&(-/:-@\[-`{-~]+)(?=\s|\Z)")


class Known(dict):
    """Packed ids of pieces; asks `learn` for those that are missing."""

    def __init__(self, learn: Callable[[bytes], bytes]):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece: bytes) -> bytes:
        found = self[piece] = self.learn(piece)
        return found


# What a tokenizer's file says if texts may be cut into pieces, and the special tokens begin with MARK
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
MARK = "<|"


def cuts_in_pieces(config: dict) -> bool:
    """Whether a tokenizer is a byte-level BPE that lower-cases, drops white space and marks the ends of words."""
    before, model = config.get("pre_tokenizer") or {}, config.get("model") or {}
    steps = before.get("pretokenizers") or [{}, {}]
    split = steps[0].get("pattern", {}).get("Regex") == PRE_TOKEN and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
    byte_level = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex", True)
    bpe = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not (model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"))
    special = all(t["content"].startswith(MARK) for t in config.get("added_tokens") or ())
    return (config.get("normalizer") or {}).get("normalizers") == NORMALIZERS and split and byte_level and bpe and special


class PieceEncoder:
    """Ids of whole texts as packed integers, through a bounded cache of pieces of texts.

    For byte-level BPE tokenizers that lower-case, drop white space and mark the ends of
    words. Words of letters are one pre-token each, so that only the model is asked for them.
    Of any other tokenizer the library encodes each text whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = not cuts_in_pieces(json.loads(self.tokenizer.to_str()))
        self.merge = self.tokenizer.model.tokenize
        self.width = 2 if max(self.tokenizer.get_vocab().values()) < 65_536 else 4
        self.kind = "H" if self.width == 2 else "I"
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.known = Known(self.learn)  # this and the last generation
        self.older: dict[bytes, bytes] = {}

    def encode(self, text: bytes) -> bytes:
        if self.whole:
            return array(self.kind, self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()
        if len(self.known) > CACHE_PIECES:
            self.older, self.known = self.known, Known(self.learn)
        # "<|" may begin a special token, whose case counts
        pieces = text.split() if b"<|" in text else CLOSING.sub(rb" \1", text.lower()).split()
        return b"".join(map(self.known.__getitem__, pieces))

    def learn(self, piece: bytes) -> bytes:
        found = dict.get(self.older, piece)
        if found is None:
            text = piece.decode()
            if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
                ids = [t.id for t in self.merge(text if text.isascii() else piece.decode("latin-1").translate(self.alphabet))]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            found = array(self.kind, ids).tobytes()
        return found


def encoder_of(path: str, made: dict = {}) -> PieceEncoder:  # noqa: B006
    """One encoder for each worker process, whose cache serves its later tasks too."""
    if path not in made:
        made[path] = PieceEncoder(path)
    return made[path]


def open_fs(path: str):
    """pyarrow's file system and path of a folder; Spark's names of S3 stores are pyarrow's s3."""
    from pyarrow import fs

    path = re.sub("^s3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_records(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes record and index files of all documents to the folder `out`; returns the manifest."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part = encoder_of(tokenizer), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], f"<u{encoder.width}").tobytes()
        store, root = open_fs(out)
        store.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        entries, at, total = [], 0, 0
        with store.open_output_stream(f"{root}/{name}.rec") as data:
            for rows in batches:
                ids = rows["__id"].astype("Int64")
                flags, ids = ids.isna().tolist(), ids.fillna(0).tolist()
                for text, doc, null in zip(rows["__text"], ids, flags, strict=True):
                    payload = encoder.encode(text or b"") + end
                    for part_of in frame(payload):
                        data.write(part_of)
                    n = len(payload) // encoder.width
                    entries.append((at, n, doc, null))
                    at += len(payload) + FRAME_BYTES
                    total += n
        if entries:
            with store.open_output_stream(f"{root}/{name}.idx") as index:
                index.write(np.array(entries, INDEX).tobytes())
            yield pd.DataFrame({"part": [part], "data": [f"{name}.rec"], "index": [f"{name}.idx"], "width": [encoder.width], "n_records": [len(entries)], "n_ids": [total]})

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text).cast("binary").alias("__text"))
    tie = F.xxhash64("__text")
    files = rows.repartitionByRange(F.col("__id").asc_nulls_first(), tie).sortWithinPartitions(F.col("__id").asc_nulls_first(), tie).mapInPandas(task, MANIFEST)
    return written(files, "token-manifest")


def read_records(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if asked for, ids) of every record, read back and verified; start counts all ids before."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    n = max(1, manifest.count())

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_fs(folder)
        for rows in batches:
            for r in rows.itertuples():
                with store.open_input_stream(f"{root}/{r.index}") as f:
                    index = np.frombuffer(f.read(), INDEX)
                start, kind = r.start + np.concatenate([[0], np.cumsum(index["n"])]), f"<u{r.width}"
                with store.open_input_stream(f"{root}/{r.data}") as f:
                    for a in range(0, len(index), 500):
                        out = []
                        for k in range(a, min(a + 500, len(index))):
                            head = f.read(12)
                            (size,) = struct.unpack_from("<Q", head)
                            ids = np.frombuffer(unframe(head + f.read(size + 4), 0), kind)
                            if len(ids) != index["n"][k]:
                                raise ValueError(f"{r.data}: record {k} is not as its index says")
                            doc = None if index["flags"][k] & NULL_ID else int(index["doc_id"][k])
                            out.append((doc, start[k], len(ids), zlib.crc32(ids.astype("<u4")), *([ids.astype(np.int32)] if with_ids else ())))
                        found = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])
                        yield found.assign(doc_id=found["doc_id"].astype("Int64"))

    return starts.repartition(n, "part").mapInPandas(task, RECORD + ", ids array<int>" * with_ids)


def read_at(folder: str, data: str, offset: int, width: int) -> np.ndarray:
    """One record by its offset, for shuffled reads."""
    store, root = open_fs(folder)
    with store.open_input_file(f"{root}/{data}") as f:
        f.seek(offset)
        head = f.read(12)
        return np.frombuffer(unframe(head + f.read(struct.unpack_from("<Q", head)[0] + 4), 0), f"<u{width}")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written and read back."""
    import public_tokenizers

    folder = fresh_path(spark, "token-records")
    manifest = write_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_records(manifest, folder, with_ids=False)
