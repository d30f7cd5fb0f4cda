"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The model is serialised directly from the vocabulary: each token's bytes map to printable characters,
one a byte, and make a piece scored by its negative rank; normalisation is the identity.  Texts split
into pre-tokens by the tokenizer's pattern.  A pre-token that is a token itself is that token; any other
is encoded by the model.  Decoding maps each id's piece back to bytes.

Null texts are empty and have no tokens; repeated rows get equal results; very long texts are split
piece by piece and never cut; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinbridge.llm.common import small_batches

#: White space by the Unicode property; Python's own \\s holds four more characters.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Splits only next to white space, where the tokenizer's pattern also splits.
CHUNKS = f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [], 0x100
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Of a rank file: lines of a token in base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """A protobuf field: a length-delimited value, a varint or a 32-bit float."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: pieces in order of rank, id = rank; the unknown piece comes last."""
    chars = byte_characters()
    order = sorted(ranks, key=ranks.__getitem__)
    out = [_field(1, _field(1, "".join(chars[b] for b in t)) + _field(2, float(-ranks[t])) + _field(3, 1)) for t in order]
    out.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    n = len(order)
    # TrainerSpec: model_type BPE (3), vocab_size (4), byte_fallback off, unk_id (40), no bos, eos and pad (41-43)
    none = (1 << 64) - 1
    out.append(_field(2, _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, none) + _field(42, none) + _field(43, none)))
    # NormalizerSpec: identity, no dummy prefix (3), white space kept (4) and not escaped (5)
    out.append(_field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """Encodes and decodes texts; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_kept: int = 300_000):
        import re

        import regex
        import sentencepiece

        if sorted(ranks.values()) != list(range(len(ranks))):
            order = sorted(ranks, key=ranks.__getitem__)
            self.to_rank: list[int] | None = [ranks[t] for t in order]
        else:
            self.to_rank = None
        self.ranks = ranks
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        # each id's piece back to bytes
        back = {ord(c): b for b, c in enumerate(byte_characters())}
        pieces = [bytes(back[ord(c)] for c in self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.piece = dict(enumerate(pieces)) if self.to_rank is None else {r: pieces[i] for i, r in enumerate(self.to_rank)}
        self.table = byte_characters()
        self.chunks = re.compile(CHUNKS).findall
        # \\s of the pattern by the Unicode property
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")).findall
        self.kept: dict[str, list[int]] = {}
        self.most_kept = most_kept

    def pre_token(self, text: bytes) -> list[int]:
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        ids = self.model.encode("".join(map(self.table.__getitem__, text)))
        return ids if self.to_rank is None else [self.to_rank[i] for i in ids]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        kept = self.kept
        for chunk in self.chunks(text):
            ids = kept.get(chunk)
            if ids is None:
                ids = [i for t in self.split(chunk) for i in self.pre_token(t.encode("utf-8", "surrogatepass"))]
                if len(chunk) < 64:
                    if len(kept) >= self.most_kept:
                        kept.clear()
                    kept[chunk] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids))


@cache
def _codec(name: str, pattern: str) -> Codec:
    with open(SparkFiles.get(name), "rb") as f:
        return Codec(read_ranks(f.read()), pattern)


ENCODED = "n_tokens long, ids array<int>, decoded binary, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row a document: its id, token count, ids, decoded bytes and the digests of both.

    The rank file (a fixed vocabulary) goes to every executor with SparkContext.addFile.  with_ids: false
    leaves ids and decoded null after their digests are taken.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(rank_file)
    name = rank_file.rstrip("/").rsplit("/", 1)[-1]
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        for part in small_batches(batches):
            counts, all_ids, texts, sha_ids, sha_texts = [], [], [], [], []
            for text in part["text"]:
                ids = codec.encode(text.as_py() or "")
                data = codec.decode(ids)
                packed = np.array(ids, "<u4")
                counts.append(len(ids))
                sha_ids.append(hashlib.sha256(packed.tobytes()).hexdigest())
                sha_texts.append(hashlib.sha256(data).hexdigest())
                all_ids.append(packed.view("<i4") if with_ids else None)
                texts.append(data if with_ids else None)
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(counts, pa.int64()), pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.binary()), pa.array(sha_ids, pa.string()), pa.array(sha_texts, pa.string())], names=["id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"])

    done = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {key}, {ENCODED}")
    return done.withColumnRenamed("id", id_col)
