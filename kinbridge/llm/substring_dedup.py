"""Substring deduplication over words by super-k-mer partitioning.

Words are ``[^\\x20\\x09-\\x0D]+``; a window is ``window`` consecutive words of one document.  Windows that
share a minimiser travel as one packed string to its bucket, where sorting counts them exactly; of
equal strings the first two take part, those after them go as the second does, and windows of crowded buckets go
by two 64-bit hashes (see ``superkmers``).

Null or empty texts have no words and stay empty; texts shorter than a window lose nothing; documents
without an id come before the ids from 0 on, and equal texts without ids are documents of their own; repeated
rows (equal id and text) are one document and get equal results; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinbridge.llm.superkmers import Units, clean_texts, covered

WINDOW, GRAM = 20, 5
#: Places of a bucket that one worker sorts in memory.
HOT = 16_000


def sorted_windows(window: int):
    """The windows of the strings of whole buckets, sorted with their places: ``later`` or ``all`` of each run of equals."""

    def solve(strings: list[bytes], mode: str) -> tuple[np.ndarray, np.ndarray]:
        entries = []
        for i, packed in enumerate(strings):
            words = packed.split(b" ")
            entries += [(b" ".join(words[j : j + window]), i, j) for j in range(len(words) - window + 1)]
        # strings come in order of bucket, document and place, and equal windows share a bucket
        entries.sort()
        out = []
        for k, (text, i, j) in enumerate(entries):
            if k and entries[k - 1][0] == text or mode == "all" and k + 1 < len(entries) and entries[k + 1][0] == text:
                out.append((i, j))
        out.sort()
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    return solve


CLEANED = "n_words long, n_removed long, kept_sha256 string, kept_text string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, mode: str = "later", id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row a document: its id, words, removed words, and the words that stay, joined by one space."""

    def clean(texts: list[bytes], runs: list) -> list[pa.Array]:
        rows = []
        for text, found in zip(texts, runs, strict=True):
            words = text.split()
            gone, kept, at = 0, [], 0
            for a, b in covered(found or [], window, len(words)):
                kept += words[at:a]
                gone, at = gone + b - a, b
            out = b" ".join(kept + words[at:])
            rows.append((len(words), gone, hashlib.sha256(out).hexdigest(), out.decode("utf-8", "replace")))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]

    return clean_texts(docs, Units("words", window, min(GRAM, window)), mode, sorted_windows(window), clean, CLEANED, id_col, text_col, hot)
