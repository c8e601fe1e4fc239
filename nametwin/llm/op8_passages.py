"""Removal of repeated passages of words, by shared anchors.

Documents meet on winnowed anchors: of every window of words the gram of least hash.
Matches are not extended word by word: what surrounds a shared anchor is grouped by
128-bit hash, first whole phrases, then single windows where phrases differ (`windows`);
overlapping windows with an earlier copy add up to maximal repeats of at least a window.

Earlier means smaller doc_id (null last), then, for one id on several texts, smaller
hash, then earlier start. Rows that repeat both id and text are one document and each
gets its result. Null, empty or short text: nothing removed. No rows: no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from nametwin.llm.windows import _text, covered, keyed, repeated, stripped, word_units

LENGTH = 20
GRAM = 4
ROWS = "doc_id long, n_words long, n_removed long, kept binary"


def _strip(length: int, digest: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, runs in zip(b.column(1), b.column(2), strict=True):
            words = _text(text).split()
            gone = covered(runs, len(words), length)
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).digest() if digest else kept))
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        kinds = [pa.int64()] * 2 + [pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def first_only(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words, or the SHA-256 of them with `digest`."""
    texts = keyed(docs)
    runs = repeated(texts, word_units, length, gram, spare_first=True)
    return stripped(texts, runs, partial(_strip, length, digest), ROWS)
