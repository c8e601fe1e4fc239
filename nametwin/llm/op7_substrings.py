"""Removal of byte strings that occur twice, by prefix-free parsing.

Rolling-hash triggers part the corpus into phrases that overlap by one window less a
byte; equal phrases are one entry of a dictionary, and the corpus is a parse over it, so
text that repeats costs an entry once (`windows`). Of the suffix order of dictionary
and parse only the classes of equal suffixes to the depth of a window matter here, and
those are what the fingerprints of entries and of their windows give: no task holds the
dictionary, and no suffix is written out.

Null or empty text, or one shorter than a window: nothing removed. Null ids and rows
that repeat count as documents of their own, so a repeated row loses all its windows.
Texts are cut at byte borders, so what is left need not be valid UTF-8. No rows: no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nametwin.llm.windows import _text, byte_units, covered, keyed, repeated, stripped

LENGTH = 200
GRAM = 100
ROWS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _strip(length: int, digest: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, runs in zip(b.column(1), b.column(2), strict=True):
            raw = np.frombuffer(_text(text), np.uint8)
            gone = covered(runs, len(raw), length)
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = raw[~gone].tobytes()
            rows.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).digest() if digest else kept))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = [pa.int64()] * 3 + [pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept bytes, or their SHA-256 with `digest`."""
    texts = keyed(docs)
    runs = repeated(texts, byte_units, length, gram, spare_first=False)
    return stripped(texts, runs, partial(_strip, length, digest), ROWS)
