"""Cost-balanced packing of documents into sequences of bounded length.

The cost of a piece of l tokens is l + quadratic * l**2, what its own attention and
the rest of a layer take. Documents are dealt to shards by a hash of id, text and row
number in their file, so that equal rows spread too; a shard is packed by itself. Pieces longer than a sequence are cut, then pieces go, longest first, to the
cheapest sequence that still has room; a piece that fits nowhere is cut at the
largest gap. A shard has as many full sequences as its tokens fill, and the rest goes
into sequences whose lengths are powers of two, so nothing is padded.

Null text: the end id alone. Null ids and repeated rows are packed as documents of
their own. Equal lengths: by doc_id, then ids. No rows: no pieces. Other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nametwin.llm.common import located
from nametwin.llm.tokens import ENTRIES, encoder

CAPACITY = 4096
SHARD_TOKENS = 1_000_000
BYTES_A_TOKEN = 2.5
QUADRATIC = 1 / 2048
SHARD_SPAN = 1 << 32  # sequence numbers a shard may use
TASK_SHARDS = 4  # packed by a task, one after another
MOST_TASKS = 20_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def _encoder(tokenizer: str, pieces: str, end_id: int, entries: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, pieces, entries)
        end = coder.pack([end_id])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [coder.encode(t.as_py()) + end for t in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(ids, pa.binary())], names=["shard", "doc_id", "ids"]
                )

    return encode


def assign(
    lengths: np.ndarray, capacity: int = CAPACITY, quadratic: float = QUADRATIC
) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces of a shard.

    `lengths` is in descending order.
    """
    total = int(lengths.sum())
    rest = total % capacity
    room = [capacity] * (total // capacity)
    room += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    left = np.array(room, dtype=np.int64)
    filled = np.zeros(len(room), dtype=np.int64)
    cost = np.zeros(len(room))
    out: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        out.append((doc, start, n, seq, int(filled[seq])))
        filled[seq] += n
        left[seq] -= n
        cost[seq] += n + quadratic * n * n

    pieces: list[tuple[int, int, int]] = []
    taken = 0
    for doc, n in enumerate(lengths.tolist()):
        start = 0
        while n - start >= capacity and taken < total // capacity:
            put(doc, start, capacity, taken)
            taken += 1
            start += capacity
        if n > start:
            pieces.append((n - start, doc, start))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    for n, doc, start in pieces:
        while n:
            fits = np.flatnonzero(left >= n)
            if len(fits):
                seq, part = int(fits[np.argmin(cost[fits])]), n
            else:
                seq = int(np.argmax(left))
                part = int(left[seq])
            put(doc, start, part, seq)
            start += part
            n -= part
    return out


def _packer(width: int, capacity: int, quadratic: float):
    kind = f"<u{width}"

    def pack(shard: pa.Table) -> pa.Table:
        number = shard.column(0)[0].as_py()
        doc_ids = shard.column(1).to_pylist()
        ids = [np.frombuffer(b, kind) for b in shard.column(2).to_pylist()]
        order = sorted(
            range(len(ids)),
            key=lambda i: (-len(ids[i]), doc_ids[i] is None, doc_ids[i] or 0, ids[i].tobytes()),
        )
        rows = []
        lengths = np.array([len(ids[i]) for i in order], dtype=np.int64)
        for doc, start, n, seq, offset in assign(lengths, capacity, quadratic):
            own = ids[order[doc]]
            crc = zlib.crc32(own[start : start + n].astype("<u4").tobytes())
            rows.append((doc_ids[order[doc]], start, n, crc, len(own), number * SHARD_SPAN + seq, offset))
        names = [f.split()[0] for f in PIECES.split(", ")]
        columns = zip(*rows, strict=True)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    return pack


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    pieces: str = "word",
    end_id: int = 2,
    capacity: int = CAPACITY,
    shard_tokens: int = SHARD_TOKENS,
    quadratic: float = QUADRATIC,
    entries: int = ENTRIES,
) -> DataFrame:
    """Where each piece of each document of `doc_id`, `text` lies; a row a piece.

    Only whole shards meet in one task, and their size is set by `shard_tokens`. A worker
    remembers about twice `entries` words, which is most of the memory it takes.
    """
    texts = located(docs).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"), "at"
    )
    n_bytes, n_rows = texts.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))
    ).first()
    shards = max(1, -int(-(n_bytes / BYTES_A_TOKEN + n_rows) // shard_tokens))
    dealt = texts.select(
        F.pmod(F.xxhash64("doc_id", "text", "at"), F.lit(shards)).cast("long").alias("shard"), "doc_id", "text"
    )
    width = encoder(tokenizer, pieces, entries).width
    coded = dealt.mapInArrow(
        _encoder(tokenizer, pieces, end_id, entries), "shard long, doc_id long, ids binary"
    )
    tasks = min(MOST_TASKS, -(-shards // TASK_SHARDS))
    return coded.repartition(tasks, "shard").groupBy("shard").applyInArrow(_packer(width, capacity, quadratic), PIECES)
