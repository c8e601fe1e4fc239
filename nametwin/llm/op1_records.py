"""Token ids as length-delimited binary records, with an offset index.

A shard `part-NNNNN.rec` is a run of frames: length (8 bytes), masked CRC-32C of
those 8 bytes (4), payload, masked CRC-32C of the payload (4), all little-endian.
A payload is the document id (8 bytes), flags (1 byte: 1 no id, 2 wide ids), 3 zero
bytes, then the ids, 2 bytes each, or 4 if the vocabulary needs it. Beside it,
`part-NNNNN.idx` holds offset and length (8 bytes each) of every frame, so records
can be fetched in any order. Shards are in ascending order of id, and so are the
records of a shard.

Null text: empty, so the end id alone. Null id: kept, before all others. Equal ids:
by hash of the text. Rows may repeat; each is a record. No rows: no records. Other
columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nametwin.llm.common import filesystem
from nametwin.llm.tokens import encoder
from nametwin.operators.keep import settle

POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected
MASK_DELTA = 0xA282EAD8  # added to a rotated checksum
CHUNK = 256  # bytes that one lane of the checksum takes
HEAD = "<qB3x"
HEAD_BYTES = struct.calcsize(HEAD)
NO_ID, WIDE = 1, 2
FLUSH = 4 << 20  # bytes checked or written at a time

MANIFEST = "shard int, n_records long, n_tokens long, n_bytes long"
ROWS = "doc_id long, shard int, start_in_shard long, n_tokens long, ids_crc32 long"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(65536, dtype=np.uint32)
    for _ in range(16):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1)
    shift = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for _ in range(CHUNK // 2):  # what CHUNK zero bytes make of a checksum
        shift = step[shift & 0xFFFF] ^ (shift >> 16)
    return step, shift.reshape(4, 256)


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of byte strings of 4 bytes or more, all lanes of all strings at once.

    Leading zeros leave an all-zero register alone, so each string is padded in
    front to whole lanes; the register's initial ones go into its first 4 bytes.
    """
    step, shift = _tables()
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    lanes = -(-sizes // CHUNK)
    first = np.concatenate(([0], np.cumsum(lanes)))
    data = np.zeros(int(first[-1]) * CHUNK, dtype=np.uint8)
    for p, end in zip(parts, first[1:] * CHUNK, strict=True):
        data[end - len(p) : end] = np.frombuffer(p, dtype=np.uint8)
    begin = first[1:] * CHUNK - sizes
    data[(begin[:, None] + np.arange(4)).ravel()] ^= 0xFF
    words = np.ascontiguousarray(data.view("<u2").reshape(-1, CHUNK // 2).T)
    crc = np.zeros(words.shape[1], dtype=np.uint32)
    for w in words:
        crc = step[(crc ^ w) & 0xFFFF] ^ (crc >> 16)
    total = np.zeros(len(parts), dtype=np.uint32)
    for j in range(int(lanes.max(initial=0))):
        on = np.flatnonzero(lanes > j)
        t = total[on]
        moved = shift[0][t & 255] ^ shift[1][t >> 8 & 255] ^ shift[2][t >> 16 & 255] ^ shift[3][t >> 24]
        total[on] = moved ^ crc[first[on] + j]
    return total ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK_DELTA)


def frames(payloads: list[bytes]) -> list[bytes]:
    sizes = [struct.pack("<Q", len(p)) for p in payloads]
    checks = masked(crc32c(sizes + payloads)).astype("<u4")
    n = len(payloads)
    return [
        b"".join((s, checks[i].tobytes(), p, checks[n + i].tobytes()))
        for i, (s, p) in enumerate(zip(sizes, payloads, strict=True))
    ]


def _verify(found: list[tuple[bytes, bytes, bytes, bytes]], where: str) -> None:
    parts = [f[0] for f in found] + [f[2] for f in found]
    said = np.frombuffer(b"".join([f[1] for f in found] + [f[3] for f in found]), dtype="<u4")
    if not np.array_equal(masked(crc32c(parts)), said):
        raise ValueError(f"{where}: a record does not match its checksum")


def read_payload(folder: str, shard: int, number: int) -> bytes:
    """One record by its place in the index, for reads in any order."""
    fs, path = filesystem(folder)
    with fs.open_input_file(f"{path}/part-{shard:05d}.idx") as index:
        index.seek(16 * number)
        offset, length = struct.unpack("<QQ", index.read(16))
    with fs.open_input_file(f"{path}/part-{shard:05d}.rec") as file:
        file.seek(offset)
        frame = file.read(length)
    found = (frame[:8], frame[8:12], frame[12:-4], frame[-4:])
    _verify([found], f"shard {shard}, record {number}")
    return found[2]


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of a payload."""
    doc_id, flags = struct.unpack_from(HEAD, payload)
    ids = np.frombuffer(payload, dtype="<u4" if flags & WIDE else "<u2", offset=HEAD_BYTES)
    return (None if flags & NO_ID else doc_id), ids


def _writer(folder: str, tokenizer: str, pieces: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        coder = encoder(tokenizer, pieces)
        end = coder.pack([end_id])
        wide = WIDE if coder.width == 4 else 0
        fs, path = filesystem(folder)
        attempt = uuid.uuid4().hex
        names = {kind: f"{path}/part-{shard:05d}.{kind}" for kind in ("rec", "idx")}
        n_tokens = offset = n_records = 0
        waiting: list[bytes] = []
        size = 0
        with (
            fs.open_output_stream(f"{names['rec']}.{attempt}") as out,
            fs.open_output_stream(f"{names['idx']}.{attempt}") as index,
        ):

            def flush() -> None:
                nonlocal offset, waiting, size
                done = frames(waiting) if waiting else []
                out.write(b"".join(done))
                ends = offset + np.cumsum([0, *map(len, done)])
                index.write(np.stack([ends[:-1], np.diff(ends)], axis=1).astype("<u8").tobytes())
                offset, waiting, size = int(ends[-1]), [], 0

            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    ids = coder.encode(text.as_py()) + end
                    n_tokens += len(ids) // coder.width
                    n_records += 1
                    known = doc_id.as_py()
                    head = struct.pack(HEAD, known or 0, wide | (NO_ID if known is None else 0))
                    waiting.append(head + ids)
                    size += len(ids)
                    if size > FLUSH:
                        flush()
            flush()
        for name in names.values():  # another attempt would move the same bytes here
            fs.move(f"{name}.{attempt}", name)
        columns = [[shard], [n_records], [n_tokens], [offset]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [pa.int32()] + [pa.int64()] * 3, strict=True)],
            names=["shard", "n_records", "n_tokens", "n_bytes"],
        )

    return write


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, pieces: str = "byte", end_id: int = 0
) -> DataFrame:
    """Encode `doc_id`, `text` into shards in `folder`; one manifest row per shard."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h")]
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sorted_docs = (
        texts.withColumn("_h", F.xxhash64("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    manifest = settle(sorted_docs.mapInArrow(_writer(folder, tokenizer, pieces, end_id), MANIFEST))
    with fs.open_output_stream(f"{path}/about.json") as out:
        out.write(json.dumps({"tokenizer": tokenizer.rsplit("/", 1)[-1], "end_id": end_id}).encode())
    return manifest


def _shard_records(stream, where: str) -> Iterator[bytes]:
    """Payloads of a shard, checked in batches."""
    found: list[tuple[bytes, bytes, bytes, bytes]] = []
    size = 0
    while head := stream.read(12):
        (length,) = struct.unpack_from("<Q", head)
        body = stream.read(length + 4)
        if len(head) < 12 or len(body) < length + 4:
            raise ValueError(f"{where} is cut short")
        found.append((head[:8], head[8:], body[:-4], body[-4:]))
        size += len(body)
        if size > FLUSH:
            _verify(found, where)
            yield from (f[2] for f in found)
            found, size = [], 0
    if found:
        _verify(found, where)
        yield from (f[2] for f in found)


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "shard", "start_in_shard", "n_tokens", "ids_crc32"]
        for shard in (s.as_py() for b in batches for s in b.column(0)):
            start, rows = 0, []
            name = f"{path}/part-{shard:05d}.rec"
            with fs.open_input_stream(name, buffer_size=1 << 20) as stream:
                for payload in _shard_records(stream, name):
                    doc_id, ids = parse(payload)
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    rows.append((doc_id, shard, start, len(ids), crc))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _batch(rows, kinds, names)
                        rows = []
            if rows:
                yield _batch(rows, kinds, names)

    return read


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
    )


def read_records(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, from the shards' bytes.

    One task a shard. Starts of the shards are a running sum of one row a file.
    """
    n = manifest.count()
    rows = spark.range(0, n, 1, max(1, n)).mapInArrow(_reader(folder), ROWS)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select(
        "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start")
    )
    return rows.join(F.broadcast(starts), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32"
    )
