"""Language of documents by a linear-chain conditional random field over words.

Each word has scores by label from its affixes (n-grams with a word border), its other
n-grams of 2 to 4 bytes, and the languages in whose lexicon it stands. Labels follow
each other with learned transitions, so words of a code-switched text get their label
from their neighbours too. Forward-backward gives each word's label probabilities; a
document's language is that of the largest mean, its score that mean. Chains run over
stretches of `STRETCH` words, all words of a text included.

The field is fitted on a bounded sample: at most `SAMPLE_DOCS` documents of a language,
rows alike in id and text counted as one, `SEGMENTS` stretches of `SEGMENT_WORDS` words
(`SEGMENT_CHARS` characters at most) from each, joined in twos and threes so that the
language changes inside. Only text and lang of documents whose
crc32(doc_id as text) mod 4 is not 2 are read for it.

Null text or one without a letter: `und`, score 0. Null doc_id: predicted, not held out,
not learned from. Null lang: not learned from. Nothing to learn from: all `und`. Equal
means: the first label in order. Repeated rows are predicted each. No rows: no rows.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = 1000  # the most frequent ones are learned
SAMPLE_DOCS = 200
SEGMENTS = 3
SEGMENT_WORDS = 24
SEGMENT_CHARS = 2000
LEXICON = 400  # words a language at most
TABLE = 1 << 16  # rows of hashed n-gram weights
NGRAMS = (2, 3, 4)
STRETCH = 256
PIECE = 1 << 20  # bytes whose features are held at a time
EPOCHS = 12
RATE = 0.3
DECAY = 1e-4
UNKNOWN = "und"
SPAN = 1 << 52  # of the draw
SPLITS, HELD = 4, 2  # fixed values: held out is crc32 mod 4 = 2

ROWS = "doc_id long, lang_pred string, score double"


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(SPLITS))


@dataclass
class Words:
    """Words of some text as n-gram rows of each byte, with where each word starts."""

    rows: list[np.ndarray]  # for each n, the weight row of the n-gram that starts at a byte
    starts: np.ndarray  # of a word's bytes, its leading border included
    hashes: np.ndarray


def read_words(raw: bytes) -> Words:
    """Words are runs of a-z and of bytes from 0x80 up; `raw` is in lower case."""
    data = np.frombuffer(raw, np.uint8)
    ink = ((data >= 97) & (data <= 122)) | (data >= 128)
    keep = ink.copy()
    keep[1:] |= ink[:-1]
    text = np.concatenate([[32], np.where(ink, data, 32)[keep], [32]]).astype(np.uint32)
    if text[-2] == 32:
        text = text[:-1]
    border = text == 32
    starts = np.flatnonzero(border)[:-1]
    rows = []
    for n in NGRAMS:
        if len(text) < n:
            rows.append(np.zeros(len(text), np.int64))
            continue
        size = len(text) - n + 1
        h = np.full(size, n, np.uint32)
        fine = np.ones(size, bool)
        for i in range(n):
            h = (h ^ text[i : i + size]) * np.uint32(16777619)
            if 0 < i < n - 1:
                fine &= ~border[i : i + size]
        if n == 2:
            fine &= ~(border[:-1] & border[1:])
        h ^= h >> np.uint32(15)
        row = np.where(fine, h % np.uint32(TABLE - 1) + np.uint32(1), 0)  # row 0 is empty
        rows.append(np.concatenate([row, np.zeros(n - 1, row.dtype)]).astype(np.int64))
    if not len(starts):
        return Words(rows, starts, np.zeros(0, np.uint64))
    place = np.arange(len(text)) - np.repeat(starts, np.diff(np.append(starts, len(text))))
    weight = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    value = (text.astype(np.uint64) + np.uint64(7)) * weight
    value ^= value >> np.uint64(32)
    return Words(rows, starts, np.add.reduceat(value, starts))


@dataclass
class Field:
    labels: list[str]
    table: np.ndarray  # TABLE x labels
    lexicon: np.ndarray  # sorted word hashes
    member: np.ndarray  # of each, which lexicons it is in, as 0 and 1
    lexicon_weight: np.ndarray  # labels x labels
    moves: np.ndarray  # transition scores

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Lexicon membership of words."""
        if not len(self.lexicon):
            return np.zeros((len(hashes), len(self.labels)), np.float32)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return self.member[at] * (self.lexicon[at] == hashes)[:, None]

    def scores(self, words: Words) -> np.ndarray:
        if not len(words.starts):
            return np.zeros((0, len(self.labels)), np.float32)
        each = self.table[words.rows[0]]
        for r in words.rows[1:]:
            each += self.table[r]
        return np.add.reduceat(each, words.starts, axis=0) + self.known(words.hashes) @ self.lexicon_weight


def forward_backward(
    scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(label probabilities, expected transitions) of chains (n, steps, labels), longest first."""
    n, steps, k = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(np.float64)
    step = np.exp(moves - moves.max())
    ahead = np.ones((n, steps, k)) / k
    active = [int((lengths > t).sum()) for t in range(steps)]
    for t in range(steps):
        on = active[t]
        a = local[:on, t] if t == 0 else (ahead[:on, t - 1] @ step) * local[:on, t]
        ahead[:on, t] = a / a.sum(axis=1, keepdims=True)
    behind = np.ones((n, steps, k))
    pairs = np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        on = active[t + 1]
        b = behind[:on, t + 1] * local[:on, t + 1]
        joint = ahead[:on, t, :, None] * step[None] * b[:, None, :]
        total = joint.sum(axis=(1, 2), keepdims=True)
        pairs += (joint / total).sum(axis=0)
        b = b @ step.T
        behind[:on, t] = b / b.sum(axis=1, keepdims=True)
    both = ahead * behind
    return both / both.sum(axis=2, keepdims=True), pairs


def chains(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Label probabilities summed over the words of each of some documents laid end to end."""
    k = scores.shape[1]
    first = np.cumsum(sizes) - sizes
    count = -(-sizes // STRETCH)
    doc = np.repeat(np.arange(len(sizes)), count)
    part = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = first[doc] + part * STRETCH
    length = np.minimum(STRETCH, sizes[doc] - part * STRETCH)
    out = np.zeros((len(sizes), k))
    order = np.argsort(-length, kind="stable")
    for at in range(0, len(order), 2048):
        rows = order[at : at + 2048]
        steps = int(length[rows[0]])
        index = np.minimum(start[rows, None] + np.arange(steps)[None], len(scores) - 1)
        real = np.arange(steps)[None] < length[rows, None]
        found = _posterior(scores[index], moves, length[rows])
        np.add.at(out, doc[rows], (found * real[:, :, None]).sum(axis=1))
    return out


def _posterior(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Forward-backward without the transition counts."""
    n, steps, k = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(np.float64)
    step = np.exp(moves - moves.max())
    active = [int(np.searchsorted(-lengths, -t)) for t in range(steps)]
    ahead = np.ones((steps, n, k))
    local = np.ascontiguousarray(local.transpose(1, 0, 2))
    a = local[0] / local[0].sum(axis=1, keepdims=True)
    ahead[0] = a
    for t in range(1, steps):
        on = active[t]
        a = (a[:on] @ step) * local[t, :on]
        a /= a.sum(axis=1, keepdims=True)
        ahead[t, :on] = a
    behind = np.ones((n, k))
    for t in range(steps - 2, -1, -1):
        on = active[t + 1]
        b = (behind[:on] * local[t + 1, :on]) @ step.T
        behind[:on] = b / b.sum(axis=1, keepdims=True)
        ahead[t, :on] *= behind[:on]
    ahead /= ahead.sum(axis=2, keepdims=True)
    return ahead.transpose(1, 0, 2)


def fit(segments: list[tuple[str, str]], seed: int = 7) -> Field | None:
    """A field from (text, language) stretches."""
    labels = sorted({lang for _, lang in segments})
    if not labels:
        return None
    k = len(labels)
    rng = np.random.default_rng(seed)
    segments = sorted(segments)
    order = rng.permutation(len(segments))
    words = read_words(" ".join(segments[i][0] for i in order).lower().encode())
    sizes = [len(read_words(segments[i][0].lower().encode()).starts) for i in order]
    truth = np.repeat([labels.index(segments[i][1]) for i in order], sizes)

    unique, at = np.unique(words.hashes, return_inverse=True)
    seen = np.zeros((len(unique), k))
    np.add.at(seen, (at, truth), 1)
    member = np.zeros_like(seen, dtype=np.float32)
    for j in range(k):
        sure = np.flatnonzero((seen[:, j] >= 3) & (seen[:, j] > 0.8 * seen.sum(axis=1)))
        member[sure[np.argsort(-seen[sure, j], kind="stable")[:LEXICON]], j] = 1
    stands = member.any(axis=1)
    field = Field(
        labels,
        np.zeros((TABLE, k), np.float32),
        unique[stands],
        member[stands],
        np.zeros((k, k), np.float32),
        np.zeros((k, k)),
    )
    firsts = np.cumsum(sizes) - sizes
    spans = [(f, s) for f, s in zip(firsts, sizes, strict=True) if s]
    word_of = np.repeat(np.arange(len(words.starts)), np.diff(np.append(words.starts, len(words.rows[0]))))
    known = field.known(words.hashes)
    squares = [np.full_like(field.table, 1e-6), np.full_like(field.lexicon_weight, 1e-6), np.full((k, k), 1e-6)]

    def ascend(weights: np.ndarray, change: np.ndarray, square: np.ndarray) -> None:
        square += change * change
        weights += RATE * change / np.sqrt(square)

    for _ in range(EPOCHS):
        mixed = rng.permutation(len(spans))
        while len(mixed):
            sequences = []
            while len(mixed) and len(sequences) < 64:
                take = int(rng.integers(1, 4))
                sequences.append(np.concatenate([np.arange(f, f + s) for f, s in (spans[i] for i in mixed[:take])]))
                mixed = mixed[take:]
            sequences.sort(key=len, reverse=True)
            lengths = np.array([len(s) for s in sequences])
            index = np.zeros((len(sequences), lengths[0]), np.int64)
            for row, s in zip(index, sequences, strict=True):
                row[: len(s)] = s
            real = np.arange(lengths[0])[None] < lengths[:, None]
            used = index[real]
            scores = field.scores(words)[index] if len(words.starts) < 4096 else _some(field, words, known, word_of, index)
            found, pairs = forward_backward(scores, field.moves, lengths)
            gap = -found[real]
            gap[np.arange(len(used)), truth[used]] += 1
            per_word = np.zeros((len(words.starts), k), np.float32)
            np.add.at(per_word, used, gap.astype(np.float32))
            touched = np.isin(word_of, used)
            change = np.zeros_like(field.table)
            for r in words.rows:
                np.add.at(change, r[touched], per_word[word_of[touched]])
            change[0] = 0
            ascend(field.table, change - DECAY * field.table, squares[0])
            field.table[0] = 0
            ascend(field.lexicon_weight, known[used].T @ gap.astype(np.float32), squares[1])
            step = np.zeros((k, k))
            for s in sequences:
                np.add.at(step, (truth[s[:-1]], truth[s[1:]]), 1)
            ascend(field.moves, step - pairs, squares[2])
    return field


def _some(field: Field, words: Words, known: np.ndarray, word_of: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Scores of the words of `index` alone."""
    wanted, place = np.unique(index, return_inverse=True)
    on = np.flatnonzero(np.isin(word_of, wanted))
    each = field.table[words.rows[0][on]]
    for r in words.rows[1:]:
        each += field.table[r[on]]
    first = np.searchsorted(word_of[on], wanted)
    scores = np.add.reduceat(each, first, axis=0) + known[wanted] @ field.lexicon_weight
    return scores[place.reshape(index.shape)]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, langs = [], []
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = text.split()
            draw = np.random.default_rng(zlib.crc32(text.encode()))
            for at in draw.integers(0, max(1, len(found) - SEGMENT_WORDS + 1), SEGMENTS):
                texts.append(" ".join(found[at : at + SEGMENT_WORDS])[:SEGMENT_CHARS])
                langs.append(lang)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(langs, pa.string())], names=["text", "lang"])


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(text, lang) of at most `sample_docs` labelled documents of a language that are not held out.

    The draw is by a hash of id and text, so copies of a row cannot crowd out others. A
    filter by the number of different rows, roughly counted, leaves few more than are
    wanted; those are ranked.
    """
    open_ = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != HELD))
    open_ = open_.withColumn("draw", F.xxhash64("doc_id", "text"))
    counts = open_.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("draw").alias("different")
    )
    kinds = counts.orderBy(F.desc("n"), "lang").limit(LABELS)
    share = F.pmod("draw", F.lit(SPAN)) / F.lit(float(SPAN))
    some = open_.join(F.broadcast(kinds), "lang").filter(share * F.col("different") < 1.5 * sample_docs + 50)
    some = some.groupBy("lang", "doc_id", "text", "draw").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(SPAN)), "doc_id", "text")
    return some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample_docs).select("text", "lang")


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field | None:
    """Fit on a sample of the labelled documents that are not held out."""
    rows = sample(docs, sample_docs).mapInArrow(_segments, "text string, lang string").collect()
    return fit([(r["text"], r["lang"]) for r in rows])


def lettered(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text cut at spaces, or in a run of letters where there is none."""
    at = 0
    while len(raw) - at > PIECE:
        cut = raw.rfind(b" ", at, at + PIECE) + 1
        cut = cut if cut > at else at + PIECE
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def label(field: Field | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if field is None:
        return langs, scores
    use = [i for i, t in enumerate(texts) if lettered(t)]
    found, sizes = [], []
    for i in use:
        own = [field.scores(read_words(p)) for p in _pieces(texts[i].lower().encode())]
        found += own
        sizes.append(sum(map(len, own)))
    if not sum(sizes):
        return langs, scores
    total = chains(np.concatenate(found), np.array(sizes), field.moves)
    for i, n, sums in zip(use, sizes, total, strict=True):
        if n:
            best = int(np.argmax(sums))
            langs[i], scores[i] = field.labels[best], min(1.0, float(sums[best] / n))
    return langs, scores


SLICE = 256  # texts labelled together


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _predict(field: Field | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        langs, scores = label(field, part.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
            names=["doc_id", "lang_pred", "score"],
        )


def _keep(
    field: Field | None, min_score: float, column: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        texts = part.column(column).to_pylist()
        if field is None:
            good = [lettered(t) for t in texts]
        else:
            good = [lang != UNKNOWN and s >= min_score for lang, s in zip(*label(field, texts), strict=True)]
        yield part.filter(pa.array(good, pa.bool_()))


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, lang_pred, score): a row a document."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(lambda batches: _predict(shared.value, batches), ROWS)


def recognised(docs: DataFrame, min_score: float) -> DataFrame:
    """The rows of `docs` whose text has a language with at least `min_score`.

    If nothing can be learned, all rows whose text has a letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))
    column = docs.columns.index("text")
    return docs.mapInArrow(lambda batches: _keep(shared.value, min_score, column, batches), docs.schema)


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from `docs` itself."""
    held = F.coalesce(remainder(F.col("doc_id")) == HELD, F.lit(False)).alias("held_out")
    return predict(docs, learn(docs)).select("doc_id", held, "lang_pred", "score")
