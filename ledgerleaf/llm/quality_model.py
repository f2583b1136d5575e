"""A byte-level convolutional network in numpy that scores whole texts for quality.

Every byte of a text is an input.  A filter is eight columns wide over one-hot
bytes, so the filters are tables of weights by place and byte, and convolving
is summing look-ups.  Texts are cut into halves of chunks; a chunk is two
neighbouring halves, so chunks overlap by half and cover the whole text.  Filter
outputs are max-pooled within a chunk; the mean and the maximum over the chunks,
weighed, make one logit and one probability.

Training is on the driver, on a bounded sample of labelled rows.  Training and
scoring take a piece of a text at a time and carry only the pooled values on, so
that a text of any length is read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.common import bound_batches, dealt

#: Filters, their width in bytes, and bytes of half a chunk.
FILTERS, WIDTH, HALF = 16, 8, 256
#: Labelled texts of each class used for training at most, and bytes of them together; epochs and step.
SAMPLE, SAMPLE_BYTES, EPOCHS, BATCH, STEP = 900, 4 << 20, 14, 32, 0.02
#: Bytes convolved at a time; a multiple of HALF.
PIECE_BYTES = 1 << 19
#: Inputs: 256 bytes and the padding.
CODES, PAD = 257, 256
#: Rows whose crc32(id as text) mod 3 is this are never learned from.
HELD_OUT = 1


def codes(data: bytes) -> np.ndarray:
    """The inputs of a text: its bytes."""
    return np.frombuffer(data, np.uint8).astype(np.int32)


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each filled up to whole halves; halves by text."""
    halves = np.array([max(1, -(-len(p) // HALF)) for p in parts])
    out = np.full(halves.sum() * HALF + WIDTH, PAD, np.int32)
    at = 0
    for p, h in zip(parts, halves, strict=True):
        out[at : at + len(p)] = p
        at += h * HALF
    return out, halves


def convolved(tables: np.ndarray, inputs: np.ndarray, buffer: np.ndarray | None = None) -> np.ndarray:
    """Filter outputs at each place but the last WIDTH, as (halves, HALF, FILTERS)."""
    n = len(inputs) - WIDTH
    total = np.take(tables[0], inputs[:n], axis=0)
    for k in range(1, WIDTH):
        total += np.take(tables[k], inputs[k : n + k], axis=0)
    return total.reshape(-1, HALF, FILTERS)


def chunk_max(pooled: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of ``halves`` each: the chunks' maxima, which half gave each, and where each text's chunks start."""
    follows = np.arange(1, len(pooled) + 1)
    ends = np.cumsum(halves) - 1
    follows[ends] = ends
    alone = halves == 1
    is_chunk = np.ones(len(pooled), bool)
    is_chunk[ends[~alone]] = False
    a, b = np.flatnonzero(is_chunk), follows[is_chunk]
    from_b = pooled[b] > pooled[a]
    starts = np.concatenate([[0], np.cumsum(np.where(alone, 1, halves - 1))[:-1]])
    return np.where(from_b, pooled[b], pooled[a]), np.where(from_b, b[:, None], a[:, None]), starts


class ByteNetwork:
    """Weights, scoring and training."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.05, (WIDTH, CODES, FILTERS)).astype(np.float32)
        self.tables[:, PAD] = 0
        self.bias = np.zeros(FILTERS, np.float32)
        self.mean_w = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.max_w = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.mean_w, self.max_w, self.offset]

    def pooled(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest output of each filter in each half of a text, piece by piece, and where in the text it is."""
        values, places = [], []
        for at in range(0, max(1, len(inputs)), PIECE_BYTES):
            x, _ = padded([inputs[at : at + PIECE_BYTES]])
            ahead = inputs[at + PIECE_BYTES : at + PIECE_BYTES + WIDTH]
            x[len(x) - WIDTH : len(x) - WIDTH + len(ahead)] = ahead
            out = convolved(self.tables, x)
            where = out.argmax(axis=1)
            values.append(np.take_along_axis(out, where[:, None], axis=1)[:, 0])
            places.append(where + (at + HALF * np.arange(len(out)))[:, None])
        return np.concatenate(values), np.concatenate(places)

    def logits(self, pooled: np.ndarray, halves: np.ndarray):
        """For rectified halves of texts: logits, and what their gradients need."""
        chunks, source, starts = chunk_max(pooled, halves)
        counts = np.diff(np.append(starts, len(chunks)))
        mean, most = np.add.reduceat(chunks, starts) / counts[:, None], np.maximum.reduceat(chunks, starts)
        return mean @ self.mean_w + most @ self.max_w + self.offset[0], (chunks, source, starts, counts, mean, most)

    def score(self, data: bytes | None) -> float:
        """The probability that a whole text is of quality; an empty one is scored as padding."""
        values, _ = self.pooled(codes(data or b""))
        z, _ = self.logits(np.maximum(values + self.bias, 0).astype(np.float64), np.array([len(values)]))
        return float(1 / (1 + np.exp(-np.clip(z[0], -30, 30))))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> ByteNetwork:
        """Adam on the logistic loss; gradients pass to the places that gave the maxima."""
        rng = np.random.default_rng(seed)
        inputs = [codes(t) for t in texts]
        params = self.params()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for epoch in range(epochs):
            step = STEP * (1 - epoch / epochs) + STEP / 20
            order = rng.permutation(len(inputs))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                grads = self._gradients([inputs[k] for k in pick], labels[pick])
                t += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                self.tables[:, PAD] = 0
        return self

    def _gradients(self, parts: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
        found = [self.pooled(p) for p in parts]
        halves = np.array([len(v) for v, _ in found])
        pooled = np.maximum(np.concatenate([v for v, _ in found]) + self.bias, 0)
        where = np.concatenate([w for _, w in found])
        z, (chunks, source, starts, counts, mean, most) = self.logits(pooled, halves)
        text = np.repeat(np.arange(len(parts)), counts)
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(parts)
        g = err[text, None] * self.mean_w / counts[text, None]
        is_most = chunks == most[text]
        g = g + is_most * err[text, None] * self.max_w / np.maximum(np.add.reduceat(is_most, starts, dtype=np.int64), 1)[text]
        g = np.where(np.take_along_axis(pooled, source, axis=0) > 0, g, 0).astype(np.float32)
        filters = np.broadcast_to(np.arange(FILTERS), g.shape)
        place = where[source, filters]
        live = g != 0
        # All texts of the batch as one, each with padding for the filters that reach beyond its end.
        begins = np.cumsum([0, *(len(p) + HALF + WIDTH for p in parts)])
        x = np.full(begins[-1], PAD, np.int32)
        for p, at in zip(parts, begins, strict=False):
            x[at : at + len(p)] = p
        place = place + begins[text][:, None]
        tables = np.zeros_like(self.tables)
        for k in range(WIDTH):
            np.add.at(tables[k], (x[place[live] + k], filters[live]), g[live])
        return [tables, g.sum(axis=0), err @ mean, err @ most, np.array([err.sum()], np.float32)]


def training_rows(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, sample_bytes: int) -> tuple[list[bytes], np.ndarray]:
    """Whole texts of each label in the order of the MD5 of their ids, none of them held out.

    Of each class the first ``per_class``, and of these as many as come before
    their bytes reach ``sample_bytes``.  Labelled texts that are longer than
    ``sample_bytes`` by themselves are scored, but not learned from, so that what
    comes to the driver is bounded.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")).filter(f"id IS NOT NULL AND y IN (0, 1) AND crc32(cast(id AS string)) % 3 <> {HELD_OUT}")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    key = F.md5(F.col("id").cast("string").cast("binary"))
    # 2 * per_class rows at most.
    sample = known.filter("y = 0").orderBy(key).limit(per_class).union(known.filter("y = 1").orderBy(key).limit(per_class))
    texts = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("data")).filter(F.octet_length("data") <= sample_bytes)
    found = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.max("y").alias("y"), F.max("data").alias("data"))
    before = Window.partitionBy("y").orderBy(key, "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = found.withColumn("before", F.coalesce(F.sum(F.octet_length("data")).over(before), F.lit(0))).filter(F.col("before") < sample_bytes).select("id", "y", "data").collect()
    rows.sort(key=lambda r: zlib.crc32(str(r["id"]).encode()))
    return [bytes(r["data"]) for r in rows], np.array([r["y"] for r in rows], np.float32)


def quality_scores(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """One row per document: ``id, held_out, score, predicted``.

    ``per_class`` and ``sample_bytes`` bound the labelled rows learned from, in
    rows and in bytes of a class; each of them is learned from whole.  Null
    texts are scored as empty ones.  Null ids are not held out; ties and
    repeated rows give a row each, an id with several texts teaches the largest;
    an empty table gives an empty result; other columns are not read.  Without
    labels of both classes every score is the share of label 1 (one half if
    there are none).
    """
    bound_batches(documents.sparkSession)
    id_type = documents.schema[id_col].dataType.simpleString()
    texts, y = training_rows(documents, labels, id_col, text_col, label_col, per_class, sample_bytes)
    constant = None if len(set(y.tolist())) == 2 else (float(y.mean()) if len(y) else 0.5)
    network = ByteNetwork()
    if constant is None:
        network.fit(texts, y)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [network.score(text.as_py()) if constant is None else constant for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["id", "held_out", "score"])

    held_out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == HELD_OUT, F.lit(False))
    rows = dealt(documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("data"))).select("id", held_out.alias("held_out"), "data")
    out = rows.mapInArrow(scored, f"id {id_type}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
