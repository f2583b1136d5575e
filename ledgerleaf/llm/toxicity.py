"""Toxicity by compression distance: two zstandard dictionaries, compared window by window.

The ordinary dictionary is trained on windows of ordinary texts, the toxic one
on passages of toxic texts: the runs of bytes that toxic texts share with each
other and ordinary texts hardly have.  Every window of a text is compressed
with the ordinary dictionary alone and with the toxic one beside it.  What the
toxic one saves is the window's distance, in bytes: none on ordinary writing,
the length of the passage on an insult.

Texts in which few passages matter are told by their windows, not by their
sums: the largest distances, their mean, and the shares of windows beyond two
thresholds.  The thresholds are the distances that so many of the ordinary
windows reach, and the weights are those of a logistic regression, both
calibrated on texts that the dictionaries in use were not trained on (two folds
change places), at the shares of the labels in the whole table.

Training is on the driver, on a bounded sample of labelled rows; scoring takes
whole texts, a piece at a time.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.common import bound_batches, dealt

#: Bytes of a window, and of the step to the next.
WINDOW, STEP = 64, 32
#: Bytes of a text that are compressed at a time; a multiple of STEP.
PIECE_BYTES = 1 << 20
#: Bytes of the dictionaries, and the level of compression.
ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 16384, 2048, 3
#: Labelled texts of each class learned from at most, bytes of them together, and bytes of one of them.
PER_CLASS, SAMPLE_BYTES, TEXT_BYTES = 1500, 4 << 20, 256 << 10
#: Bytes of a fragment, and how surely and how many times more often toxic texts must have it.
FRAGMENT, SURE, TIMES = 6, 4.5, 4
#: Shares of ordinary windows beyond the two thresholds, at most.
BEYOND = (0.02, 0.003)
#: Bytes of the runs by which copies are known, how many of their hashes stand for a text, and the share that makes a copy.
RUN, SKETCH, COPY_SHARE = 32, 64, 0.25
#: Largest distances of a text that are kept.
TOP = 8
#: Rows whose crc32(id as text) mod 5 is this are never learned from.
FOLDS, HELD_OUT = 5, 0


def plain(text: str | None) -> bytes:
    """What is compressed of a text (null: empty)."""
    return (text or "").lower().encode()


def _numbers(data: bytes, length: int, factor: int) -> np.ndarray:
    """A number for each run of ``length`` bytes; with a factor of 256 and 8 bytes at most they are exact."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(a) - length + 1), np.uint64)
    for k in range(length if len(out) else 0):
        out = out * np.uint64(factor) + a[k : len(a) - length + 1 + k]
    return out


def without_copies(texts: list[bytes]) -> list[bytes]:
    """The texts of which a quarter of the sketch, at least, was in an earlier one are left out: copies would make their own words telling."""
    seen: set[int] = set()
    out = []
    for t in texts:
        x = _numbers(t, RUN, 1099511628211)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        sketch = np.unique(x ^ (x >> np.uint64(32)))[:SKETCH].tolist() or [hash(t)]
        if sum(h in seen for h in sketch) < COPY_SHARE * len(sketch):
            out.append(t)
        seen.update(sketch)
    return out


def telling_fragments(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """The fragments that toxic texts have significantly (signed root of the log-likelihood ratio) and many times more often."""

    def texts_with(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.unique(_numbers(t, FRAGMENT, 256)) for t in texts]
        return np.unique(np.concatenate(each) if each else np.zeros(0, np.uint64), return_counts=True)

    (fragments, a), (others, counts) = texts_with(toxic), texts_with(ordinary)
    if not len(fragments):
        return fragments
    b = np.zeros(len(fragments))
    if len(others):
        at = np.searchsorted(others, fragments).clip(0, len(others) - 1)
        b = np.where(others[at] == fragments, counts[at], 0)
    n, m = len(toxic), max(1, len(ordinary))
    both = a + b
    part = lambda x, expected: np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(expected, 1e-300)), 0)
    ratio = part(a, both * n / (n + m)) + part(b, both * m / (n + m)) + part(n - a, (n + m - both) * n / (n + m)) + part(m - b, (n + m - both) * m / (n + m))
    return fragments[(np.sqrt(np.maximum(2 * ratio, 0)) >= SURE) & (a / n >= TIMES * (b + 0.5) / m)]


def passages(texts: list[bytes], telling: np.ndarray) -> list[bytes]:
    """The runs of bytes that telling fragments cover, each once, in the order in which they come."""
    found: Counter[bytes] = Counter()
    for t in texts:
        hit = np.flatnonzero(np.isin(_numbers(t, FRAGMENT, 256), telling))
        edge = np.zeros(len(t) + 1, np.int32)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + FRAGMENT, -1)
        ends = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(edge) > 0, [0]]).astype(np.int8)))
        found.update(t[s:e] for s, e in zip(ends[::2], ends[1::2], strict=True))
    return list(found)


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; of samples too few for its trainer, their end as they are."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    known = zstandard.ZstdCompressionDict(dictionary)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)


def _lengths(compressor: zstandard.ZstdCompressor, data: bytes, segments: bytes) -> np.ndarray:
    return np.array([len(x) for x in compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments), threads=1)], np.int64)


class Distances:
    """Window distances under a pair of dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(ordinary + toxic)

    def of(self, data: bytes) -> Iterator[np.ndarray]:
        """The distances of a text's windows, a piece of the text at a time; together the windows cover all of it."""
        if not data:
            yield np.zeros(1, np.int64)
        starts_end = max(len(data) - WINDOW, 0) + STEP
        for at in range(0, min(len(data), starts_end), PIECE_BYTES):
            piece = data[at : at + PIECE_BYTES + WINDOW]
            starts = np.arange(0, min(PIECE_BYTES, starts_end - at, len(piece)), STEP, dtype=np.uint64)
            sizes = np.minimum(WINDOW, len(piece) - starts.astype(np.int64)).astype(np.uint64)
            segments = np.stack([starts, sizes], axis=1).tobytes()
            yield _lengths(self.ordinary, piece, segments) - _lengths(self.toxic, piece, segments)


def thresholds(ordinary_windows: np.ndarray) -> tuple[int, ...]:
    """The least distances that so few of the ordinary windows reach; 1 at least."""
    return tuple(max(1, int(np.quantile(ordinary_windows, 1 - share, method="higher")) + 1) if len(ordinary_windows) else 1 for share in BEYOND)


def features(pieces: Iterator[np.ndarray], beyond: tuple[int, ...]) -> list[float]:
    """The largest distance, means of the largest, the mean, the shares beyond the thresholds, and how many windows there are."""
    top, total, n, over = np.zeros(0, np.int64), 0, 0, [0] * len(beyond)
    for d in pieces:
        top = np.sort(np.concatenate([top, d]))[::-1][:TOP]
        total, n = total + int(d.sum()), n + len(d)
        over = [o + int((d >= b).sum()) for o, b in zip(over, beyond, strict=True)]
    return [float(top[0]), float(top[:3].mean()), float(top.mean()), total / n, total / np.sqrt(n), *(o / n for o in over), float(np.log(n))]


@dataclass
class Model:
    """What scoring needs; plain data, so that it can be sent to the tasks."""

    ordinary: bytes = b""
    toxic: bytes = b""
    beyond: tuple[int, ...] = (1, 1)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    constant: float | None = None

    def score(self, distances: Distances, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        x = np.append((np.array(features(distances.of(plain(text)), self.beyond)) - self.mean) / self.scale, 1.0)
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))


def _dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    windows = [t[k : k + WINDOW] for t in ordinary for k in range(0, max(len(t) - WINDOW, 0) + STEP, STEP) if len(t) - k >= WINDOW // 4]
    found = passages(toxic, telling_fragments(toxic, ordinary))
    random.Random(1).shuffle(found)
    samples = [p for p in found if len(p) > FRAGMENT + 1] + [b" ".join(found[k : k + 8]) for k in range(0, len(found), 8)]
    return trained(windows, ORDINARY_BYTES), trained(samples, TOXIC_BYTES)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights by Newton's method, with a little decay."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.01 * np.eye(len(w)), x.T @ (weight * (p - y)) + 0.01 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[bytes], ordinary: list[bytes], toxic_share: float) -> Model:
    """The model of two classes of texts; ``toxic_share`` is the share of the first one in the whole table."""
    if not toxic or not ordinary:
        return Model(constant=1.0 if toxic else 0.0 if ordinary else 0.5)
    toxic, ordinary = without_copies(toxic), without_copies(ordinary)
    by_fold = []
    for k in (0, 1):
        # A text alone in its class is in both folds: nothing better can be known of it.
        learned = (toxic[k::2] or toxic, ordinary[k::2] or ordinary)
        judged = (toxic[1 - k :: 2] or toxic, ordinary[1 - k :: 2] or ordinary)
        pair = Distances(*_dictionaries(*learned))
        by_fold.append([[list(pair.of(t)) for t in texts] for texts in judged])
    beyond = thresholds(np.concatenate([d for _, texts in by_fold for pieces in texts for d in pieces]))
    rows = [(features(iter(pieces), beyond), y) for fold in by_fold for y, texts in zip((1, 0), fold, strict=True) for pieces in texts]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weight = np.where(y == 1, toxic_share / max(y.mean(), 1e-9), (1 - toxic_share) / max(1 - y.mean(), 1e-9))
    return Model(*_dictionaries(toxic, ordinary), beyond, mean, scale, _logistic((x - mean) / scale, y, weight))


def held_out_rows(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, sample_bytes: int) -> tuple[dict[int, list[bytes]], float]:
    """Whole texts by label, in the order of the MD5 of their ids, none held out; and the share of label 1 among all rows not held out.

    Of each class the first ``per_class``, and of these as many as fit into
    ``sample_bytes``; labelled texts of over TEXT_BYTES are scored, but not
    learned from, so that what comes to the driver is bounded.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out_rows(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    key = F.md5(F.col("id").cast("string").cast("binary"))
    # 2 * per_class rows at most.
    sample = known.filter("y = 0").orderBy(key, "id").limit(per_class).union(known.filter("y = 1").orderBy(key, "id").limit(per_class))
    texts = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter((F.octet_length("text") <= TEXT_BYTES) & F.col("id").isNotNull())
    found = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.max("y").alias("y"), F.max("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy(key, "id").rowsBetween(Window.unboundedPreceding, 0))
    rows = found.withColumn("upto", upto).filter(F.col("upto") <= sample_bytes).select(key.alias("k"), "id", "y", "text").collect()
    rows.sort(key=lambda r: (r["k"], str(r["id"])))
    return {y: [plain(r["text"]) for r in rows if r["y"] == y] for y in (0, 1)}, shares.get(1, 0) / max(1, sum(shares.values()))


def toxicity_scores(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """One row per document: ``id, held_out, score, predicted``.

    ``per_class`` and ``sample_bytes`` bound the labelled rows learned from.
    Null texts are scored as empty ones, texts of any length whole.  Null ids
    are not held out; ties and repeated rows give a row each, an id with several
    labels has the largest and with several texts teaches the largest; an empty
    table gives an empty result; other columns are not read.  Without labels of
    both classes every score is the share of label 1 (one half if there are
    none).
    """
    bound_batches(documents.sparkSession)
    id_type = documents.schema[id_col].dataType.simpleString()
    texts, share = labelled_sample(documents, labels, id_col, text_col, label_col, per_class, sample_bytes)
    model = fit(texts[1], texts[0], share)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model.ordinary, model.toxic)
        for batch in batches:
            s = [model.score(distances, text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["id", "held_out", "score"])

    rows = dealt(documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))).select("id", held_out_rows(F.col("id")).alias("held_out"), "text")
    out = rows.mapInArrow(scored, f"id {id_type}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
