"""Token counts with a whole-token shortcut.

Offline (once, on the driver), every vocabulary string that could be a pre-token
is put through the merges, and those that end as one token are kept and sent to
the workers, some hundred KB: such a pre-token counts one, without merging.  All
other pre-tokens are merged here,
by rank, with a heap over a linked list, so that even a very long one takes
n log n steps.

White space never gets into a token of this vocabulary and neither composes
nor matches across it, so a text is counted word by word: special strings
first, then normalisation, pre-tokens and merges, remembered for short words.
Only words outside printable ASCII are normalised and split by the library, so
that both follow one Unicode version; its encoder and model are never called.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerleaf.llm.common import bound_batches, dealt

#: Tokens above which a document is over the limit.
LIMIT = 2048
PIECE_BYTES = 1 << 20
#: Words up to this length are remembered, up to so many.
REMEMBERED_BYTES, REMEMBERED_WORDS = 64, 300_000

#: Pre-tokens of up to so many letters are merged without a heap.
SHORT = 40
NEVER = 1 << 60

_BLANK = re.compile(rb"[ \t\n\x0b\f\r]")


class WholeTokenCounter:
    """Counts as the library does for a JSON file with NFC, lower case, a split pattern and byte-level BPE with a word end."""

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        library = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.whole = whole if whole is not None else self._proven(model["vocab"])
        self.known, self.counts = _Known(self), _Counts(self)

    def _proven(self, vocabulary: dict[str, int]) -> frozenset[str]:
        """The strings of the vocabulary that, as a pre-token, end as one token."""
        return frozenset(s[: -len(self.end)] for s in vocabulary if s.endswith(self.end) and len(s) > len(self.end) and self._merged(s[: -len(self.end)]) == 1)

    def _merged(self, pre_token: str) -> int:
        """Tokens of one pre-token, a letter a byte, by its merges: lowest rank, then leftmost first."""
        parts: list[str | None] = list(pre_token)
        parts[-1] += self.end
        n, ranks = len(parts), self.ranks
        if n <= SHORT:
            return self._merged_short(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := ranks.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j >= n or parts[j] != b:
                continue
            parts[k], parts[j] = a + b, None
            left -= 1
            after[k] = nxt = after[j]
            if nxt < n:
                before[nxt] = k
                if (r := ranks.get((parts[k], parts[nxt]))) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[nxt]))
            prev = before[k]
            if prev >= 0 and (r := ranks.get((parts[prev], parts[k]))) is not None:
                heapq.heappush(heap, (r, prev, parts[prev], parts[k]))
        return left

    def _merged_short(self, parts: list) -> int:
        """The same for a few letters: the ranks of all neighbours stand in a list."""
        get = self.ranks.get
        ranked = [get(p, NEVER) for p in zip(parts, parts[1:], strict=False)]
        while ranked and (low := min(ranked)) < NEVER:
            k = ranked.index(low)
            parts[k] += parts.pop(k + 1)
            del ranked[k]
            if k < len(ranked):
                ranked[k] = get((parts[k], parts[k + 1]), NEVER)
            if k:
                ranked[k - 1] = get((parts[k - 1], parts[k]), NEVER)
        return len(parts)

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        # In printable ASCII, byte-level letters are the characters themselves.
        if text.isascii() and text.isprintable():
            pre_tokens = self.split.findall(text.lower())
        else:
            pre_tokens = [p for p, _ in self.pre_tokenize(self.normalize(text))]
        counts = self.counts
        return sum([counts[p] for p in pre_tokens])

    def word(self, w: str) -> int:
        """Tokens of a run of non-blanks."""
        return self._plain(w) if self.special is None or "<" not in w else sum(map(self._plain, self.special.split(w))) + len(self.special.findall(w))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null is empty."""
        return self.count_bytes(text.encode()) if text else 0

    def count_bytes(self, data: bytes) -> int:
        """The same of its UTF-8: bytes.split() parts at the six ASCII blanks and no other."""
        total, at = 0, 0
        while at < len(data):
            end = len(data)
            if end - at > PIECE_BYTES:
                cut = _BLANK.search(data, at + PIECE_BYTES)
                end = cut.start() if cut else end
            total += sum(map(self.known.__getitem__, data[at:end].split()))
            at = end + 1
        return total


class _Counts(dict):
    """Tokens by pre-token: one where that is proven, else merged when it is first met."""

    def __init__(self, counter: WholeTokenCounter):
        super().__init__(dict.fromkeys(counter.whole, 1))
        self.counter, self.proven = counter, len(self)

    def __missing__(self, pre_token: str) -> int:
        n = self.counter._merged(pre_token)
        if len(pre_token) <= REMEMBERED_BYTES:
            if len(self) - self.proven >= REMEMBERED_WORDS:
                self.clear()
                self.update(dict.fromkeys(self.counter.whole, 1))
            self[pre_token] = n
        return n


class _Known(dict):
    """Tokens by word, counted when a word is first met; long words are not kept."""

    def __init__(self, counter: WholeTokenCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        n = self.counter.word(word.decode("utf-8", "replace"))
        if len(word) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """The pre-tokens of a vocabulary that are one token each."""
    return WholeTokenCounter(path).whole


_COUNTERS: dict[str, WholeTokenCounter] = {}


def counter(path: str, whole: frozenset[str] | None = None) -> WholeTokenCounter:
    """One counter a process and vocabulary; with ``whole`` nothing is proven again."""
    if path not in _COUNTERS:
        _COUNTERS[path] = WholeTokenCounter(path, whole)
    return _COUNTERS[path]


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: ``id, n_bytes, n_tokens, over_limit``.

    ``vocabulary`` is the file's path, readable on the driver and every executor.  Null counts
    as empty: no bytes, no tokens.  No begin or end tokens are added; special
    strings in a text are one token each, as by the library's default.  Null
    ids, ties and repeated rows give a row each; an empty table an empty
    result; other columns are not read.
    """
    bound_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    whole = df.sparkSession.sparkContext.broadcast(whole_tokens(vocabulary))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary, whole.value)
        for batch in batches:
            n = [own.count_bytes(data.as_py()) for data in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = dealt(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))).select("id", F.octet_length(text).cast("long").alias("n_bytes"), text.cast("binary").alias("data"))
    rows = rows.mapInArrow(counted, f"id {id_type}, n_bytes long, n_tokens long")
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
