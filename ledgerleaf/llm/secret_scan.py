"""Secret scans: fixed patterns, and a battery of randomness tests for the rest.

Runs of 20 or more characters of the base64, base64url, hex and base32
alphabets, without what the fixed patterns have found in them, are cut at '='
that isn't padding, as in NAME=VALUE.  Each longest run of base64 and of
base64url within a part is a candidate; so is each stretch of words between signs in it that is more
likely random than writing and would be less so if longer (a key after a path).
For each the smallest alphabet that holds it is inferred, and it is tested as a
sequence over that alphabet:

* likelihood as a random string of this length and alphabet against likelihood
  as writing, by shares of pairs of letters, digits and signs and of capitals;
  for writing, a ratio of r or more has a probability of 1/r at most, which is
  taken as the p-value;
* chi-squared uniformity, runs above and below the alphabet's middle, and
  lag-one serial correlation: counters, keyboard rows and repeated patterns
  fail these.

A string must not fail the last three at 0.1 % each, and the p-values of the first
pass Benjamini and Hochberg's step-up over the document's candidates; of finds
that overlap, the one with the least p-value stays.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import bound_batches, dealt

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run is as long as it gets, so only runs of 16 or more need matching.
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[^=]{20,}")
#: Runs of the alphabets that may stand within a part; a part of one alphabet is a run of its own.
RUNS = tuple(re.compile(x) for x in (r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9_-]{20,}"))
#: Words between signs, each with the signs before it.
WORD = re.compile(r"[+/_-]*[A-Za-z0-9]+|[+/_-]+")
#: Expected share of false finds among a document's finds; level of the other tests.
FALSE_SHARE, LEVEL = 0.001, 0.001
#: Candidates longer than this are tested on windows of this length, all of them.
WINDOW = 4096

#: The alphabets, in the order in which they are tried.
ALPHABETS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("BASE36", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: How rare a letter (a to z), digit (0) or sign (-) is at the start and after each of
#: these, in half bits as base-36 digits, counted in the names and comments of Python's library.
CLASSES = "abcdefghijklmnopqrstuvwxyz0-"
PAIRS = (
    "9a8999ab9gda9ab9f9799dbcgf86 "
    "ga88geahaic687iai686bceddhde "
    "6cbd7ffg7ah6ee8bh99c6hgi9f9b "
    "7gce7eg7ai78ef4eh9c69ghieicb "
    "8dd94deg5gh9fe8fia9c9gggdhb6 "
    "9e87bbcgeig9a6ebd577fcc9chd8 "
    "8fdc87dh4ii9ff6fh7aa8ifidiaa "
    "aeee3gb87ii9c8bei87b9fgihfe7 "
    "4gfe4gig7ifcde6giad8bhhieig8 "
    "bb89ab9igig8947aha77hbicibhe "
    "7iaf4gih9iaghh69ig8e5ihifid8 "
    "aedd3dbe7hgagbddgc7dceaiehg5 "
    "7eea4egh5ig7fe6cifa9afhiahh9 "
    "5afd4ghh8igcaf76ifacahhieiga "
    "7g867a6g9iddfc9dhf85bcgifig9 "
    "cb88gcchdic985a9i5998caehhfb "
    "5gdd5ehd9ig7gf79h6b8affiaid9 "
    "egffghigghibhaeeebbg1hgiiic9 "
    "7fbb4ebg7icdab7di988bdfibih9 "
    "ahaf5ee97iccef99fe859gfhbig8 "
    "7fbd5dh86ifcde8ci79abgehagf6 "
    "babd8bciaih786d8i786giihii7e "
    "4gfh2fhg7iggeebgiffghifiiibb "
    "5gdc8eh95ihbd87fi68dggdgihg7 "
    "ab8b8aif9iidcgf8ife6ggheci39 "
    "ecbc9dgeaiiaa8c4hb66febhffe5 "
    "8ige2fic6iidcf9difffgihieeba "
    "abbabbiiiiihhhghiihiiii5ii1a "
    "aa8999bb9gd9aaa9f979ccbgggb5"
).split()
#: Shares of capitals among letters at the start and after a sign, lower-case letter, capital and digit.
CAPITALS = {"^": 0.25, "-": 0.14, "l": 0.016, "U": 0.72, "0": 0.07}
#: Bits for which sign it is.
SIGNS = {"+": 5.0, "/": 2.0, "-": 1.4, "_": 1.4}


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer_encoding(s: str) -> tuple[str, str] | None:
    """The first alphabet that holds all of a string but its padding; None: none does."""
    chars = set(s.rstrip("="))
    for name, alphabet in ALPHABETS:
        if chars <= set(alphabet):
            return name, alphabet
    return None


def _pair_bits() -> dict[str, float]:
    """Bits of writing for a character after another, or at the start."""
    symbols = ALPHABETS[-2][1] + "-_"
    said = {"": "^"} | {c: "U" if c.isupper() else "l" if c.isalpha() else "0" if c.isdigit() else "-" for c in symbols}
    fold = {c: c.lower() if c.isalpha() else said[c] for c in symbols}
    bits = {}
    for a in said:
        row = PAIRS[1 + CLASSES.index(fold[a]) if a else 0]
        for c in symbols:
            capital = CAPITALS[said[a]]
            more = -math.log2(capital if c.isupper() else 1 - capital) if c.isalpha() else math.log2(10) if c.isdigit() else SIGNS[c]
            bits[a + c] = int(row[CLASSES.index(fold[c])], 36) / 2 + more
    return bits


PAIR_BITS = _pair_bits()


def writing_bits(s: str, before: str = "") -> float:
    """Bits of a string as writing, after a character."""
    return sum(PAIR_BITS[a + c] for a, c in zip((before, *s), s, strict=False))


def unlike_writing(s: str, alphabet: str) -> float:
    """A bound on the probability that writing fits a random string over the alphabet this much better."""
    return 2.0 ** -min(max(writing_bits(s) - len(s) * math.log2(len(alphabet)), 0.0), 1000.0)


def even_test(s: str, alphabet: str) -> float:
    """The probability that a random string is as uneven over the alphabet, or more so."""
    n, k = len(s), len(alphabet)
    stat = sum(c * c for c in Counter(s).values()) * k / n - n
    df = k - 1
    # Wilson and Hilferty's cube root.
    return _normal_tail(((stat / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df))) if stat > 0 else 1.0


def runs_test(s: str, alphabet: str) -> float:
    """Two-sided p-value of the number of runs above and below the alphabet's middle."""
    place = {c: k for k, c in enumerate(alphabet)}
    up = [2 * place[c] >= len(alphabet) for c in s]
    n1 = sum(up)
    n2 = len(up) - n1
    if not n1 or not n2:
        return 0.0
    runs = 1 + sum(a != b for a, b in zip(up, up[1:], strict=False))
    n = n1 + n2
    mean = 2 * n1 * n2 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    return 2 * _normal_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 0.0


def serial_test(s: str, alphabet: str) -> float:
    """Two-sided p-value of the lag-one correlation of the characters' places."""
    place = {c: k for k, c in enumerate(alphabet)}
    x = [place[c] for c in s]
    n = len(x)
    mean = sum(x) / n
    ss = sum((v - mean) ** 2 for v in x)
    if ss == 0:
        return 0.0
    r = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False)) / ss
    return 2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n))


def looks_random(s: str) -> float | None:
    """The p-value against writing of a string that the other tests let through; None: it fails them."""
    found = infer_encoding(s)
    body = s.rstrip("=")
    # Digits alone are numbers, and letters of one case alone are words in some language.
    if found is None or len(body) < 20 or body.isdigit() or body.isalpha() and (body.islower() or body.isupper()):
        return None
    windows = range(0, len(body), WINDOW)
    for at in windows:
        part = body[at : at + WINDOW] if len(body) - at >= 20 else body[-20:]
        # The level is for the string, however many windows it has.
        if min(runs_test(part, found[1]), serial_test(part, found[1]), even_test(part, found[1])) < LEVEL / len(windows):
            return None
    return unlike_writing(body, found[1])


def stretches(s: str) -> Iterator[tuple[int, int, int]]:
    """Start and end of a run and of its stretches of words unlike writing; in how many ways it could be chosen."""
    yield 0, len(s), 1
    words = [m.span() for m in WORD.finditer(s)]
    if len(words) < 2:
        return
    # Ruzzo and Tompa: all maximal scoring stretches, in linear time. [first, after last, sum before, sum with, the one before with a lower sum].
    stack: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for k, (a, b) in enumerate(words):
        word = s[a:b]
        score = writing_bits(word, s[a - 1 : a]) - sum(6.0 if c in SIGNS else 0.0 for c in word) - sum(c.isalnum() for c in word) * _word_bits(word)
        before, total = total, total + score
        if score <= 0:
            continue
        one = (k, k + 1, before, total)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= one[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= one[3]:
                stack.append((*one, j))
                break
            one = (stack[j][0], one[1], stack[j][2], one[3])
            del stack[j:]
    ways = len(words) * (len(words) + 1) // 2
    for first, after, *_ in stack:
        a, b = words[first][0], words[after - 1][1]
        while s[a] in SIGNS and a < b - 1:
            a += 1
        if b - a >= 20 and (a, b) != (0, len(s)):
            yield a, b, ways


def _word_bits(word: str) -> float:
    """Bits of each letter or digit of a random word with the cases of this one."""
    if word.lower() == word or word.upper() == word:
        return math.log2(36)
    return math.log2(62)


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """Start and end, with padding, of all that is tested, by part of the text, and in how many ways it could be chosen."""
    for m in CANDIDATE.finditer(text):
        body = m.start() + len(m.group().rstrip("="))
        for part in PART.finditer(text, m.start(), body):
            found: dict[tuple[int, int], int] = {}
            for at, end in {r.span() for run in RUNS for r in run.finditer(text, *part.span())}:
                for a, b, ways in stretches(text[at:end]):
                    found[at + a, at + b] = min(ways, found.get((at + a, at + b), ways))
            yield from ((a, m.end() if b == body else b, ways) for (a, b), ways in sorted(found.items()))


def scan(text: str) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, place of the kind, end), sorted."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    # What fixed patterns have found is blanked out, and the rest of its run tested by itself.
    rest, at = [], 0
    for a, b in _joined((a, b) for a, _, b in spans):
        rest += [text[at:a], " " * (b - a)]
        at = b
    rest = "".join([*rest, text[at:]]) if at else text
    tested = []
    for a, b, ways in candidates(rest):
        if (p := looks_random(rest[a:b])) is not None:
            tested.append((min(p * ways, 1.0), a, b))
    tested.sort()
    last = max((k for k, (p, _, _) in enumerate(tested, 1) if p <= FALSE_SHARE * k / len(tested)), default=0)
    taken: list[tuple[int, int]] = []
    for _, a, b in tested[:last]:
        k = bisect_left(taken, (b,))
        if not k or taken[k - 1][1] <= a:
            insort(taken, (a, b))
    return sorted([*spans, *((a, 3, b) for a, b in taken)])


def _joined(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, n_assign, n_access, n_hex, n_random, base_sha256, spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and
    then kind, comma-joined.  Null counts as empty: no spans, and the digest of
    the empty string.  Null ids, ties and repeated rows give a row each; an
    empty table an empty result; other columns are not read.
    """
    bound_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for text in batch.column(1):
                found = scan(text.as_py() or "")
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in found))
                digests.append(hashlib.sha256(_said([x for x in found if x[1] < 3]).encode()).hexdigest())
                spans.append(_said(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    rows = dealt(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")))
    return rows.mapInArrow(scanned, f"id {id_type}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string").withColumnRenamed("id", id_col)
