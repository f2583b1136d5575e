"""Near-duplicate detection by b-bit MinHash.

Texts with the same shingle set are first folded into one representative.  Of
each representative 128 minima are taken; their low two bits are packed into
four 64-bit words (the signature) and bands of four whole minima name the
buckets in which candidates meet.  Bucket rows are range-partitioned on
(bucket, id) and sorted, and one streaming pass compares each row with the
first of its bucket: the similarity that bit counts of the signatures
estimate, corrected for chance collisions, must be near the threshold.  Those
pairs are confirmed on the full sets and joined into components.

Pairs within a bucket are not written out.  Each row is first tested with the
nearest of the firsts it meets.  What that leaves apart is looked for in the
buckets themselves: rows whose component differs from that of their bucket's
first ("seekers") are compared by signature with the bucket's rows of other
components, in blocks of bounded size.  Rows that have such a partner get
their full sets, and every pair of partners is confirmed where it meets first,
unless links found before it have joined their components; of the links between
two components one is kept.  So all candidate pairs that could join two
components are tested on full sets, but only links are written, and near copies
in thousands stay a matter of blocks.

A pair at exactly the threshold shares no bucket with probability
(1 - 0.75**4)**32, about 5e-6, and fails the estimate (4.3 standard deviations
below) with about 7e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import bound_batches, dealt, small_or_not, staged
from ledgerleaf.llm.shingles import mixed, shingle_set

BANDS, BAND_ROWS, BITS = 32, 4, 2
MINIMA = BANDS * BAND_ROWS
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Candidates need this estimate at least; its standard deviation at 0.75 is 0.046.
LEAST_ESTIMATE = 0.55
#: Equal slots of a signature that give that estimate.
LEAST_EQUAL = int(np.ceil(MINIMA * (LEAST_ESTIMATE * (1 - 2.0**-BITS) + 2.0**-BITS)))

#: Rows of a bucket that are compared with as many at a time, and shingles in them, in the mean.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
#: Pairs with one row that are confirmed together.
PAIRS_TOGETHER = 64

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = (_rng.integers(0, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)[:, None]
_LOW = np.uint64(0x5555555555555555)
SIG = ["s0", "s1", "s2", "s3"]


def minima(hashes: np.ndarray) -> np.ndarray:
    """The MINIMA smallest values of a set, one for each hash function, as uint32."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = (x[:1024] * _A + _B).min(axis=1)
    for at in range(1024, len(x), 1024):
        np.minimum(least, (x[at : at + 1024] * _A + _B).min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima (after folding their halves) in four 64-bit words."""
    low = ((least ^ (least >> np.uint32(16))) & np.uint32(3)).astype(np.uint64).reshape(4, 32)
    return (low << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64)


def bands(least: np.ndarray) -> np.ndarray:
    """A bucket for each band of whole minima."""
    m = least.astype(np.uint64).reshape(BANDS, BAND_ROWS)
    h = mixed((m[:, 0] << np.uint64(32)) | m[:, 1]) + np.arange(1, BANDS + 1, dtype=np.uint64)
    return mixed(mixed(h) ^ ((m[:, 2] << np.uint64(32)) | m[:, 3]))


def equal_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal two-bit slots of signatures, row by row."""
    x = a ^ b
    return MINIMA - np.bitwise_count((x | (x >> np.uint64(1))) & _LOW).sum(axis=-1, dtype=np.int64)


def estimate(equal: np.ndarray) -> np.ndarray:
    """The similarity that a number of equal slots stands for, without chance collisions."""
    return (equal / MINIMA - 2.0**-BITS) / (1 - 2.0**-BITS)


def _key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, buckets, sigs = [], [], [], []
        for text in batch.column(1):
            found = shingle_set(text.as_py())
            sizes.append(len(found))
            if len(found):
                least = minima(found)
                keys.append(_key(found))
                buckets.append(bands(least))
                sigs.append(packed(least))
            else:
                keys.append(None)
                buckets.append(np.zeros(0, np.uint64))
                sigs.append(np.zeros(4, np.uint64))
        if sizes:
            s = np.array(sigs, np.uint64).view(np.int64).reshape(-1, 4)
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in buckets])]).astype(np.int32)
            values = np.concatenate(buckets).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), *(pa.array(s[:, k]) for k in range(4))], names=["id", "at", "n_shingles", "set_key", "bands", *SIG])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_set(text.as_py()) for text in batch.column(0)]
        if found:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            members = np.concatenate([np.sort(x.view(np.int64)) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(map(_key, found), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(members))], names=["set_key", "members"])


def _with_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows sorted by bucket and id: each row with its bucket's first, if the bucket has two rows here.

    The first and last bucket of a partition may go on in the next one: their
    firsts are given in any case, as edges.
    """
    names = ["bucket", "first", "id", "equal", "edge", *SIG, "n"]

    def out(bucket, first, ids, equal, edge, sig, sizes):
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(first), pa.array(ids), pa.array(equal.astype(np.int32)), pa.array(edge), *(pa.array(sig[:, k].view(np.int64)) for k in range(4)), pa.array(sizes)], names=names)

    carried, told, opening = None, False, True
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, ids = (batch.column(k).to_numpy() for k in (0, 1))
        sig, sizes = np.stack([batch.column(k).to_numpy() for k in range(2, 6)], axis=1).view(np.uint64), batch.column(6).to_numpy()
        if carried is not None:
            bucket, ids, sig, sizes = np.append(carried[0], bucket), np.append(carried[1], ids), np.vstack([carried[2], sig]), np.append(carried[3], sizes)
        n = len(bucket)
        starts = np.append(True, bucket[1:] != bucket[:-1])
        first = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        member = first != np.arange(n)
        has = np.zeros(n, bool)
        has[first[member]] = True
        if opening:
            has[0], opening = True, False
            edge_first = True
        else:
            edge_first = False
        emit_first = has & starts
        if told:
            emit_first[0] = False
        pick = np.flatnonzero(member | emit_first)
        edge = np.zeros(n, bool)
        edge[0] = edge_first
        if len(pick):
            yield out(bucket[pick], ids[first[pick]], ids[pick], equal_slots(sig[first[pick]], sig[pick]), edge[pick], sig[pick], sizes[pick])
        last = first[-1]
        told = bool(has[last]) or (told and last == 0)
        carried = (bucket[last : last + 1], ids[last : last + 1], sig[last : last + 1], sizes[last : last + 1])
    if carried is not None:
        yield out(carried[0], carried[1], carried[1], np.array([MINIMA]), np.array([True]), carried[2], carried[3])


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each group of a stream that is sorted by its first columns, as slices of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in range(keys)]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield held


def _column(group: list[pa.RecordBatch], k: int) -> np.ndarray:
    return np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in group])


def _sig(group: list[pa.RecordBatch], at: int) -> np.ndarray:
    return np.stack([_column(group, at + k) for k in range(4)], axis=1).view(np.uint64)


def _partners(labels: np.ndarray, seeks: np.ndarray, sig: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each seeker of a group: the rows of other components that its signature is near to."""
    y = np.flatnonzero(~seeks)
    x = np.flatnonzero(seeks)
    for at in range(0, len(x), 256):
        rows = x[at : at + 256]
        near = (equal_slots(sig[rows][:, None], sig[y][None]) >= LEAST_EQUAL) & (labels[rows][:, None] != labels[y][None])
        for k in np.flatnonzero(near.any(axis=1)):
            yield rows[k], y[near[k]]


def _with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of groups (bucket, xb, yb, id, label, seeks, signature) that have a partner."""
    names = ["bucket", "xb", "yb", "id", "label", "seeks", *SIG]
    out: list[pa.RecordBatch] = []
    size = 0
    for group in _grouped(batches, 3):
        if sum(b.num_rows for b in group) < 2:
            continue
        seeks = _column(group, 5)
        has = np.zeros(len(seeks), bool)
        for x, y in _partners(_column(group, 4), seeks, _sig(group, 6)):
            has[x] = has[y] = True
        if has.any():
            out += pa.Table.from_batches(group).filter(pa.array(has)).to_batches()
            size += int(has.sum())
        if size > 5000:
            yield from (pa.RecordBatch.from_arrays(b.columns, names=names) for b in out)
            out, size = [], 0
    yield from (pa.RecordBatch.from_arrays(b.columns, names=names) for b in out)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between rows of groups (bucket, xb, yb, id, label, seeks, signature, bands, members).

    A pair is looked at in the first band in which its rows meet.  Once a link
    joins two components, further pairs between these are not looked at in this
    group: its links are a forest over the components in it, however many rows
    they have.
    """
    for group in _grouped(batches, 3):
        ids, labels, seeks, sig = _column(group, 3), _column(group, 4), _column(group, 5), _sig(group, 6)
        bucket = group[0].column(0)[0].as_py()
        table = pa.Table.from_batches(group)
        all_bands = table.column(10).combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS)
        band = int(np.flatnonzero(all_bands[0] == bucket)[0])
        lists = table.column(11).combine_chunks()
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        sizes = np.diff(ends)
        joined = labels.copy()
        a, b, of_a, of_b = [], [], [], []
        for x, y in _partners(labels, seeks, sig):
            y = y[joined[y] != joined[x]]
            y = y[~(all_bands[y, :band] == all_bands[x, :band]).any(axis=1)]
            y = y[100 * np.minimum(sizes[y], sizes[x]) >= PERCENT * np.maximum(sizes[y], sizes[x])]
            if not len(y):
                continue
            own = values[ends[x] : ends[x + 1]]
            theirs = np.concatenate([values[ends[k] : ends[k + 1]] for k in y])
            at = np.searchsorted(own, theirs)
            at[at == len(own)] = 0
            common = np.add.reduceat(own[at] == theirs, np.concatenate([[0], np.cumsum(sizes[y])[:-1]]), dtype=np.int64)
            union = sizes[x] + sizes[y] - common
            linked = np.flatnonzero(100 * common >= PERCENT * union)
            if len(linked):
                y, near = y[linked], common[linked] / union[linked]
                order = np.lexsort((ids[y], -near, joined[y]))
                y = y[order]
                y = y[np.append(True, joined[y][1:] != joined[y][:-1])]
                low = labels[x] < labels[y]
                a.append(np.where(low, ids[x], ids[y]))
                b.append(np.where(low, ids[y], ids[x]))
                of_a.append(np.minimum(labels[x], labels[y]))
                of_b.append(np.maximum(labels[x], labels[y]))
                joined[np.isin(joined, joined[y])] = joined[x]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b, of_a, of_b)], names=["a", "b", "of_a", "of_b"])


def full_sets(texts: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, members`` of staged ``nodes`` (id): the sets, made again from the texts that had them.

    Texts are picked by their ids; what shares an id with another text is told
    apart by the key of its set.
    """
    wanted = staged(groups.select(F.col("node").alias("id"), "set_key", F.col("least.id").alias("doc")).join(small_or_not(nodes), "id", "left_semi"), "near-wanted")
    docs = wanted.select("doc").distinct()
    made = texts.join(small_or_not(docs), F.col("id").eqNullSafe(F.col("doc")), "left_semi").select("data").mapInArrow(_sets, "set_key binary, members array<long>")
    return staged(made.join(small_or_not(wanted.select("set_key", "id")), "set_key").dropDuplicates(["set_key"]).select("id", "members"), "near-sets")


def confirmed(texts: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; ``pairs`` is staged and distinct.

    The first row of a bucket may be in very many pairs: those of such an ``a``
    are dealt over salts by ``b``, and its set goes to each of them.
    """
    sets = full_sets(texts, groups, staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids"))
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_TOGETHER).alias("salts")).filter("salts > 1").withColumnRenamed("a", "hot")
    many = small_or_not(staged(many, "near-hot"))
    salted = pairs.join(many, F.col("a") == F.col("hot"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).alias("salt"))
    centre = sets.join(many, F.col("id") == F.col("hot"), "left").select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), F.col("members").alias("ma"))
    left = salted.join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
    both = left.join(centre, ["a", "salt"])
    common = F.size(F.array_intersect("ma", "mb"))
    return both.filter(100 * common >= PERCENT * (F.size("ma") + F.size("mb") - common)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``id, label`` of all ids that occur in staged ``links`` (a, b): the smallest id reachable.

    Each round takes the least label of the neighbours and then of the label
    itself (pointer jumping), until none changes.
    """
    edges = staged(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a")), "near-edges")
    labels = edges.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("id"), F.least("src", "m").alias("label"))
    labels = staged(labels, "near-labels")
    while True:
        near = edges.join(labels, edges.dst == labels.id).groupBy("src").agg(F.min("label").alias("m"))
        least = F.least("label", "m")
        once = staged(labels.join(near, labels.id == near.src).select("id", least.alias("label"), (least < F.col("label")).alias("changed")), "near-labels")
        if once.filter("changed").isEmpty():
            return once.select("id", "label")
        of = once.select(F.col("id").alias("l"), F.col("label").alias("further"))
        labels = staged(once.join(of, F.col("label") == F.col("l")).select("id", F.least("label", "further").alias("label")), "near-labels")


def still_apart(texts: DataFrame, groups: DataFrame, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) between components that ``labels`` still tells apart; ``rows`` has bucket, first, id, n, signature.

    Seekers and rows are dealt into blocks, so that a group is bounded, in rows
    and in shingles, however large its bucket is.  Of two rows of one bucket and
    different components at least one is a seeker.
    """
    named = rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    of_first = labels.select(F.col("id").alias("first"), F.col("label").alias("first_label"))
    named = staged(named.join(of_first, "first", "left").select("bucket", "id", "label", "n", (F.col("label") != F.coalesce("first_label", "first")).alias("seeks"), *SIG), "near-named")
    open_ = named.groupBy("bucket").agg(F.count("*").alias("m"), F.count_if("seeks").alias("k"), F.sum("n").alias("mn"), F.sum(F.when(F.col("seeks"), F.col("n")).otherwise(0)).alias("kn")).filter("k > 0")
    blocks = lambda rows, n: F.ceil(F.greatest(F.col(rows) / BLOCK_ROWS, F.col(n) / BLOCK_SHINGLES))
    # Staged, so that the join is broadcast or, between two plain shuffles, dealt anew where a bucket is very large.
    open_ = staged(open_.select("bucket", blocks("m", "mn").alias("ny"), blocks("k", "kn").alias("nx")), "near-open")
    met = named.join(small_or_not(open_), "bucket")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    # Each row stands in the blocks of its own number and all numbers of the other side; a seeker on both sides.
    sides = F.filter(F.array(F.struct(F.lit(False).alias("s")), F.struct(F.col("seeks").alias("s"))), lambda v, i: (i == 0) | v["s"])
    met = met.select("bucket", "id", "label", "nx", "ny", *SIG, F.explode(sides).alias("side"))
    other = F.explode(F.when(F.col("side.s"), numbers("ny")).otherwise(numbers("nx"))).alias("other")
    met = met.select("bucket", "id", "label", "nx", "ny", *SIG, F.col("side.s").alias("seeks"), other)
    met = met.select("bucket", F.when(F.col("seeks"), block("nx")).otherwise(F.col("other")).alias("xb"), F.when(F.col("seeks"), F.col("other")).otherwise(block("ny")).alias("yb"), "id", "label", "seeks", *SIG)
    key = ["bucket", "xb", "yb"]
    kind = "bucket long, xb long, yb long, id long, label long, seeks boolean, s0 long, s1 long, s2 long, s3 long"
    found = staged(met.repartition(*key).sortWithinPartitions(*key).mapInArrow(_with_partner, kind), "near-partners")
    sets = full_sets(texts, groups, staged(found.select("id").distinct(), "near-ids"))
    full = sets.join(groups.select(F.col("node").alias("id"), "bands"), "id")
    dealt = found.join(full, "id").select(*key, "id", "label", "seeks", *SIG, "bands", "members").repartition(*key).sortWithinPartitions(*key)
    # Of the links that groups give between the same two components, one is enough.
    links = dealt.mapInArrow(_links, "a long, b long, of_a long, of_b long")
    return links.groupBy("of_a", "of_b").agg(F.min(F.struct("a", "b")).alias("link")).select("link.a", "link.b")


def linked_rows(texts: DataFrame) -> DataFrame:
    """``at, id, n_shingles, first`` of rows (at, id, data): of each row's component the row with the smallest id.

    ``first`` is a struct (none, id, at): rows without an id come last, ties go
    by ``at``.  A row without shingles is its own.  Equal sets are one node of
    the graph, whatever their rows' ids.
    """
    features = staged(texts.select("id", "data", "at").mapInArrow(_features, "id long, at long, n_shingles long, set_key binary, bands array<long>, s0 long, s1 long, s2 long, s3 long"), "near-features")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "at")
    groups = features.filter("n_shingles > 0").groupBy("set_key").agg(F.min(own).alias("least"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), *[F.any_value(c).alias(c) for c in SIG])
    groups = staged(groups.withColumn("node", F.monotonically_increasing_id()), "near-groups")

    rows = groups.select(F.explode("bands").alias("bucket"), F.col("node").alias("id"), *SIG, "n")
    ordered = rows.repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id")
    met = staged(ordered.mapInArrow(_with_first, "bucket long, first long, id long, equal int, edge boolean, s0 long, s1 long, s2 long, s3 long, n long"), "near-met")

    # A bucket that was dealt over partitions has a first in each: at most two rows a partition.
    edge = met.filter("edge").select("bucket", "id").distinct()
    tops = edge.groupBy("bucket").agg(F.min("id").alias("top"), F.count("*").alias("parts")).filter("parts > 1").select("bucket", "top")
    across = edge.join(tops, "bucket").filter("id <> top").select(F.col("top").alias("a"), F.col("id").alias("b"))
    # Of the firsts that a row meets, the nearest.
    best = met.filter((F.col("first") != F.col("id")) & (F.col("equal") >= LEAST_EQUAL)).groupBy("id").agg(F.max(F.struct("equal", (-F.col("first")).alias("f"))).alias("m"))
    pairs = staged(best.select((-F.col("m.f")).alias("a"), F.col("id").alias("b")).union(across).distinct(), "near-pairs")
    links = staged(confirmed(texts, groups, pairs), "near-links")
    labels = components(links)

    whole = met.join(F.broadcast(tops), "bucket", "left").select("bucket", F.coalesce("top", "first").alias("first"), "id", "n", *SIG)
    more = staged(still_apart(texts, groups, whole, labels), "near-links")
    if not more.isEmpty():
        labels = components(staged(links.union(more), "near-links"))

    # Only sets with a link need the smallest row of their component; the others have it already.
    linked = staged(labels.join(groups.select(F.col("node").alias("id"), "set_key", "least"), "id"), "near-linked")
    # Staged: a component with very many sets is joined between plain shuffles, which can be dealt anew, or broadcast.
    firsts = staged(linked.groupBy("label").agg(F.min("least").alias("first")), "near-firsts")
    linked = linked.select("set_key", "label").join(small_or_not(firsts), "label").select("set_key", "first")
    found = staged(groups.join(linked, "set_key", "left").select("set_key", F.coalesce("first", "least").alias("first")), "near-found")
    slim = features.select("at", "id", "n_shingles", "set_key")
    some = slim.filter("n_shingles > 0").join(found, "set_key").select("at", "id", "n_shingles", "first")
    return some.unionByName(slim.filter("n_shingles = 0").select("at", "id", "n_shingles", own.alias("first")))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, kept``.

    Ids are integers.  A text without words (or null) has an empty set and is
    linked with nothing; a text of fewer than five words is one shingle.  Rows
    are linked by their texts alone: rows with one id and unlike texts are
    apart, repeated rows together.  A component's id is the smallest in it, null
    if it has none, and the rows with that id (or all without one) are kept.
    An empty table gives an empty result; other columns are not read.
    """
    bound_batches(df.sparkSession)
    texts = dealt(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("data"))).withColumn("at", F.monotonically_increasing_id())
    component = F.col("first.id")
    return linked_rows(texts).select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with exactly one row left of each group of near duplicates; all columns stay, whatever their names.

    The row with the smallest id stays, one without an id only if no other in
    its group has one; of rows that repeat that id, one.  Texts without words
    are in no group and all stay.  Rows are dropped by a number of their own, so
    clashing ids lose nothing.  An empty table stays empty.
    """
    bound_batches(df.sparkSession)
    names = df.columns
    rows = staged(df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]).alias("row"), F.monotonically_increasing_id().alias("at")), "near-rows")
    texts = rows.select(F.col(f"row.c{names.index(id_col)}").cast("long").alias("id"), F.col(f"row.c{names.index(text_col)}").cast("binary").alias("data"), "at")
    gone = staged(linked_rows(texts).filter("first.at <> at").select("at"), "near-gone")
    return rows.join(small_or_not(gone), "at", "left_anti").select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)])
