"""Best-fit packing into sequences of several permitted lengths.

A document longer than the longest sequence is cut into whole sequences of
that length, which need no packing; its rest, and every shorter document, is an
item.  Items are dealt by a hash over shards of a bounded number of rows, and
each shard is packed by itself: items in falling order, each into the open bin
with the least room that fits; where none fits, the permitted length is opened
that costs least for what can still come into it.  The cost of a length is
linear plus quadratic (attention), and what can come is known, as all items
left are smaller.  In the end each bin shrinks to the least permitted length
that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerleaf.llm.common import n_words, staged

#: Permitted lengths in words.
LENGTHS = (256, 512, 1024, 2048, 4096)
#: The cost of a length n is n * (1 + n / ATTENTION).
ATTENTION = 16384
#: Items of a shard, in the mean.
SHARD_ROWS = 20_000
#: Repeated rows that one task numbers.
COPIES_TOGETHER = 1 << 20


def cost(n: int) -> float:
    """What a sequence of length n costs to train on."""
    return n * (1 + n / ATTENTION)


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int], list[int]]:
    """For each item (1 to the longest length) its bin and place within; and by bin its length and contents.

    Ties go to the earlier item and the bin opened first.
    """
    lengths = tuple(sorted(lengths))
    longest = lengths[-1]
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    # smaller[g]: words of all items left that are at most g.
    left = [0] * (longest + 1)
    for s in sizes:
        left[s] += s
    # A Fenwick tree over the sizes sums them.
    tree = [0] * (longest + 1)

    def add(k: int, v: int) -> None:
        while k <= longest:
            tree[k] += v
            k += k & -k

    def upto(k: int) -> int:
        total = 0
        while k > 0:
            total += tree[k]
            k -= k & -k
        return total

    for s, v in enumerate(left):
        if v:
            add(s, v)
    bins_of = [0] * len(sizes)
    place = [0] * len(sizes)
    opened: list[int] = []
    filled: list[int] = []
    room: dict[int, list[int]] = {}  # bins by room left, and the rooms in order
    rooms: list[int] = []
    for k in order:
        s = sizes[k]
        add(s, -s)
        at = bisect_right(rooms, s - 1)
        if at < len(rooms):
            r = rooms[at]
            b = room[r].pop(0)
            if not room[r]:
                del room[r]
                rooms.pop(at)
        else:
            b = len(opened)
            # The least cost for a word of what is here and can come.
            n = min((n for n in lengths if n >= s), key=lambda n: cost(n) / (s + min(n - s, upto(min(n - s, s)))))
            opened.append(n)
            filled.append(0)
            r = n
        bins_of[k], place[k] = b, filled[b]
        filled[b] += s
        if r > s:
            if r - s not in room:
                room[r - s] = []
                rooms.insert(bisect_right(rooms, r - s), r - s)
            room[r - s].append(b)
    final = [next(n for n in lengths if n >= f) for f in filled]
    return bins_of, place, final, filled


def _pack_shard(lengths: tuple[int, ...], id_type: pa.DataType):
    out = pa.schema([("id", id_type), ("piece", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("seq", pa.string()), ("seq_length", pa.int64()), ("seq_words", pa.int64()), ("place", pa.int64())])

    def packed(shard: pa.Table) -> pa.Table:
        shard = shard.take(pc.sort_indices(shard, sort_keys=[("n_words", "descending"), ("id", "ascending"), ("piece", "ascending"), ("copy", "ascending")], null_placement="at_start"))
        bins_of, place, final, filled = pack(shard["n_words"].to_pylist(), lengths)
        names = [f"{s}-{b}" for s, b in zip(shard["shard"].to_pylist(), bins_of, strict=True)]
        return pa.table([shard["id"], shard["piece"], shard["first_word"], shard["n_words"], names, [final[b] for b in bins_of], [filled[b] for b in bins_of], place], schema=out)

    return packed


def pack_documents(df: DataFrame, id_col: str = "doc_id", size: Column | None = None, text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece of a document: ``id, piece, first_word, n_words, seq_id, seq_length, seq_words, place``.

    ``size`` is an integer column of items' lengths, the number of words by
    default.  A piece has ``n_words`` words from ``first_word`` on (from 0) and
    lies at ``place`` in its sequence.  Null and empty texts, and null or
    negative sizes, have no piece.  Null ids, ties and repeated rows are packed
    as rows of their own.  An empty table gives an empty result; other columns
    are not read.

    Ids may be of any type that sorts.  Rows of one id and length are alike here
    and only numbered, so the result is the same however the input is split.
    """
    if not lengths or min(lengths) < 1:
        raise ValueError("lengths must be positive")
    longest = max(lengths)
    n = F.coalesce(size, F.lit(0)).cast("long") if size is not None else n_words(F.col(f"`{text_col}`"))
    counted = staged(df.select(F.col(f"`{id_col}`").alias("id"), n.alias("n")).filter("n > 0").groupBy("id", "n").agg(F.count("*").alias("rows")), "pack-docs")
    # Rows that are repeated very often are numbered by more than one task.
    many = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / COPIES_TOGETHER))).alias("lot")
    few, lots = counted.filter(F.col("rows") <= COPIES_TOGETHER).withColumn("lot", F.lit(0).cast("long")), counted.filter(F.col("rows") > COPIES_TOGETHER).select("id", "n", "rows", many).repartition("id", "n", "lot")
    first = F.col("lot") * COPIES_TOGETHER
    copies = F.explode(F.sequence(first, F.least(first + COPIES_TOGETHER, F.col("rows")) - 1)).alias("copy")
    docs = few.unionByName(lots).select("id", "n", copies)

    named = F.concat_ws("-", F.lit("w"), F.coalesce(F.col("id").cast("string"), F.lit("")), "n", "copy", "piece")
    whole = docs.filter(F.col("n") >= longest).select("id", "n", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / longest) - 1)).alias("piece"))
    whole = whole.select("id", "piece", (F.col("piece") * longest).alias("first_word"), F.lit(longest).cast("long").alias("n_words"), named.alias("seq"), F.lit(longest).cast("long").alias("seq_length"), F.lit(longest).cast("long").alias("seq_words"), F.lit(0).cast("long").alias("place"))

    rest = docs.withColumn("piece", F.floor(F.col("n") / longest)).withColumn("n_words", F.col("n") % longest).filter("n_words > 0")
    shards = max(1, -(-(counted.agg(F.sum("rows")).first()[0] or 0) // shard_rows))
    items = rest.select("id", "copy", "piece", (F.col("piece") * longest).alias("first_word"), "n_words", F.pmod(F.xxhash64("id", "n", "copy"), F.lit(shards)).alias("shard"))
    id_type = df.schema[id_col].dataType
    schema = f"id {id_type.simpleString()}, piece long, first_word long, n_words long, seq string, seq_length long, seq_words long, place long"
    packed = items.groupBy("shard").applyInArrow(_pack_shard(tuple(lengths), to_arrow_type(id_type)), schema)
    return packed.unionByName(whole).select(F.col("id").alias(id_col), "piece", "first_word", "n_words", F.col("seq").alias("seq_id"), "seq_length", "seq_words", "place")
