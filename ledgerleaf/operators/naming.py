"""File names from fields, and a collision-free rename plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import text as T
from ledgerleaf.functions.staging import staged
from ledgerleaf.plans import rules as R


def keyword(description: Column) -> Column:
    """Up to three content words of a description, joined by dashes; empty if there are none."""
    c = F.regexp_replace(F.lower(F.coalesce(description, F.lit(""))), "[0-9]+(?:[.,][0-9]+)?", " ")
    words = F.split(F.regexp_replace(c, rf"[^a-zñáéíóú{T.BLANK}-]", " "), rf"[{T.BLANK}-]+")
    stop = F.array(*map(F.lit, R.STOP_WORDS))
    return F.array_join(F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))), 1, 3), "-")


def new_name(vendor: Column, number: Column, date: Column, summary: Column, description: Column, pattern: Column | str = R.NAME_PATTERNS[0], error: Column | None = None) -> Column:
    """The name that a pattern gives; null for error rows and for an empty pattern.

    Tokens are replaced literally, one kind after the other.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    vendor = F.coalesce(T.null_if_empty(vendor), F.lit("desconocido"))
    word = F.coalesce(T.null_if_empty(summary), T.null_if_empty(keyword(description)), vendor)
    name = pattern
    for token, value in (
        ("{fecha}", T.filename_part(date.cast("string"), "sin-fecha")),
        ("{proveedor}", T.filename_part(vendor, "desconocido")),
        ("{palabra}", T.filename_part(word, vendor)),
        ("{numero}", T.filename_part(number, "sin-numero")),
    ):
        name = F.replace(name, F.lit(token), value)
    fine = F.length(F.coalesce(pattern, F.lit(""))) > 0
    fine = fine & (error.isNull() | (error == "")) if error is not None else fine
    return F.when(fine, F.concat(F.coalesce(T.null_if_empty(name), F.lit("factura")), F.lit(".pdf")))


_ROOT = r"(?:-[1-9][0-9]{0,8})+\z"


def running_sum(df: DataFrame, by: str, order: list[str], value: str, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each one of its ``by``, in ``order``.

    Sorted ranges are summed by themselves; what a ``by`` has in the ranges
    before is a sum over at most a row a range.  So one with a third of all
    rows is not in one task.
    """
    rows = staged(df.repartitionByRange(by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = rows.groupBy(by, "__part").agg(F.sum(value).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    # Only what goes on from one range into the next: at most a row a range.
    bases = totals.select(F.col(by).alias("__by"), F.col("__part").alias("__p"), before.alias("__base")).filter("__base > 0")
    local = F.coalesce(F.sum(value).over(Window.partitionBy(by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("__local", local).join(F.broadcast(bases), (F.col(by) == F.col("__by")) & (F.col("__part") == F.col("__p")), "left")
    return out.select(*df.columns, (F.col("__local") + F.coalesce("__base", F.lit(0))).cast("long").alias(name))


#: Numbers are counted in blocks of so many, so that a base's are not in one task.
BLOCK = 16384
#: A join's side is broadcast only after a count of its rows.
MOST_BROADCAST = 200_000


def _if_few(df: DataFrame) -> DataFrame:
    """A staged table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _in_blocks(df: DataFrame, by: str) -> DataFrame:
    """``df`` (b, ``by``, one) with ``block``, and ``base``: the sum of ``one`` over the blocks of its ``b`` before."""
    rows = df.withColumn("block", F.floor(F.col(by) / BLOCK))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.groupBy("b", "block").agg(F.sum("one").alias("n")).select("b", "block", earlier.alias("base"))


def _numbered(todo: DataFrame, used: DataFrame) -> DataFrame:
    """``todo`` (file, t, base, root) with ``number``: of each base the free numbers, in the order of the files.

    ``used`` has the numbers taken (b, n), each once, 0 for the name itself.
    Below the j-th of them there are n - j free numbers, so the free number of
    rank k is k plus how many have no more than k free ones below.  Both are
    counted in blocks of numbers: those of a block in their order, those of the
    blocks before as a sum.  A block has no more rows than its numbers, however
    many there are, as taken numbers with as many free ones below are one row.
    """
    ones = used.withColumn("one", F.lit(1))
    bases = _in_blocks(ones, "n")
    rank = F.row_number().over(Window.partitionBy("b", "block").orderBy("n")) - 1
    ranked = ones.withColumn("block", F.floor(F.col("n") / BLOCK)).withColumn("local", rank).join(bases, ["b", "block"])
    runs = ranked.groupBy("b", (F.col("n") - F.col("local") - F.col("base")).cast("long").alias("v")).agg(F.sum("one").cast("long").alias("one"))
    runs = staged(runs, "rename-runs")
    wishes = running_sum(todo.select(F.lower("base").alias("b"), "file", "t", "base", "root", F.lit(1).alias("one")), "b", ["file"], "one")
    wishes = wishes.select("b", F.col("before").alias("v"), F.lit(0).cast("long").alias("one"), F.struct("file", "t", "base", "root").alias("w"))
    # Each block that has wishes also gets, before its first number, what is taken in the blocks before it.
    most = todo.groupBy(F.lower("base").alias("b")).agg(F.floor((F.count("*") - 1) / BLOCK).alias("last"))
    blocks = most.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("block"))
    taken = runs.groupBy("b", F.floor(F.col("v") / BLOCK).alias("block")).agg(F.sum("one").alias("n"))
    order = Window.partitionBy("b").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.join(taken, ["b", "block"], "left").select("b", "block", F.sum(F.coalesce("n", F.lit(0))).over(order).alias("one"))
    nobody = F.lit(None).cast(wishes.schema["w"].dataType).alias("w")
    carried = carried.select("b", (F.col("block") * BLOCK).alias("v"), F.coalesce("one", F.lit(0)).cast("long").alias("one"), nobody)
    both = runs.select("b", "v", "one", nobody).unionByName(carried).unionByName(wishes).withColumn("block", F.floor(F.col("v") / BLOCK))
    # Rows of one number count for each other: what is taken counts for the wish of that rank.
    below = F.sum("one").over(Window.partitionBy("b", "block").orderBy("v"))
    return both.withColumn("below", below).filter("w IS NOT NULL").select("w.*", (F.col("v") + F.col("below")).alias("number"))


def rename_plan(rows: DataFrame, existing: DataFrame, file: str = "file", target: str = "new_name", reuse_freed: bool = False) -> DataFrame:
    """``file, new_name`` of the files to rename, without collisions.

    ``rows`` has files and wanted names (null: leave alone), ``existing`` the
    names in the folder.  A file that has its name already, in whatever case,
    keeps it.  All others get their name or its first free number, in the order
    of the files.  Names of files that are renamed are used again only with
    ``reuse_freed``; see rename_order() for the order that this needs.

    Numbers come from merged ranks.  Where a numbered name is also another
    file's wish (``a-1`` beside ``a``) the first file by name has it, and the
    other name's numbers are dealt anew without it; what a file has lost it
    can't have again, so a few rounds end where one file after the other would.
    """
    # A generated row: names may come from long expressions, and filters on them would be pushed below and repeat these.
    wanted = rows.select(F.explode(F.array(F.struct(F.col(file).alias("file"), F.col(target).alias("t")))).alias("x")).select("x.file", "x.t").filter("file IS NOT NULL AND t IS NOT NULL")
    right = F.lower("file") == F.lower("t")
    todo = wanted.filter(~right).withColumn("base", F.regexp_replace("t", r"(?i)\.pdf\z", "")).withColumn("root", F.regexp_replace(F.lower("base"), _ROOT, ""))
    todo = staged(todo, "rename-wishes")
    # A base's names are contested only by other bases of its root.
    bases = staged(todo.groupBy(F.lower("base").alias("b"), "root").agg(F.count("*").alias("n")), "rename-bases")
    shared = staged(bases.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root"), "rename-roots")
    there = existing.select(F.col(file).alias("name"))
    if reuse_freed:
        there = there.join(todo.select(F.col("file").alias("name")).distinct(), "name", "left_anti")
    taken = there.select(F.lower("name").alias("name")).union(wanted.filter(right).select(F.lower("t")))

    # The numbers that are taken for a base that is wished for: 0 is the name itself.
    part = lambda k: F.regexp_extract("name", r"\A(.*)-([1-9][0-9]{0,8})\.pdf\z", k)
    named = F.array(F.struct(part(1).alias("b"), part(2).try_cast("long").alias("n")), F.struct(F.regexp_replace("name", r"\.pdf\z", "").alias("b"), F.lit(0).cast("long").alias("n")))
    numbers = taken.select(F.explode(named).alias("x")).select("x.b", "x.n").filter("n IS NOT NULL")
    used = staged(numbers.join(_if_few(bases.select("b")), "b", "left_semi").distinct(), "rename-taken")
    new = F.when(F.col("number") == 0, F.col("t")).otherwise(F.concat("base", F.lit("-"), F.col("number").cast("string"), F.lit(".pdf")))
    if shared.isEmpty():
        return _numbered(todo, used).select("file", new.alias("new_name"))
    settled = None
    while True:
        plan = staged(_numbered(todo, used).withColumn("new_name", new), "rename-round")
        # A name is contested by as many bases as it has numbers to its end: few, whatever the number of files.
        contested = plan.join(shared, "root", "left_semi").groupBy(F.lower("new_name").alias("name")).agg(F.min("file").alias("first"), F.count("*").alias("n")).filter("n > 1")
        lost = staged(plan.join(contested, F.lower("new_name") == F.col("name")).filter("file <> first").select("root", F.lower("base").alias("b"), F.col("number").alias("n")), "rename-lost")
        again = lost.select("root").distinct()
        done = plan.join(again, "root", "left_anti").select("file", "new_name")
        settled = done if settled is None else settled.unionByName(done)
        if lost.isEmpty():
            return settled
        todo = staged(todo.join(again, "root", "left_semi"), "rename-wishes")
        used = staged(used.union(lost.select("b", "n")).distinct(), "rename-taken")


def _followed(edges: DataFrame) -> DataFrame:
    """``file, next, hops, least`` along ``edges`` (file, next) to the end, or around a ring: how many steps there were, and the least file met.

    Each round joins every path with the path of the same length that begins
    where it ends; paths that have ended (null) take no part.  While a chain
    goes on, some of its paths end in each round; and once twice the steps meet
    no lesser file on any path of a ring, all of them have met its least.  So a
    round without either is the last: rings need as many as their length has
    binary digits, however many files there are.
    """
    state = staged(edges.select("file", "next", F.col("next").isNotNull().cast("long").alias("hops"), F.col("file").alias("least"), F.lit(True).alias("new")), "rename-paths")
    while not state.filter("new AND next IS NOT NULL").isEmpty():
        ahead = state.select(F.col("file").alias("f"), F.col("next").alias("n"), F.col("hops").alias("h"), F.col("least").alias("l"))
        # Merged, as paths are never broadcast: that would send them to the driver in each round.
        on = state.filter("next IS NOT NULL").join(ahead.hint("merge"), F.col("next") == F.col("f"))
        moved = on.select("file", F.col("n").alias("next"), (F.col("hops") + F.col("h")).alias("hops"), F.least("least", "l").alias("least"), (F.col("n").isNull() | (F.col("l") < F.col("least"))).alias("new"))
        step = staged(moved.unionByName(state.filter("next IS NULL").withColumn("new", F.lit(False))), "rename-paths")
        if step.filter("new").isEmpty():
            return step.drop("new")
        # What ended or fell in this round may still be followed by others.
        state = step.withColumn("new", F.lit(True))
    return state.drop("new")


def rename_order(plan: DataFrame) -> DataFrame:
    """``step, file, new_name``: in the order of the steps every name is free when it is used.

    A file whose new name is another's old one follows that other; the steps of
    a chain are found by pointer doubling, in as many rounds as the longest one
    has binary digits.  Of a ring the first file by name steps aside, under a name
    of its own, before the others move up, and is the last to get its name.
    Files that keep their name are left out.
    """
    moves = staged(plan.filter("file <> new_name").select("file", "new_name"), "rename-moves")
    holders = moves.select(F.col("file").alias("next"), F.lower("file").alias("held"))
    edges = moves.join(holders.hint("merge"), (F.lower("new_name") == F.col("held")) & (F.col("file") != F.col("next")), "left").select("file", "new_name", "next").dropDuplicates(["file"])
    edges = staged(edges, "rename-edges")
    paths = _followed(edges)
    # What has not ended by then goes in a ring.
    rings = staged(paths.filter("next IS NOT NULL").select(F.col("file").alias("f"), F.col("least").alias("first")), "rename-rings")
    cut = edges.join(rings.hint("merge"), F.col("file") == F.col("f"), "left").withColumn("next", F.when(F.col("first").isNull() | (F.col("next") != F.col("first")), F.col("next"))).select("file", "new_name", "next", "first")
    cut = staged(cut, "rename-cut")
    steps = _followed(cut.select("file", "next")).select(F.col("file").alias("f"), (F.col("hops") + 1).alias("step"))
    aside = F.concat(F.lit(".moving-"), F.sha2("file", 256))
    ordered = cut.join(steps.hint("merge"), F.col("file") == F.col("f")).withColumn("apart", F.coalesce(F.col("file") == F.col("first"), F.lit(False)))
    moved = ordered.select("step", F.when(F.col("apart"), aside).otherwise(F.col("file")).alias("file"), "new_name")
    return moved.unionByName(ordered.filter("apart").select(F.lit(0).cast("long").alias("step"), "file", aside.alias("new_name")))


def apply_plan(rows: DataFrame, plan: DataFrame, file: str = "file") -> DataFrame:
    """``rows`` with the files' new names, for keeping a written table in step with renamed files."""
    p = plan.select(F.col("file").alias("__file"), F.col("new_name").alias("__new")).dropDuplicates(["__file"])
    names = [c for c in rows.columns if c != file]
    out = rows.join(p, F.col(file) == F.col("__file"), "left").withColumn("__name", F.coalesce("__new", F.col(file)))
    return out.select(F.col("__name").alias(file), *names)
