"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document has an exponential key -ln(u) / q: u is a hash of its id, its text and its number among equal rows, q its
quality weight, so that smaller keys make a weighted sample without replacement. A source's target is a number of words. Whole epochs of the source come
first; the rest is the longest prefix of its documents by ascending key that fits, and then, for the gap that the next
document would exceed, documents of at most a quarter of it by ascending key, or else that document if this is nearer.

A hot source is never sorted in one task. Keys are hashed into ranges that hold about `range_rows` documents; range
sums (pre-aggregated before the shuffle) tell in which range the budget ends, and only the rows of that one range are
sorted. Every other row is decided by its range alone. Windows over sources and ranges hold counts, not documents: a
row for each source, and for each `range_rows` documents of a source (a few MB for a billion documents of one).

Defined cases: null text has size 0 and is never counted; a null source is a source of its own, the last; sources
without words have target 0; rows that share an id, or have none, are told apart by their texts, and equal rows by a
number, so each has a key of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, stored

#: Weights of the sources in order of their code points, again and again; most words of a source taken, in its sizes.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
#: Marks of markup, tables and junk that lower a document's quality weight.
SYMBOLS = "%$#*&|{}<>[]^~="
#: Equal rows that become numbers in one go.
NUMBERS = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def content() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def quality_weight(text: Column) -> Column:
    """0.25 to 1: the share of a text's characters that are no symbols."""
    n = F.coalesce(F.length(text), F.lit(0))
    plain = F.coalesce(F.length(F.translate(text, SYMBOLS, "")), F.lit(0))
    return F.when(n == 0, F.lit(0.25)).otherwise(F.lit(0.25) + F.lit(0.75) * plain / n)


def uniform() -> Column:
    """A number over 0 and under 1 from 52 bits of a hash of doc_id, content and number."""
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "content", F.col("number").cast("string"))
    bits = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def numbered(measured: DataFrame) -> DataFrame:
    """A row for each row, with its number among equal ones (0, 1, ...).

    Equal rows are counted before the shuffle, and a count becomes numbers again: for a large count in blocks, which are
    dealt to tasks before they do. So many copies of a row, or rows without ids and texts, load no task.
    """
    groups = measured.groupBy(*measured.columns).agg(F.count(F.lit(1)).alias("rows"))
    numbers = lambda first, last: F.explode(F.sequence(first, last)).alias("number")
    few = groups.where(F.col("rows") <= NUMBERS).select(*measured.columns, numbers(F.lit(0).cast("long"), F.col("rows") - 1))
    blocks = groups.where(F.col("rows") > NUMBERS).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / NUMBERS))))
    first = F.col("block") * NUMBERS
    many = blocks.repartition(F.col("content"), F.col("block")).select(*measured.columns, numbers(first, F.least(first + NUMBERS, F.col("rows")) - 1))
    return few.unionByName(many)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, n, quality (mean), target: shares by weight of all words, none over `most` times its source's size.

    A share that its cap ends is shared again by weight. In order of cap by weight, sources are capped as long as
    the even share of what is left would reach their caps.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.avg("quality").alias("quality"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighted = by_source.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), place + 1)).withColumn("cap", F.lit(most) * F.col("source_size"))
    ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    leveled = weighted.withColumn("level", level).withColumn("capped", F.col("cap") / F.col("w") <= F.col("level"))
    open_level = F.coalesce(F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"], F.lit(0.0))
    return leveled.withColumn("open", open_level).select("source", "source_size", "n", "quality", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("open") * F.col("w")).alias("target"))


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, range_rows: int = 4096) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words that the mix takes of the document), copies, sampling_key, content (hash of the text)."""
    measured = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("quality"), content().alias("content"))
    keyed = numbered(measured).withColumn("sampling_key", -F.log(uniform()) / F.col("quality"))
    sizes = stored(keyed, "mixture-sizes")
    goals = targets(sizes, weights, most).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(F.lit(0)).cast("long"))
    goals = goals.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))).withColumn("ranges", F.ceil(F.col("n") / range_rows))
    goals = stored(goals, "mixture-targets")
    # A key's range: with the source's mean quality this spreads keys about evenly over 0 to 1, in their order.
    slot = F.floor((F.lit(1.0) - F.exp(-F.col("sampling_key") * F.col("g_quality"))) * F.col("g_ranges")).cast("long")
    g = goals.select(F.col("source").alias("g_source"), *[F.col(c).alias(f"g_{c}") for c in ("source_size", "target", "epochs", "rest", "ranges", "quality")])
    placed = sizes.join(g, F.col("source").eqNullSafe(F.col("g_source"))).withColumn("slot", slot)
    sums = placed.groupBy("g_source", "slot").agg(F.sum("size").alias("words"), F.first("g_rest").alias("rest"))
    upto = Window.partitionBy("g_source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    last = stored(sums.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))).select(F.col("g_source").alias("l_source"), F.col("slot").alias("l_slot"), "before"), "mixture-ranges")
    # Only the range in which the budget ends is sorted; equal keys stay together.
    inside = placed.join(last, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("slot") == F.col("l_slot")))
    by_key = inside.groupBy("l_source", "l_slot", "sampling_key").agg(F.sum("size").alias("words"), F.max("size").alias("longest"), F.first("before").alias("before"), F.first("g_rest").alias("rest"))
    order = Window.partitionBy("l_source").orderBy("sampling_key")
    run = by_key.withColumn("upto", F.col("before") + F.sum("words").over(order))
    fits = F.when(F.col("upto") <= F.col("rest"), F.col("sampling_key"))
    edge = Window.partitionBy("l_source")
    run = run.withColumn("c_key", F.coalesce(F.max(fits).over(edge), F.lit(-1.0)))
    run = run.withColumn("gap", F.col("rest") - F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).over(edge), F.col("before")))
    # The document at the edge leaves a gap: shorter ones behind it fill that, again by key.
    short = run.where((F.col("sampling_key") > F.col("c_key")) & (F.col("longest") * 4 <= F.col("gap")))
    short = short.withColumn("filled", F.sum("words").over(order)).where(F.col("filled") <= F.col("gap"))
    beyond = F.when(F.col("upto") > F.col("rest"), F.struct("upto", "sampling_key"))
    cut = run.groupBy("l_source", "l_slot").agg(F.first("c_key").alias("c_key"), F.first("gap").alias("gap"), F.first("rest").alias("rest"), F.min(beyond).alias("next"))
    fill = short.groupBy(F.col("l_source").alias("f_source")).agg(F.max("sampling_key").alias("f_key"), F.max("filled").alias("filled"))
    ends = cut.join(fill, F.col("l_source").eqNullSafe(F.col("f_source")), "left")
    whole = F.col("next.upto") - F.col("rest") < F.col("gap") - F.coalesce(F.col("filled"), F.lit(0))  # the next document leaves a smaller difference
    ends = ends.select("l_source", "l_slot", "gap", F.when(whole, F.col("next.sampling_key")).otherwise(F.col("c_key")).alias("c_key"), F.when(~whole, F.col("f_key")).alias("f_key"))
    ends = stored(ends, "mixture-ends")
    out = placed.join(ends, F.col("source").eqNullSafe(F.col("l_source")), "left")
    filled = (F.col("sampling_key") <= F.col("f_key")) & (F.col("size") * 4 <= F.col("gap"))
    chosen = F.coalesce((F.col("slot") < F.col("l_slot")) | ((F.col("slot") == F.col("l_slot")) & ((F.col("sampling_key") <= F.col("c_key")) | F.coalesce(filled, F.lit(False)))), F.lit(False))
    copies = F.col("g_epochs") + (chosen & (F.col("g_rest") > 0)).cast("long")
    return out.select("doc_id", "source", "size", F.col("g_source_size").alias("source_size"), F.col("g_target").alias("target"), (copies * F.col("size")).alias("taken"), copies.alias("copies"), "sampling_key", "content")


def _by_group(docs: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """Documents joined with their groups of equal id, text and source."""
    same = F.col("doc_id").eqNullSafe(F.col("_lexloom_id")) & F.col("source").eqNullSafe(F.col("_lexloom_source")) & (content() == F.col("_lexloom_content"))
    return docs.join(groups, same, how)


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document, with all its columns, as many times as `mixture` takes it.

    Of rows with the same id, text and source, the budget may take some once more than others. Which ones does not
    matter: they are counted off, by the tasks that hold them, so that many equal rows load no task.
    """
    own = [quoted(c) for c in docs.columns]
    keys = {"doc_id": "_lexloom_id", "source": "_lexloom_source", "content": "_lexloom_content"}
    groups = mixture(docs).groupBy(*[F.col(k).alias(v) for k, v in keys.items()]).agg(F.min("copies").alias("_lexloom_copies"), F.max("copies").alias("_lexloom_most"), F.sum("copies").alias("_lexloom_sum"), F.count(F.lit(1)).alias("_lexloom_rows"))
    groups = stored(groups.where(F.col("_lexloom_most") > 0), "mixture-groups")
    even, uneven = groups.where("_lexloom_copies = _lexloom_most"), groups.where("_lexloom_copies < _lexloom_most")
    parts = _by_group(docs, even).select(*own, "_lexloom_copies")
    if not uneven.isEmpty():
        held = stored(_by_group(docs, uneven).withColumn("_lexloom_task", F.spark_partition_id()), "mixture-uneven")
        tasks = held.groupBy(*keys.values(), "_lexloom_task").agg(F.count(F.lit(1)).alias("_lexloom_n"))
        before = Window.partitionBy(*keys.values()).orderBy("_lexloom_task").rowsBetween(Window.unboundedPreceding, -1)
        tasks = tasks.select(*[F.col(c).alias(f"{c}_t") for c in (*keys.values(), "_lexloom_task")], F.coalesce(F.sum("_lexloom_n").over(before), F.lit(0)).alias("_lexloom_before"))
        same = [F.col(c).eqNullSafe(F.col(f"{c}_t")) for c in (*keys.values(), "_lexloom_task")]
        placed = held.join(tasks, same[0] & same[1] & same[2] & same[3])
        place = F.row_number().over(Window.partitionBy(*keys.values(), "_lexloom_task").orderBy("_lexloom_task")) + F.col("_lexloom_before")
        extra = F.col("_lexloom_sum") - F.col("_lexloom_rows") * F.col("_lexloom_copies")
        counted = placed.withColumn("_lexloom_place", place).withColumn("_lexloom_copies", F.col("_lexloom_copies") + (F.col("_lexloom_place") <= extra).cast("long"))
        parts = parts.unionByName(counted.where(F.col("_lexloom_copies") > 0).select(*own, "_lexloom_copies"))
    return parts.withColumn("_lexloom_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_lexloom_copies")))).select(*own)
