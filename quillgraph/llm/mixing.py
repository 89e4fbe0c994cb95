"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: each source may give at most ``max_repeat`` times its size; ``share``
times the total is dealt out by weight, and what a capped source can't take goes
to the others by weight until none is above its cap (water filling).

Schedule: slot i of the mix looks at the i-th golden-ratio point, the fractional
part of i times the golden ratio, in the cumulative target shares, which names
the slot's source; slots are ranked per source.  Every slot is worth one block
of the same number of tokens.  A source's documents, shuffled by hash, form a
line of tokens that is repeated as often as needed, and the slot of rank r takes
the r-th block of it.  So the schedule decides how many blocks a source gives:
the number of its slots, brought to the block below or above its target where
the sequence's discrepancy put it further off (1 at least), and never a token
beyond the target.  Every prefix of the mix holds the sources near their shares.

A document comes in the slot of the block that holds its first token, once for
each repetition of its source's line; its part is what its tokens share with
taken blocks.  Documents meet slots by an equal join on source and rank.

Ranks and token offsets are prefix sums over hash or number buckets, so a source
with a third of all rows is still spread over many tasks.

Edge cases: a null text has size 0, takes nothing and has no slot; null sources
form one source, ordered last; a source without tokens has target 0; repeated
rows are separate documents, null ids included; texts of any length are read
whole; an empty table gives an empty result; extra columns are ignored by
:func:`mix` and kept by :func:`apply_mix`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .tables import set_aside, with_places

GOLDEN = 0.6180339887498949
#: Slots of the schedule for each source, on average.
SLOTS_PER_SOURCE = 65536
#: Rows of a bucket whose tokens are summed inside one window.
BUCKET_ROWS = 4096
WEIGHTS = (3, 1, 2)
WORDS = "[^\\x20\\x09-\\x0D]+"


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, h, bits, row) and ``keep``: narrow rows that the rest works on.

    h is the hash that shuffles a source; bits are its first 32 bits.
    """
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), h.alias("h"), *keep)
    return rows.withColumn("bits", F.conv(F.substring("h", 1, 8), 16, 10).cast("long")).withColumn("row", F.monotonically_increasing_id())


def targets(rows: DataFrame, share: float = 1.5, max_repeat: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, has_source, source_size, weight, target), one row per source.

    Sources are sorted by cap per unit of weight; source k is capped exactly if
    the water level of all sources from k on is at its cap or above.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    pick = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    table = totals.withColumn("weight", pick.cast("long"))
    order = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").isNull(), "source")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.lit(max_repeat) * F.coalesce(F.sum("source_size").over(below), F.lit(0))) / F.sum("weight").over(from_here)
    table = table.withColumn("level", level).withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    free = F.col("weight") * F.col("level") < F.col("cap")
    table = table.withColumn("k", F.row_number().over(order)).withColumn("free", free)
    final = F.min(F.when(F.col("free"), F.struct("k", "level"))).over(everything)["level"]
    table = table.withColumn("final", final)
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("final")))
    return table.select("source", F.col("source").isNotNull().alias("has_source"), "source_size", "weight", target.cast("double").alias("target"))


def schedule(plan: DataFrame, slots: int, n_sources: int) -> DataFrame:
    """(slot, sid, rank, n_slots): every slot of the mix with its source and its rank there.

    ``plan(sid, tokens)`` has a row per source, tokens being its rounded target.
    """
    spark = plan.sparkSession
    order = Window.orderBy("sid")
    total = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    upto = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    bounds = plan.where("tokens > 0").select("sid", (upto / total).alias("hi"), ((upto - F.col("tokens")) / total).alias("lo"))
    # a point and its interval meet by a grid cell: an equi join, whatever the number of sources
    cells = max(1, n_sources)
    turn = F.col("id") * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("slot"), (turn - F.floor(turn)).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * cells).cast("long"))
    covered = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells).cast("long"), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)).cast("long"))))
    named = points.join(covered, "cell").where("u >= lo and u < hi").select("slot", "sid")
    named = named.withColumn("chunk", F.expr("slot div 1024"))
    counts = named.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("n_slots", F.sum("n").over(Window.partitionBy("sid"))).drop("n")
    ranked = named.withColumn("r", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1)
    return ranked.join(before, ["sid", "chunk"]).select("slot", "sid", (F.col("before") + F.col("r")).alias("rank"), "n_slots")


def token_lines(rows: DataFrame) -> DataFrame:
    """``rows`` with ``first``: the place of a document's first token on its source's shuffled line.

    Buckets of a source are ranges of its hash, as many as its rows ask for.
    """
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", F.expr(f"greatest(1, n div {BUCKET_ROWS})").alias("buckets"))
    keyed = rows.alias("r").join(counts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))).select("r.*", F.expr("(r.bits * c.buckets) div 4294967296").alias("bucket"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("tokens"))
    before = sums.withColumn("before", F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("tokens")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = keyed.alias("k").join(before.alias("b"), F.col("k.source").eqNullSafe(F.col("b.source")) & (F.col("k.bucket") == F.col("b.bucket")))
    return joined.select("k.*", (F.col("b.before") + F.col("k.inside")).alias("first")).drop("bucket", "inside", "bits")


def planned(rows: DataFrame, share: float, max_repeat: int, weights: tuple[int, ...], slots_per_source: int) -> tuple[DataFrame, DataFrame, int]:
    """(plan, slots, block): sources with the tokens that their blocks hold, the schedule, and the tokens of a block."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    plan = targets(rows, share, max_repeat, weights).withColumn("sid", F.row_number().over(order).cast("long"))
    plan = materialize(plan.withColumn("tokens", F.round("target").cast("long")), "mix-plan")
    n, total = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    block = max(1, -(-total // max(1, n * slots_per_source)))
    slots = materialize(schedule(plan.select("sid", "tokens"), -(-total // block), n), "mix-slots")
    given = slots.groupBy("sid").agg(F.max("n_slots").alias("given"))
    low, high = F.expr(f"tokens div {block}"), F.expr(f"(tokens + {block - 1}) div {block}")
    blocks = F.greatest(F.least(F.greatest(F.coalesce("given", F.lit(0)), low), high), F.least(high, F.lit(1)))
    plan = plan.join(given, "sid", "left").withColumn("n_blocks", blocks.cast("long"))
    return plan.withColumn("give", F.least("tokens", F.col("n_blocks") * block)).drop("given"), slots, block


def placements(rows: DataFrame, plan: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """(row, lap, slot, part): where each repetition of a document comes and how many of its tokens it takes.

    Blocks that the sequence named no slot for (the discrepancy's last few) come after all others.
    """
    line = token_lines(rows.where("size > 0")).alias("l").join(plan.alias("p"), F.col("l.source").eqNullSafe(F.col("p.source")))
    line = line.select("l.row", "l.size", "l.first", "p.sid", "p.source_size", "p.give")
    laps = line.withColumn("lap", F.explode(F.expr("sequence(0L, (give - 1) div source_size)"))).withColumn("at", F.expr("lap * source_size + first")).where("at < give")
    laps = laps.withColumn("part", F.least("size", F.col("give") - F.col("at"))).withColumn("rank", F.expr(f"at div {block}"))
    late = F.lit(1 << 40) + F.col("rank")
    return laps.join(slots.select("sid", "rank", "slot"), ["sid", "rank"], "left").select("row", "lap", F.coalesce("slot", late).alias("slot"), "part", "size")


def mix(docs: DataFrame, share: float = 1.5, max_repeat: int = 2, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots_per_source: int = SLOTS_PER_SOURCE) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, slot) for every document; slot is that of its first block (null: none)."""
    rows = materialize(sized(docs, id_col, text_col, source_col), "mix-rows")
    plan, slots, block = planned(rows, share, max_repeat, weights, slots_per_source)
    taken = placements(rows, plan, slots, block).groupBy("row").agg(F.sum("part").alias("taken"), F.min("slot").alias("slot"))
    full = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.*", "p.source_size", "p.target")
    full = full.join(taken, "row", "left")
    return full.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "slot")


def apply_mix(docs: DataFrame, share: float = 1.5, max_repeat: int = 2, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots_per_source: int = SLOTS_PER_SOURCE) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, in the order of slots.

    A repetition that takes half a document's tokens or more comes whole, a
    smaller part not at all; only the document at a source's end has a broken
    part.  Files written from the result follow the schedule.
    """
    given, names = set_aside(docs)
    placed = with_places(given, "mix-docs")
    rows = materialize(sized(placed, names[id_col], names[text_col], names[source_col], ("__file", "__at")), "mix-rows")
    plan, slots, block = planned(rows, share, max_repeat, weights, slots_per_source)
    where = placements(rows, plan, slots, block).where("2 * part >= size").select("row", "slot")
    where = rows.select("row", "__file", "__at").join(where, "row").select("__file", "__at", "slot")
    taken = materialize(where.groupBy("__file", "__at").agg(F.collect_list("slot").alias("__slots")), "mix-taken")
    out = placed.join(taken, ["__file", "__at"]).withColumn("__slot", F.explode("__slots"))
    return out.repartitionByRange("__slot").sortWithinPartitions("__slot").select(*names.values()).toDF(*docs.columns)
