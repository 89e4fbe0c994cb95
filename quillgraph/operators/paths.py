"""The best paths from seeds by a bounded path algebra (GEN1, R6).

A path is a walk without a node met twice; its score is the sum of its nodes'
scores, the seed's left out.  Layer by layer only the best partial paths of every
(seed, node) are kept, so a layer holds at most ``k`` + 1 rows for each pair, never
all trails.  That loses no path of up to three edges: of the partial paths to a
node that differ in one place, at most one holds the next node already, so one
more than ``k`` is enough.

Edge cases: repeated edges and both directions of one are one step, loops are
none; nodes without a score count zero; ties go to the path whose nodes are
smaller, from the seed on; seeds without edges have no paths; repeated seeds are one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

LONGEST = 3


def _steps(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(a, b, gain): every edge from both ends, once, with the score of the node it leads to."""
    pairs = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    steps = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return materialize(steps.join(scores.select(F.col("id").alias("b"), "score"), "b", "left").select("a", "b", F.coalesce("score", F.lit(0)).alias("gain")), "path-steps")


def best_paths(seeds: DataFrame, edges: DataFrame, scores: DataFrame, hops: int = LONGEST, k: int = 8) -> DataFrame:
    """(seed, node, path, score, length, rank): the ``k`` best paths of each length from each of ``seeds(id)`` to each node it reaches.

    ``edges(src, dst)`` are walked both ways; ``scores(id, score)`` are PageRanks or other weights.
    """
    if not 1 <= hops <= LONGEST:
        raise ValueError(f"paths have 1 to {LONGEST} edges")
    steps = _steps(edges, scores)
    zero = F.lit(0).cast(steps.schema["gain"].dataType)
    layer = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.array("id").alias("path"), zero.alias("score")).distinct()
    order = Window.partitionBy("seed", "node").orderBy(F.desc("score"), "path")
    layers = []
    for n in range(1, hops + 1):
        grown = layer.join(steps, layer["node"] == steps["a"]).where(~F.array_contains("path", F.col("b")))
        grown = grown.select("seed", F.col("b").alias("node"), F.array_append("path", F.col("b")).alias("path"), (F.col("score") + F.col("gain")).alias("score"))
        kept = materialize(grown.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + (n < hops)), "path-layer")
        layer = kept.drop("rank")
        layers.append(kept.where(F.col("rank") <= k).withColumn("length", F.lit(n)))
    return reduce(DataFrame.unionByName, layers).select("seed", "node", "path", "score", "length", "rank")


def best_paths_of_seeds(seeds: DataFrame, edges: DataFrame, scores: DataFrame, hops: int = LONGEST, k: int = 8) -> DataFrame:
    """(seed, node, path, score, length, rank): the ``k`` best paths of each length from each of ``seeds(id)``, whatever node they reach.

    Of the paths with one beginning the best comes first, so the ``k`` best lie behind
    the ``k`` beginnings whose best ends are best.  A beginning's best end is among the
    few best neighbours of its last node, which are listed once; only the chosen
    beginnings are walked on, and the longest paths never all exist.
    """
    if not 1 <= hops <= LONGEST:
        raise ValueError(f"paths have 1 to {LONGEST} edges")
    steps = _steps(edges, scores)
    zero = F.lit(0).cast(steps.schema["gain"].dataType)
    near = Window.partitionBy("a").orderBy(F.desc("gain"), "b")
    # a path of n nodes bars n - 1 neighbours of its last one at most
    ends = steps.withColumn("place", F.row_number().over(near)).where(F.col("place") <= hops).groupBy("a").agg(F.array_sort(F.collect_list(F.struct("place", "b", "gain"))).alias("ends"))
    ends = materialize(ends, "path-ends")
    layer = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.array("id").alias("path"), zero.alias("score")).distinct()
    grow = lambda rows: rows.join(steps, rows["node"] == steps["a"]).where(~F.array_contains("path", F.col("b"))).select("seed", F.col("b").alias("node"), F.array_append("path", F.col("b")).alias("path"), (F.col("score") + F.col("gain")).alias("score"))
    order = Window.partitionBy("seed").orderBy(F.desc("score"), "path")
    layers = []
    for n in range(1, hops + 1):
        met = layer.join(ends, layer["node"] == ends["a"]).withColumn("end", F.get(F.filter("ends", lambda e: ~F.array_contains("path", e["b"])), F.lit(0))).where("end is not null")
        first = Window.partitionBy("seed").orderBy(F.desc(F.col("score") + F.col("end.gain")), F.array_append("path", F.col("end.b")))
        chosen = materialize(met.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).select("seed", "node", "path", "score"), "path-beginnings")
        layers.append(grow(chosen).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("length", F.lit(n)))
        layer = grow(layer)
    return materialize(reduce(DataFrame.unionByName, layers).select("seed", "node", "path", "score", "length", "rank"), "path-best")


def path_context(paths: DataFrame, edges: DataFrame, names: DataFrame, k: int = 8) -> DataFrame:
    """GEN1: (seed, path, score, length, rank, lines): the ``k`` best paths of each seed over all nodes and lengths.

    ``lines`` has an edge a line, written from its source to its target by
    ``names(id, name)``; where both directions exist, the one that the path walks.
    """
    order = Window.partitionBy("seed").orderBy(F.desc("score"), "length", "path")
    best = paths.drop("rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    parts = best.select("seed", "rank", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1).alias("x"), F.get("path", i).alias("y")))).alias("place", "p"))
    parts = parts.select("seed", "rank", "place", "p.x", "p.y")
    ends = F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")
    parts = parts.withColumn("low", F.least("x", "y")).withColumn("high", F.greatest("x", "y"))
    met = parts.join(edges.select(*ends, "src", "dst", "relation_type"), ["low", "high"]).withColumn("turned", (F.col("src") != F.col("x")).cast("int"))
    of = lambda end: names.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    met = met.join(of("src"), "src").join(of("dst"), "dst")
    line = F.concat("src_name", F.lit(" -["), "relation_type", F.lit("]-> "), "dst_name")
    lines = met.groupBy("seed", "rank", "place").agg(F.min_by(line, F.struct("turned", "relation_type")).alias("line"))
    texts = lines.groupBy("seed", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda s: s["line"]), "\n").alias("lines"))
    return best.join(texts, ["seed", "rank"]).select("seed", "path", "score", "length", "rank", "lines")
