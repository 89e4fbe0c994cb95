"""Exact vector search and neighbour graphs by blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and blocks of queries and of vectors that a task holds at most.
BLOCK, WIDE = 4096, 16
#: Rows of a block whose scores are held at once, and rows with their cells that are handed over at once.
STRIP, HANDED = 256, 16_384
#: Numbers gathered at once to score single pairs; for more pairs the block's product is taken again in double precision.
GATHERED = 4_000_000


def _matrix(column: pd.Series) -> np.ndarray:
    m = np.array(column.tolist(), np.float64)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return m / norms


def _nearest(left: pd.DataFrame, right: pd.DataFrame, k: int, ties: str = "small", exclude_self: bool = False) -> pd.DataFrame:
    """(query_id, vec_id, score): the ``k`` rows of ``right`` nearest to each of ``left``, a strip of rows and a block of vectors at a time.

    Products in single precision tell which pairs may be among the best, by more than their error can be; only those are scored, in double precision.
    """
    parts = [pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})]
    if len(left) and len(right):
        right = right.sort_values("vec_id", ascending=ties == "small")
        ids, held, every = right["vec_id"].to_numpy(), _matrix(right["right_vec"]), left["query_id"].to_numpy()
        light, places = held.astype(np.float32), held.shape[1]
        error = (places + 8) * 2.5e-7
        for at in range(0, len(left), STRIP):
            qids, rows = every[at : at + STRIP], _matrix(left["left_vec"].iloc[at : at + STRIP])
            near_to = rows.astype(np.float32)
            row, place, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            bar = np.full(len(rows), -np.inf)  # the k-th best score so far; a later place needs more
            for low in range(0, len(ids), BLOCK):
                near = near_to @ light[low : low + BLOCK].T
                least = bar - error
                if not low and near.shape[1] > k + 1:
                    some = near[:, : max(k + 2, BLOCK // 4)]
                    least = np.take_along_axis(some, np.argsort(-some, axis=1)[:, k : k + 1], 1)[:, 0] - error
                    least[np.isnan(least)] = -np.inf
                i, j = np.nonzero(near >= least.astype(np.float32)[:, None])
                if len(i) * places > GATHERED:
                    exact = np.round(rows @ held[low : low + BLOCK].T, 9)
                    if low:
                        i, j = np.nonzero(exact > bar[:, None])
                    new = exact[i, j]
                else:
                    new = np.round(np.einsum("ij,ij->i", rows[i], held[low + j]), 9)
                j = j + low
                better = (new > bar[i]) & np.isfinite(new)
                if exclude_self:
                    better &= qids[i] != ids[j]
                if not better.any():
                    continue
                row, place, score = np.r_[row, i[better]], np.r_[place, j[better]], np.r_[score, new[better]]
                order = np.lexsort((place, -score, row))
                row = row[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                order, row = order[rank < k], row[rank < k]
                place, score = place[order], score[order]
                last = rank[rank < k] == k - 1
                bar[row[last]] = score[last]
            parts.append(pd.DataFrame({"query_id": qids[row], "vec_id": ids[place], "score": score}))
    return pd.concat(parts[1:] or parts)


def block_top_k(queries: DataFrame, vectors: DataFrame, k: int, ties: str = "small", exclude_self: bool = False, n_queries: int | None = None, n_vectors: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` vectors of largest cosine for each query.

    ``queries(query_id, embedding)`` and ``vectors(vec_id, embedding)`` are cut
    into as few blocks as keep all cores busy, of ``BLOCK * WIDE`` rows at most;
    each pair of blocks is one task, which gives back ``k`` rows per query, so
    memory is bounded by the block size and the shuffle by (queries x vector
    blocks).  Equal scores go to the smaller id, or the larger with ``ties="large"``.
    """
    nq = queries.count() if n_queries is None else n_queries
    nv = vectors.count() if n_vectors is None else n_vectors
    blocks = lambda n, tasks: max(1, -(-n // (BLOCK * WIDE)), min(tasks, -(-n // BLOCK)))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    v_blocks = blocks(nv, cores)
    q_blocks = blocks(nq, -(-cores // v_blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # cogroup does not bring both sides' keys to one type, and an int and a long of equal value go to different partitions
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.select((F.col("query_id") + F.lit(0).cast("long")).alias("query_id"), F.col("embedding").alias("left_vec"), block("query_id", q_blocks).alias("qb"), every(v_blocks).alias("vb"))
    v = vectors.select((F.col("vec_id") + F.lit(0).cast("long")).alias("vec_id"), F.col("embedding").alias("right_vec"), block("vec_id", v_blocks).alias("vb"), every(q_blocks).alias("qb"))
    sign = 1 if ties == "small" else -1

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _nearest(left, right, k, ties, exclude_self)

    pairs = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(product, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id") * sign)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine(a, b):
    """F28 as an expression, for one pair per row; a zero vector gives 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, t: s + t)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def adaptive_cut(neighbours: DataFrame) -> DataFrame:
    """(query_id, cut) from each row's positive top scores."""
    pos = F.when(F.col("score") > 0, F.col("score"))
    stats = neighbours.groupBy("query_id").agg(F.count(pos).alias("n"), F.expr("percentile(case when score > 0 then score end, 0.5)").alias("median"), F.avg(pos).alias("mean"), F.stddev_pop(pos).alias("sd"), F.max(pos).alias("top"))
    cut = F.when(F.col("n") <= 1, F.coalesce("top", F.lit(1.0))).otherwise(F.least(F.greatest("median", F.col("mean") + F.col("sd")), "top"))
    return stats.select("query_id", cut.alias("cut"))


def knn_graph(vectors: DataFrame, k: int = 10) -> DataFrame:
    """(src, dst, weight) with neighbours at or above each node's adaptive cut."""
    top = block_top_k(vectors.withColumnRenamed("vec_id", "query_id"), vectors, k, ties="large", exclude_self=True).where("score > 0")
    cuts = adaptive_cut(top)
    return top.join(cuts, "query_id").where(F.col("score") >= F.col("cut") - 1e-9).select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), F.col("score").alias("weight"))


def passage_search(queries: DataFrame, passages: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, passage_id, score, rank and the passage's columns): the ``k`` nearest of passages(id, ...) by cosine; passages without a vector are left out."""
    held = vectors.join(passages.select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    found = block_top_k(queries, held, k).withColumnRenamed("vec_id", "passage_id")
    return found.join(passages.withColumnRenamed("id", "passage_id"), "passage_id")


def mean_cosine(queries: DataFrame, vectors: DataFrame, group: str) -> DataFrame:
    """(query_id, mean_cosine): each query's mean cosine with the vectors of its group.

    The mean of cosines is the product with the mean of unit vectors, so groups
    are summed once, place by place and map-side, and no pair is ever formed.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = lambda v: F.transform(v, lambda x: F.when(norm(v) == 0, 0.0).otherwise(x.cast("double") / norm(v)))
    sums = vectors.select(group, F.posexplode(unit(F.col("embedding"))).alias("place", "x")).groupBy(group, "place").agg(F.avg("x").alias("x"))
    means = sums.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("m")).select(group, F.transform("m", lambda p: p["x"]).alias("m"))
    rows = queries.select("query_id", group, unit(F.col("embedding")).alias("u")).join(means, group)
    return rows.select("query_id", F.aggregate(F.zip_with("u", "m", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("mean_cosine"))


#: Vectors that an index is fitted on, and the cells it has per root of their number.
INDEX_SAMPLE = 20_000


def fit_index(vectors: DataFrame, k: int = 10, recall: float = 0.95, cells: int | None = None, sample: int = INDEX_SAMPLE, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, int]:
    """IDX1: (centroids, probes): spherical k-means in numpy on at most ``sample`` rows chosen by a hash of the id.

    ``probes`` is the least number of cells in which the sample's own rows find
    the share ``recall`` of their ``k`` nearest, so vectors without clusters get
    more of them.
    """
    n = vectors.count()
    some = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < min(1 << 20, 1 + (sample * 5 // 4 << 20) // max(1, n))).select("vec_id", "embedding")
    rows = some.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(sample).toPandas()
    if rows.empty:
        return np.zeros((1, 1)), 1
    x = _matrix(rows["embedding"])
    k = min(len(x), cells or max(1, int(np.sqrt(min(n, 50 * sample)))))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.bincount(own, minlength=k) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    own = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
    asked = x[rng.choice(len(x), min(len(x), 200), replace=False)]
    nearest = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell in a row's order
    depth = np.sort(np.take_along_axis(place, own[nearest], 1).ravel())
    return centres, int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) + 1


def in_cells(vectors: DataFrame, centres: np.ndarray, probes: int, id_col: str) -> DataFrame:
    """(id, embedding, cell): every row with its ``probes`` nearest cells."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(frames):
        for whole in frames:
            for at in range(0, len(whole), max(1, HANDED // probes)):  # a row is repeated for each of its cells
                f = whole.iloc[at : at + max(1, HANDED // probes)]
                best = np.argsort(-(_matrix(f["embedding"]) @ shared.value.T), axis=1, kind="stable")[:, :probes]
                out = f.loc[f.index.repeat(best.shape[1])]
                yield out.assign(cell=best.ravel().astype(np.int32))

    rows = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInPandas(run, f"{id_col} long, embedding array<double>, cell int")


def indexed_top_k(queries: DataFrame, vectors: DataFrame, k: int, centres: np.ndarray, probes: int) -> DataFrame:
    """IDX1, R1: like :func:`block_top_k`, looking only into each query's ``probes`` nearest cells.

    Every vector is indexed, in one cell.  A cell of many rows is cut into slices
    of ``BLOCK`` rows, each a task with the cell's queries, so a hot cell is spread.
    Cosines are exact, what a query's cells don't hold is missed; recall is measured in the tests.
    """
    held = in_cells(vectors, centres, 1, "vec_id")
    sizes = held.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).withColumn("slices", F.ceil(F.col("size") / BLOCK).cast("int")).select("cell", "slices")
    v = held.join(sizes, "cell").select("vec_id", F.col("embedding").alias("right_vec"), "cell", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int").alias("slice"))
    q = in_cells(queries, centres, probes, "query_id").join(sizes, "cell").select("query_id", F.col("embedding").alias("left_vec"), "cell", F.explode(F.expr("sequence(0, slices - 1)")).alias("slice"))

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _nearest(left, right, k)

    pairs = q.groupBy("cell", "slice").cogroup(v.groupBy("cell", "slice")).applyInPandas(product, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
