"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors become one node with a weight.
2. Cells are fitted by k-means on a bounded sample; every node lies in its
   ``overlap`` nearest cells and is at home in the nearest.  A cell is a shard;
   one of more than ``SHARD_ROWS`` rows is cut into slices, each a shard.
3. Each shard builds a graph: candidates are a node's nearest in the shard and
   some far ones, robust pruning keeps those that no kept one covers, reverse
   edges are added and pruned again; every node stays reachable from its nearest.
4. A node's adjacency lists of all its shards are united.
5. In every shard each of its rows is searched for over the united lists: greedy,
   from the shard's medoid and from the row itself where the shard holds it, with a beam; whatever lies
   within ``LOOSE`` times the range is expanded too, so a group of any size is found.
   Only members at home in the shard are counted, so a link is counted once.
   Cosines at the threshold or above are confirmed in double precision.
6. A hash sample is compared with all vectors; below ``recall`` of its links,
   overlap and beam are doubled and the search is run again, up to all cells and
   a beam of ``WIDEST``; a recall that is missed even then is a warning.

Rows of a search are a node's count and the root of its links in the shard, so
no pair leaves a task.  A cut cell is searched by pairs of slices, which is
quadratic for one cell of very many rows that are near each other but not equal.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are their own component; vectors of different
lengths don't link; equal vectors link, and rows that repeat an id count as rows;
a null id takes part, and a component's name is its smallest id that isn't null
(null if there is none); kept is true where id and component are equal, two nulls
included; other columns are not read, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..storage import discard, materialize
from .simhash import _star, by_task

#: Rows that k-means is fitted on, rows of a cell on average, and rows of a shard at most.
SAMPLE, CELL_ROWS, SHARD_ROWS = 20_000, 2048, 16_384
#: Edges that pruning leaves a node, candidates from near and far, and the pruning factor.
DEGREE, NEAR, FAR, ALPHA = 32, 48, 16, 1.2
#: A node's nearest neighbours from which it can be reached in any case.
ENTRIES = 3
BEAM, WIDEST, EXPAND, LOOSE = 32, 512, 4, 1.25
#: Sampled rows of the audit.
AUDITED = 1000


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, without overflow on the way."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def fit_cells(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Unit centres of ``k`` cells by spherical k-means on unit rows ``x``."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        bare = np.linalg.norm(sums, axis=1) < 1e-9
        sums[bare] = x[rng.choice(len(x), int(bare.sum()))]
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


def prune(x: np.ndarray, at: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning for the nodes ``at``: (len(at), degree) neighbours out of ``candidates``, -1 where there are fewer.

    The nearest candidate is kept and those go that it is ``alpha`` times nearer to
    than the node is, again and again.  Candidates of -1, the node itself and repeats don't count.
    """
    sims = np.einsum("nd,ncd->nc", x[at], x[candidates], optimize=True)
    sims[(candidates < 0) | (candidates == at[:, None])] = -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
    alive = np.isfinite(sims)
    by_id = np.argsort(ids, axis=1, kind="stable")
    again = np.zeros_like(alive)
    np.put_along_axis(again, by_id[:, 1:], np.diff(np.take_along_axis(ids, by_id, 1), axis=1) == 0, 1)
    alive &= ~again
    far = np.sqrt(np.maximum(0, 2 - 2 * np.where(alive, sims, -1)))
    held = x[ids]
    apart = np.sqrt(np.maximum(0, 2 - 2 * (held @ held.transpose(0, 2, 1))))
    kept = np.full((len(at), degree), -1, np.int64)
    row = np.arange(len(at))
    for r in range(degree):
        first = alive.argmax(1)
        has = alive[row, first]
        if not has.any():
            break
        kept[has, r] = ids[row, first][has]
        alive &= alpha * apart[row, first] > far
        alive[row, first] = False
    return kept


def build(x: np.ndarray, seed: int) -> np.ndarray:
    """The robust-pruned graph over the unit rows ``x``: neighbours row by row, -1 where there are fewer."""
    n = len(x)
    rng = np.random.default_rng(seed)
    near = min(NEAR, n - 1)
    graph = np.full((n, DEGREE), -1, np.int64)
    if n < 2:
        return graph
    for i in range(0, n, 256):
        at = np.arange(i, min(n, i + 256))
        sims = x[at] @ x.T
        sims[np.arange(len(at)), at] = -np.inf
        best = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        graph[at] = prune(x, at, np.concatenate([best, rng.integers(0, n, (len(at), FAR))], axis=1))
    source, target = np.repeat(np.arange(n), DEGREE), graph.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.lexsort((-np.einsum("nd,nd->n", x[source], x[target], optimize=True), target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target, "left")
    some = place < 2 * DEGREE  # a node's nearest reverse edges; pruning leaves DEGREE of all
    back = np.full((n, 2 * DEGREE), -1, np.int64)
    back[target[some], place[some]] = source[some]
    for i in range(0, n, 256):
        at = np.arange(i, min(n, i + 256))
        graph[at] = prune(x, at, np.concatenate([graph[at], back[at]], axis=1))
    return np.concatenate([graph, entries(graph)], axis=1)


def entries(graph: np.ndarray) -> np.ndarray:
    """Edges by which every node can be reached from its ``ENTRIES`` nearest neighbours, few per node.

    Pruning may leave a node without an edge to it.  The nodes that have v among
    their nearest form a heap below v: v leads to the first, the i-th to the 2i-th
    and the next, so that v may have any number of them.
    """
    n = len(graph)
    extra = np.full((n, 1 + 2 * ENTRIES), -1, np.int64)
    source, rank = np.repeat(np.arange(n), ENTRIES), np.tile(np.arange(ENTRIES), n)
    target = graph[:, :ENTRIES].ravel()
    some = target >= 0
    source, rank, target = source[some], rank[some], target[some]
    order = np.lexsort((source, target))
    source, rank, target = source[order], rank[order], target[order]
    first = np.searchsorted(target, target, "left")
    size = np.searchsorted(target, target, "right") - first
    place = np.arange(len(target)) - first + 1
    extra[target[place == 1], 0] = source[place == 1]
    for child in (0, 1):
        has = 2 * place + child <= size
        extra[source[has], 1 + 2 * rank[has] + child] = source[(first + 2 * place + child - 1)[has]]
    return extra


def medoid(x: np.ndarray) -> int:
    """The row of the largest cosine with the mean."""
    return int((x @ x.mean(axis=0)).argmax())


class Search:
    """Range-expanding greedy search over the unit rows ``x`` with neighbour lists ``graph`` (-1: none)."""

    def __init__(self, x: np.ndarray, graph: np.ndarray, threshold: float, beam: int = BEAM):
        self.x, self.fast, self.graph, self.threshold, self.beam = x, x.astype(np.float32), graph, threshold, beam
        self.loose = 1 - (1 - threshold) * LOOSE * LOOSE
        self.start = medoid(x)

    def run(self, queries: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, row number) of every pair found at the threshold or above; ``own`` is a query's own row, -1 if it has none."""
        n, m = len(self.x), len(queries)
        fast = queries.astype(np.float32)
        seen, expanded = np.zeros(m * n, bool), np.zeros(m * n, bool)
        owner = np.zeros(m * n, np.int32)
        near: list[np.ndarray] = []  # pair keys within the loose range

        def look(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Places in ``keys`` that are new, each pair once, and their cosines."""
            at = np.flatnonzero(~seen[keys])
            owner[keys[at]] = np.arange(len(at), dtype=np.int32)
            at = at[owner[keys[at]] == np.arange(len(at))]
            found = keys[at]
            seen[found] = True
            sims = np.empty(len(found), np.float32)
            for i in range(0, len(found), 65_536):
                q, r = np.divmod(found[i : i + 65_536], n)
                sims[i : i + 65_536] = np.einsum("nd,nd->n", fast[q], self.fast[r], optimize=True)
            near.append(found[sims >= self.loose])
            return at, sims

        row = np.arange(m)
        starts = np.stack([np.full(m, self.start), np.where(own < 0, self.start, own)], axis=1)
        ids, sims = np.full((m, self.beam), -1, np.int64), np.full((m, self.beam), -np.inf, np.float32)
        places, got = look((row[:, None] * n + starts).ravel())
        ids[places // 2, places % 2], sims[places // 2, places % 2] = starts.ravel()[places], got
        waiting = sims.copy()  # -inf for what is expanded
        while True:
            best = np.argpartition(-waiting, EXPAND - 1, axis=1)[:, :EXPAND]
            use = np.isfinite(np.take_along_axis(waiting, best, 1))
            if not use.any():
                break
            np.put_along_axis(waiting, best, -np.inf, 1)
            picked = np.where(use, np.take_along_axis(ids, best, 1), 0)
            expanded[(row[:, None] * n + picked)[use]] = True
            reach = np.where(use[:, :, None], self.graph[picked], -1).reshape(m, -1)
            flat = np.flatnonzero(reach.ravel() >= 0)
            keys = (flat // reach.shape[1]) * n + reach.ravel()[flat]
            places, got = look(keys)
            fresh = np.full(reach.size, -np.inf, np.float32)
            fresh[flat[places]] = got
            fresh = fresh.reshape(reach.shape)
            both, open_ = np.concatenate([sims, fresh], axis=1), np.concatenate([waiting, fresh], axis=1)
            top = np.argpartition(-both, self.beam - 1, axis=1)[:, : self.beam]
            ids = np.take_along_axis(np.concatenate([ids, reach], axis=1), top, 1)
            sims, waiting = np.take_along_axis(both, top, 1), np.take_along_axis(open_, top, 1)
        frontier = np.concatenate(near)
        frontier = frontier[~expanded[frontier]]
        while len(frontier):
            before = len(near)
            for i in range(0, len(frontier), 8192):
                q, r = np.divmod(frontier[i : i + 8192], n)
                reach = self.graph[r]
                look((q[:, None] * n + reach)[reach >= 0])
            frontier = np.concatenate(near[before:])
        q, r = np.divmod(np.concatenate(near), n)
        hit = np.concatenate([np.einsum("nd,nd->n", queries[q[i : i + 65_536]], self.x[r[i : i + 65_536]], optimize=True) >= self.threshold for i in range(0, len(q), 65_536)] or [np.zeros(0, bool)])
        return q[hit], r[hit]


MEMBER = "task long, node long, weight long, home boolean, side int, v array<double>"


def members(nodes: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """(cell, node, weight, home, v): every node with its ``overlap`` nearest cells; v is its unit vector."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = units(matrix(part.column(2)))
                sims = x @ shared.value.T
                best = np.argpartition(-sims, overlap - 1, axis=1)[:, :overlap] if overlap < sims.shape[1] else np.tile(np.arange(sims.shape[1]), (len(x), 1))
                home = best == sims.argmax(1)[:, None]
                twice = np.repeat(np.arange(len(x)), overlap)
                unit = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size * overlap + 1, x.shape[1], dtype=np.int32)), pa.array(x[twice].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(best.ravel().astype(np.int64)), part.column(0).take(pa.array(twice)), part.column(1).take(pa.array(twice)), pa.array(home.ravel()), unit], names=["cell", "node", "weight", "home", "v"])

    return nodes.select("node", "weight", "v").mapInArrow(run, "cell long, node long, weight long, home boolean, v array<double>")


def sliced(held: DataFrame, shard_rows: int) -> DataFrame:
    """``held`` with slice and slices: cells of more than ``shard_rows`` rows in slices of half as many."""
    sizes = held.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    cut = F.when(F.col("size") > shard_rows, F.ceil(F.col("size") / (shard_rows // 2))).otherwise(1).cast("int")
    rows = held.join(F.broadcast(sizes.select("cell", cut.alias("slices"))), "cell")  # one row a cell, a sixteenth of the sample at most
    return rows.withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))


def adjacency(held: DataFrame) -> DataFrame:
    """(node, near): each shard's graph built in one task, a node's lists of all its shards united."""
    rows = held.select(F.xxhash64("cell", "slice").alias("task"), "node", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_task(batches):
            task = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                nodes, v = batch.column(1).slice(a, b - a).to_numpy(), matrix(batch.column(2).slice(a, b - a))
                order = np.argsort(nodes)
                nodes, v = nodes[order], v[order]
                graph = build(v.astype(np.float32), int(task[a]) & 0xFFFFFFFF)
                sizes = (graph >= 0).sum(1)
                flat = graph.ravel()
                near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(nodes[flat[flat >= 0]]))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), near], names=["node", "near"])

    built = rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "node long, near array<long>")
    return built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def search(held: DataFrame, lists: DataFrame, threshold: float, beam: int) -> DataFrame:
    """(node, links, root): of every row and shard, the weight of its links to rows at home there, and its class among all links found there."""
    others = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda k: F.struct(F.least("slice", k).alias("lo"), F.greatest("slice", k).alias("hi")))
    rows = held.join(lists, "node").select("*", F.explode(others).alias("t"))
    rows = rows.select(F.xxhash64("cell", "t.lo", "t.hi").alias("task"), "node", "weight", "home", F.when(F.col("t.lo") == F.col("t.hi"), 0).when(F.col("slice") == F.col("t.lo"), 1).otherwise(2).alias("side"), "v", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_task(batches):
            task = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                nodes, links, root = _search_shard(batch.slice(a, b - a), threshold, beam)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(root)], names=["node", "links", "root"])

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "node long, links long, root long")


def _search_shard(batch: pa.RecordBatch, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes, weight = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    home, side = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy()
    x, near = matrix(batch.column(5)), batch.column(6)
    sizes = np.diff(near.offsets.to_numpy())
    flat = near.flatten().to_numpy()
    links = np.zeros(len(nodes), np.int64)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for graph_side, query_side in ((0, 0), (1, 2), (2, 1)):
            held, asked = np.flatnonzero(side == graph_side), np.flatnonzero(side == query_side)
            if not len(held) or not len(asked):
                continue
            order = held[np.argsort(nodes[held])]
            # neighbours as row numbers of this shard; those that lie elsewhere have none
            owner = np.repeat(np.arange(len(nodes)), sizes)
            at = np.minimum(np.searchsorted(nodes[order], flat), len(order) - 1)
            inside = (nodes[order][at] == flat) & (side[owner] == graph_side)
            local = np.full(len(nodes), -1)
            local[order] = np.arange(len(order))
            source, target = local[owner[inside]], at[inside]
            by_source = np.argsort(source, kind="stable")
            source, target = source[by_source], target[by_source]
            place = np.arange(len(source)) - np.searchsorted(source, source, "left")
            graph = np.full((len(order), int(place.max()) + 1 if len(place) else 1), -1, np.int64)
            graph[source, place] = target
            engine = Search(x[order], graph, threshold, beam)
            step = max(1, min(256, 4_000_000 // len(order)))
            for i in range(0, len(asked), step):
                some = asked[i : i + step]
                q, r = engine.run(x[some], local[some] if graph_side == query_side else np.full(len(some), -1))
                q, r = some[q], order[r]
                apart = q != r
                q, r = q[apart], r[apart]
                np.add.at(links, q, np.where(home[r], weight[r], 0))
                yield q, r

    root = _star(len(nodes), pairs())
    return nodes, links, nodes[root]


def audit(nodes: DataFrame, threshold: float, rows: int = AUDITED) -> DataFrame:
    """(node, truth): for a hash sample of at most ``rows`` nodes the weight of all their links, by comparison with every node."""
    n = nodes.count()
    share = min(1 << 20, 1 + (rows * 5 // 4 << 20) // max(1, n))
    h = F.xxhash64("node", F.lit(11))
    sample = nodes.where(F.pmod(h, F.lit(1 << 20)) < share).select("node", "v").orderBy(h, "node").limit(rows).toArrow().combine_chunks()
    ids = sample.column("node").to_numpy()
    vectors = units(matrix(sample.column("v").combine_chunks())) if len(ids) else np.zeros((0, 1))
    shared = nodes.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                hit = units(matrix(part.column(2))) @ vectors.T >= threshold
                hit &= part.column(0).to_numpy()[:, None] != ids
                total += part.column(1).to_numpy() @ hit.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "truth"])

    return nodes.select("node", "weight", "v").mapInArrow(run, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))


def find_links(nodes: DataFrame, threshold: float, recall: float, cell_rows: int, shard_rows: int, report: list | None = None) -> DataFrame:
    """(node, links, root) of nodes of one length, searched with growing overlap and beam until the audit is met."""
    n = nodes.count()
    h = F.xxhash64("node", F.lit(3))
    share = min(1 << 20, 1 + (SAMPLE * 5 // 4 << 20) // max(1, n))
    sample = nodes.where(F.pmod(h, F.lit(1 << 20)) < share).select("node", "v").orderBy(h, "node").limit(SAMPLE).toArrow()
    x = units(matrix(sample.column("v").combine_chunks()))
    k = max(1, min(-(-n // cell_rows), len(x) // 16))
    centres = fit_cells(x, k)
    truth = materialize(audit(nodes, threshold), "vector-audit")
    overlap, beam = min(3, k), BEAM
    while True:
        held = materialize(sliced(members(nodes, centres, overlap), shard_rows), "vector-members")
        lists = materialize(adjacency(held), "vector-lists")
        found = materialize(search(held, lists, threshold, beam), "vector-links")
        discard(nodes.sparkSession, held, lists)
        got = truth.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").agg(F.sum("truth").alias("all"), F.sum(F.least("truth", F.coalesce("links", F.lit(0)))).alias("found")).first()
        reached = 1.0 if not got["all"] else got["found"] / got["all"]
        if report is not None:
            report.append({"cells": k, "overlap": overlap, "beam": beam, "audited": got["all"] or 0, "recall": reached})
        if reached >= recall or (overlap == k and beam >= WIDEST):
            if reached < recall:
                warnings.warn(f"{reached:.4f} of the audited links were found, not {recall}", stacklevel=2)
            return found
        discard(nodes.sparkSession, found)
        overlap, beam = min(k, 2 * overlap), min(2 * beam, WIDEST)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int = CELL_ROWS, shard_rows: int = SHARD_ROWS, report: list | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``; ``report`` gets a line per audit."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = materialize(vectors.select(F.col(id_col).alias("vec_id"), F.when(sound, v).alias("v")), "vector-rows")
    nodes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    lengths = sorted(r[0] for r in nodes.select(F.size("v")).distinct().collect())
    found = None
    for length in lengths:
        part = find_links(nodes.where(F.size("v") == length), threshold, recall, cell_rows, shard_rows, report)
        found = part if found is None else found.unionByName(part)
    none = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found is not None:
        classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        counts = found.groupBy("node").agg(F.sum("links").alias("links"))
        linked = nodes.join(classes, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        names = linked.groupBy("component").agg(F.min("first").alias("component_id"))
        named = linked.join(names, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
        none = none.unionByName(rows.where("v is not null").join(named, "v").select("vec_id", "n_links", "component_id"))
    return none.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
