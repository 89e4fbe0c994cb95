"""The best paths against an enumeration of all simple paths."""

import random
from collections import Counter

import pytest

from quillgraph.operators import paths as P


def graph(seed, nodes=14, edges=40):
    rng = random.Random(seed)
    pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]
    pairs += [(0, n) for n in range(1, nodes)]  # a hub
    return pairs, {n: rng.randrange(4) for n in range(nodes - 1)}


def enumerated(seeds, pairs, scores, hops):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found = []

    def walk(path, score):
        if len(path) > 1:
            found.append((path[0], path[-1], path, score))
        if len(path) <= hops:
            for n in near.get(path[-1], ()):
                if n not in path:
                    walk((*path, n), score + scores.get(n, 0))

    for s in set(seeds):
        walk((s,), 0)
    return found


@pytest.mark.parametrize("seed,k,hops", [(1, 1, 3), (2, 2, 3), (3, 8, 3), (4, 3, 2), (5, 2, 1)])
def test_best_paths_equal_the_enumeration(spark, seed, k, hops):
    pairs, scores = graph(seed)
    seeds = [3, 5, 5, 99]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    weights = spark.createDataFrame(list(scores.items()), "id long, score long")
    got = P.best_paths(spark.createDataFrame([(s,) for s in seeds], "id long"), edges, weights, hops, k).collect()
    groups = {}
    for s, n, path, score in enumerated(seeds, pairs, scores, hops):
        groups.setdefault((s, n, len(path) - 1), []).append((-score, path))
    want = {(*key, r + 1): (path, -neg) for key, rows in groups.items() for r, (neg, path) in enumerate(sorted(rows)[:k])}
    assert {(r.seed, r.node, r.length, r.rank): (tuple(r.path), r.score) for r in got} == want
    assert max(Counter((r.seed, r.node, r.length) for r in got).values()) <= k


@pytest.mark.parametrize("seed,k,hops", [(1, 1, 3), (2, 2, 3), (3, 8, 3), (4, 3, 2), (5, 2, 1)])
def test_best_paths_of_seeds_equal_the_enumeration(spark, seed, k, hops):
    pairs, scores = graph(seed)
    seeds = [0, 3, 5, 5, 99]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    weights = spark.createDataFrame(list(scores.items()), "id long, score long")
    got = P.best_paths_of_seeds(spark.createDataFrame([(s,) for s in seeds], "id long"), edges, weights, hops, k).collect()
    groups = {}
    for s, _, path, score in enumerated(seeds, pairs, scores, hops):
        groups.setdefault((s, len(path) - 1), []).append((-score, path))
    want = {(*key, r + 1): (path, -neg) for key, rows in groups.items() for r, (neg, path) in enumerate(sorted(rows)[:k])}
    assert {(r.seed, r.length, r["rank"]): (tuple(r.path), r.score) for r in got} == want and len(got) == len(want)


def test_best_paths_of_seeds_write_few_rows(spark, monkeypatch):
    """A complete graph has n^3 paths of three edges; none of a seed's are written but the best."""
    from quillgraph import storage

    written = []
    monkeypatch.setattr(P, "materialize", lambda df, tag: written.append((tag, (made := storage.materialize(df, tag)).count())) or made)
    edges = spark.range(30).selectExpr("id src").crossJoin(spark.range(30).selectExpr("id dst"))
    found = P.best_paths_of_seeds(spark.range(2), edges, spark.range(30).selectExpr("id", "id AS score"), 3, 4)
    assert found.count() == 2 * 3 * 4 and max(n for tag, n in written if tag != "path-steps") == 30


def test_context_lines(spark):
    edges = spark.createDataFrame([(1, 2, "causes"), (2, 1, "follows"), (3, 2, "treats"), (1, 1, "is")], "src long, dst long, relation_type string")
    names = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "id long, name string")
    weights = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0)], "id long, score double")
    found = P.best_paths(spark.createDataFrame([(1,)], "id long"), edges, weights, 2, 4)
    rows = {r["rank"]: (tuple(r["path"]), r["score"], r["lines"]) for r in P.path_context(found, edges, names).collect()}
    assert rows == {1: ((1, 2, 3), 6.0, "one -[causes]-> two\nthree -[treats]-> two"), 2: ((1, 2), 2.0, "one -[causes]-> two")}
    with pytest.raises(ValueError):
        P.best_paths(names, edges, weights, 4)


def test_no_edges_no_paths(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert P.best_paths(spark.createDataFrame([(1,)], "id long"), none, spark.createDataFrame([], "id long, score long")).count() == 0
