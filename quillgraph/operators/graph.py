"""Property-graph operators over node and edge tables.

Tables: phrase(id, name, entity_type, pagerank_score), passage(id, text),
mentioned_in(phrase_id, passage_id), related_to(src, dst, relation_type).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import discard, materialize


def link_mentions(pairs: DataFrame, phrases: DataFrame, passages: DataFrame) -> DataFrame:
    """(phrase_id, passage_id) whose both ends exist, once each."""
    p, q = phrases.select(F.col("id").alias("phrase_id")), passages.select(F.col("id").alias("passage_id"))
    return pairs.select("phrase_id", "passage_id").distinct().join(p, "phrase_id", "left_semi").join(q, "passage_id", "left_semi").select("phrase_id", "passage_id")


def relate_by_name(relations: DataFrame, phrases: DataFrame) -> DataFrame:
    """(src, dst, relation_type) for relations(source, target, relation_type, seq) between phrases of those names.

    All phrases of a name take part, self pairs go, and the last relation of an ordered pair wins.
    """
    key = lambda c: F.lower(F.trim(c))
    named = phrases.select("id", key("name").alias("k"))
    rows = relations.withColumn("sk", key("source")).withColumn("tk", key("target"))
    rows = rows.join(named.select(F.col("id").alias("src"), F.col("k").alias("sk")), "sk").join(named.select(F.col("id").alias("dst"), F.col("k").alias("tk")), "tk").where("src <> dst")
    return rows.groupBy("src", "dst").agg(F.max_by("relation_type", "seq").alias("relation_type"))


def match_signatures(new: DataFrame, known: DataFrame) -> DataFrame:
    """(id, known_id) for rows of the same type that share an alias signature; the first by signature place, then the last known row.

    Both sides: (id, entity_type, signatures array); ``known`` also seq.
    """
    a = new.select("id", "entity_type", F.posexplode("signatures").alias("pos", "sig")).where("sig <> ''")
    b = known.select(F.col("id").alias("known_id"), "entity_type", "seq", F.explode("signatures").alias("sig")).where("sig <> ''")
    b = b.groupBy("entity_type", "sig").agg(F.max_by("known_id", "seq").alias("known_id"))
    return a.join(b, ["entity_type", "sig"]).groupBy("id").agg(F.min_by("known_id", F.struct("pos", "sig")).alias("known_id"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20, restart: DataFrame | None = None, tolerance: float | None = None) -> DataFrame:
    """(id, score) by weighted power iteration over edges(src, dst, weight).

    The mass of nodes without out-edges goes to the restart vector, uniform or
    over ``restart(id)``.  Each round is one join and one aggregation, with the
    dangling mass as a one-row aggregate joined in, and is written to the shared
    folder; with ``tolerance`` it ends early once the change is under n * tolerance.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    flow = materialize(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "rank-flow")
    if restart is None:
        base = nodes.select("id").withColumn("v", F.lit(1.0))
    else:
        base = nodes.select("id").join(restart.select("id").distinct().withColumn("v", F.lit(1.0)), "id", "left").fillna(0.0, ["v"])
    total = base.agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    base = base.join(F.broadcast(total), F.lit(True)).withColumn("v", F.col("v") / F.col("s"))
    base = base.join(out.select(F.col("src").alias("id"), F.lit(True).alias("has_out")), "id", "left").select("id", "v", F.coalesce("has_out", F.lit(False)).alias("has_out"), (1.0 / F.col("n")).alias("score"))
    base = materialize(base, "rank-base")
    current = base.select("id", "v", "has_out", "score")
    for _ in range(iterations):
        loose = current.agg(F.coalesce(F.sum(F.when(~F.col("has_out"), F.col("score"))), F.lit(0.0)).alias("loose"))
        inflow = flow.join(current.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("score")).alias("inflow"))
        nxt = current.select("id", "v", "has_out", F.col("score").alias("before")).join(inflow, "id", "left").join(F.broadcast(loose), F.lit(True))
        score = damping * (F.coalesce("inflow", F.lit(0.0)) + F.col("loose") * F.col("v")) + (1 - damping) * F.col("v")
        nxt = materialize(nxt.select("id", "v", "has_out", "before", score.alias("score")), "rank")
        if current is not base and "before" in current.columns:
            discard(nodes.sparkSession, current)
        current = nxt
        if tolerance is not None:
            change, n = current.agg(F.sum(F.abs(F.col("score") - F.col("before"))), F.count(F.lit(1))).first()
            if change < n * tolerance:
                break
    return current.select("id", "score")


def rule_entry_points(phrases: DataFrame, terms: Sequence[str], limit: int = 40) -> DataFrame:
    """(id, n): phrases whose name or any alias holds a term, by the number of terms; ``phrases(id, name[, aliases])``."""
    names = F.array(F.lower(F.coalesce("name", F.lit(""))))
    if "aliases" in phrases.columns:
        names = F.concat(names, F.coalesce(F.transform("aliases", lambda a: F.lower(a)), F.array().cast("array<string>")))
    listed = F.array(*(F.lit(t.lower()) for t in terms))
    hits = F.size(F.filter(listed, lambda t: F.exists(names, lambda n: F.contains(n, t))))
    return phrases.select("id", hits.cast("long").alias("n")).where("n > 0").orderBy(F.desc("n"), "id").limit(limit)


#: Entities up to which the keys of a mention scan are broadcast.
MAX_BROADCAST_KEYS = 100_000
#: Keys up to which each is looked for in every text, instead of listing a text's character groups.
FEW_KEYS = 256
#: Initials up to which they are looked for one by one, instead of listing a text's tokens.
FEW_WORDS = 4
#: Names up to which they may go into the plan itself.
FEW_NAMES = 1024


def mention_scan(passages: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, passage_id, score): passages(passage_id, text) that mention an entity(name), with the mention score.

    Whatever rule fires, the text's compact signature holds the name's, or the
    text has the name's initials as a token.  So names meet passages by an equal
    join on the first characters of the signature, three at most, against the
    distinct character groups of the passage, and by initials against its tokens;
    only these pairs are scored.  A few keys are looked for in the texts directly.
    """
    sig = X.alias_signature(F.col("name"))
    names = entities.select("name").where(F.trim("name") != "").distinct()
    keys = F.array_distinct(F.filter(F.array(F.concat(F.lit("s:"), F.left(sig, F.lit(3))), F.concat(F.lit("t:"), X.abbreviation(F.col("name")))), lambda k: F.length(k) > 2))
    keyed = materialize(names.select("name", F.explode(keys).alias("key")), "mention-keys")
    plain, tokens = X.alias_signature(F.col("text")), X.token_signatures(F.col("text"))
    asked = keyed.groupBy("key").agg(F.collect_set("name").alias("names")).limit(FEW_KEYS + 1).collect() if keyed.limit(FEW_NAMES + 1).count() <= FEW_NAMES else []
    if 0 < len(asked) <= FEW_KEYS:  # each key is looked for in the text, and its names are scored in the same row: no text is shuffled
        of = lambda mark: [r.key[2:] for r in asked if r.key.startswith(mark)]
        words = of("t:")

        def scores(given):
            found = F.transform(F.filter(F.array(*map(F.lit, of("s:"))).cast("array<string>"), lambda k: F.contains(given["plain"], k)), lambda k: F.concat(F.lit("s:"), k))
            if len(words) > FEW_WORDS:
                found = F.concat(found, F.transform(F.array_intersect(tokens, F.array(*map(F.lit, words))), lambda k: F.concat(F.lit("t:"), k)))
            elif words:  # names of so few initials are scored in any case: that looks for them more cheaply than listing the tokens
                found = F.concat(found, F.array(*(F.lit(f"t:{w}") for w in words)))
            names = F.array_distinct(F.flatten(F.transform(found, lambda k: F.element_at(names_of, k))))
            return X.let(names, lambda n: F.when(F.size(n) > 0, X.mention_scores(text, n, given)))

        names_of = F.create_map(*(x for r in asked for x in (F.lit(r.key), F.array(*map(F.lit, sorted(r.names))))))
        text = X.text_or_empty(F.col("text"))
        return passages.select("passage_id", F.explode(X.let(X.mention_given(text), scores)).alias("s")).select(F.col("s.form").alias("name"), "passage_id", F.col("s.score").alias("score")).where("score > 0")
    # all character groups of the text are listed
    sizes = sorted(r.n for r in keyed.where(F.col("key").startswith("s:")).select((F.length("key") - 2).alias("n")).distinct().collect())  # at most 3 values
    groups = lambda n: F.array_distinct(F.regexp_extract_all(plain, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)))
    found = [F.transform(tokens, lambda t: F.concat(F.lit("t:"), t)), *(F.transform(groups(n), lambda g: F.concat(F.lit("s:"), g)) for n in sizes)]
    rows = passages.select("passage_id", F.explode(F.array_distinct(F.concat(*found))).alias("key"))
    few = keyed.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS
    pairs = rows.join(F.broadcast(keyed) if few else keyed, "key").select("passage_id", "name").distinct()
    # scoring is heavy per row and the rows are small, so both sides keep their number of partitions
    parts = int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = pairs.repartition(parts, "passage_id").groupBy("passage_id").agg(F.collect_list("name").alias("names"))
    met = passages.repartition(parts, "passage_id").join(listed, "passage_id")
    scored = met.select("passage_id", F.explode(X.mention_scores(X.text_or_empty(F.col("text")), F.col("names"))).alias("s")).select(F.col("s.form").alias("name"), "passage_id", F.col("s.score").alias("score"))
    return scored.where("score > 0")


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, edge): each edge seen from both ends; edge is its number (src, dst)."""
    e = F.struct("src", "dst")
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), e.alias("edge"), "relation_type").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), e.alias("edge"), "relation_type"))


def trails(seeds: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """(seed, node, path, length): undirected trails of 1..hops edges, no edge twice. ``seeds(id)``."""
    step = both_ways(edges)
    layer = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.array().cast("array<struct<src:bigint,dst:bigint>>").alias("path"))
    layers = []
    for n in range(1, hops + 1):
        grown = layer.join(step, layer["node"] == step["a"]).where(~F.array_contains("path", F.col("edge")))
        layer = grown.select("seed", F.col("b").alias("node"), F.concat("path", F.array("edge")).alias("path"))
        layers.append(layer.withColumn("length", F.lit(n)))
    return reduce(DataFrame.unionByName, layers)


#: Half-edges of a node that one row lists, and edges whose ends one task makes distinct.
LISTED, EDGES_A_TASK = 1024, 20_000


def trail_triples(seeds: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """Distinct (connected, src, relation_type, dst, length) of all edges on trails.

    Trails are rows of edge numbers; those that end at one node by the same
    edges are one, whatever seed they began at.  The last step makes no trails: a
    trail's edges get the ends of all its last steps as lists, of ``LISTED`` at
    most, and only lists are shuffled, once, by edge.  There they are unfolded,
    made distinct and meet their edge.
    """
    spark = edges.sparkSession
    numbered = materialize(edges.select("src", "dst", "relation_type").withColumn("edge", F.monotonically_increasing_id()), "trail-edges")
    step = numbered.select(F.col("src").alias("a"), F.col("dst").alias("b"), "edge").unionByName(numbered.select(F.col("dst").alias("a"), F.col("src").alias("b"), "edge"))
    place = F.row_number().over(Window.partitionBy("a").orderBy("edge"))
    near = step.withColumn("part", F.floor((place - 1) / LISTED)).groupBy("a", "part").agg(F.collect_list(F.struct("b", "edge")).alias("near")).drop("part")
    layer, used, found = seeds.select(F.col("id").alias("node")).distinct(), [], []
    for n in range(1, hops + 1):
        grown = layer.join(step, layer["node"] == step["a"])
        for e in used:
            grown = grown.where(F.col(e) != F.col("edge"))
        last = grown.select(F.col("b").alias("connected"), "edge")
        if n < hops:
            kept = materialize(grown.select(F.col("b").alias("node"), *used, F.col("edge").alias(f"e{n}")).distinct(), "trail-layer")
            ends = kept.select(F.explode(F.array(*used, f"e{n}")).alias("edge"), F.array("node").alias("ends"))
        else:
            kept, open_ends = None, F.filter("near", lambda x: ~x["edge"].isin(*(F.col(e) for e in used))) if used else F.col("near")
            ends = last.distinct().select("edge", F.array("connected").alias("ends"))
            if used:
                listed = layer.join(near, layer["node"] == near["a"]).select(*used, F.transform(open_ends, lambda x: x["b"]).alias("ends")).where(F.size("ends") > 0)
                ends = ends.unionByName(listed.select(F.explode(F.array(*used)).alias("edge"), "ends"))
        found.append(ends.withColumn("length", F.lit(n)))
        layer, used = kept, [*used, f"e{n}"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-numbered.count() // EDGES_A_TASK))
    by_edge = reduce(DataFrame.unionByName, found).repartition(parts, "edge")
    rows = by_edge.select("edge", "length", F.explode("ends").alias("connected")).distinct()
    return rows.join(numbered.hint("shuffle_hash"), "edge").select("connected", "src", "relation_type", "dst", "length")


def reachable(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hops): nodes within ``hops`` undirected steps with their distance; frontiers only, no paths."""
    pairs = materialize(edges.select("src", "dst"), "reach-edges")
    step = materialize(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").distinct(), "reach-steps")
    discard(edges.sparkSession, pairs)
    seen = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("hops")).distinct()
    layer = seen
    for n in range(1, hops + 1):
        nxt = layer.join(step, layer["node"] == step["a"]).select("seed", F.col("b").alias("node"), F.lit(n).alias("hops"))
        # a pair met before keeps its smaller distance; known and new pairs are one aggregation
        met = seen.unionByName(nxt).groupBy("seed", "node").agg(F.min("hops").alias("hops"))
        seen = materialize(met, "reach-seen") if n < hops else met
        layer = seen.where(F.col("hops") == n).select("seed", "node")
    return seen.where("hops > 0")


def co_mentioned(seeds: DataFrame, mentions: DataFrame, phrases: DataFrame, limit: int = 32) -> DataFrame:
    """(neighbour, passage_id, pagerank_score): phrases that share a passage with a seed and are no seed, best first."""
    held = mentions.join(seeds.select(F.col("id").alias("phrase_id")), "phrase_id", "left_semi").select("passage_id").distinct()
    near = mentions.join(held, "passage_id").join(seeds.select(F.col("id").alias("phrase_id")), "phrase_id", "left_anti").distinct()
    rows = near.join(phrases.select(F.col("id").alias("phrase_id"), "pagerank_score"), "phrase_id").select(F.col("phrase_id").alias("neighbour"), "passage_id", "pagerank_score")
    return rows.orderBy(F.desc("pagerank_score"), "neighbour", "passage_id").limit(limit)


def collect_passages(phrases: DataFrame, mentions: DataFrame, limit: int = 12) -> DataFrame:
    """Passages of the phrases by their strongest phrase; the limit comes before any later filter."""
    best = mentions.join(phrases.select(F.col("id").alias("phrase_id"), "pagerank_score"), "phrase_id").groupBy("passage_id").agg(F.max("pagerank_score").alias("phrase_pagerank"))
    return best.orderBy(F.desc("phrase_pagerank"), "passage_id").limit(limit)


def seed_passages(mentions: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """Phrases of passages(id, hits, background) with 2 hits, or 1 and a background hit; best passage per phrase."""
    good = hits.where("hits >= 2 or (hits >= 1 and background >= 1)")
    best = mentions.join(good.select(F.col("id").alias("passage_id"), "hits"), "passage_id").groupBy("phrase_id").agg(F.max("hits").alias("hits"))
    return best.orderBy(F.desc("hits"), "phrase_id").limit(limit)


def top_passages(scores: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best passages of each entity by score, then id."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("score"), "passage_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def skeleton_scores(chunks: DataFrame, density_weight: float = 0.35) -> DataFrame:
    """chunks(id, pagerank, n_entities, candidate) with a rank score from centrality and entity density."""
    top = chunks.agg(F.max("pagerank").alias("mp"), F.max("n_entities").alias("me"))
    rows = chunks.join(F.broadcast(top), F.lit(True))
    safe = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, 1).otherwise(F.col(c))
    density = F.greatest(F.col("n_entities") / safe("me"), F.when(F.col("candidate"), 1.0).otherwise(0.0))
    return rows.withColumn("skeleton_score", (1 - density_weight) * F.col("pagerank") / safe("mp") + density_weight * density).drop("mp", "me")


def skeleton_size(n: Column, beta: float = 0.25) -> Column:
    """Chunks to keep of ``n``: a share, 1 at least; up to 10 chunks at most half, 2 at least."""
    share = F.greatest(F.lit(1), F.floor(n * beta))
    return F.when(n <= 10, F.least(share, F.greatest(F.lit(2), F.floor((n + 1) / 2)))).otherwise(share)


def select_skeleton(chunks: DataFrame, by: str, beta: float = 0.25) -> DataFrame:
    """chunks(id, ``by``, skeleton_score) with ``skeletal``, per value of ``by``."""
    n = chunks.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(by).orderBy(F.desc("skeleton_score"), "id")
    rows = chunks.withColumn("__r", F.row_number().over(w)).join(n, by)
    return rows.withColumn("skeletal", F.col("__r") <= skeleton_size(F.col("__n"), beta)).drop("__r", "__n")
