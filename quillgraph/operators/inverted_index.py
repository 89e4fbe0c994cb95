"""A stored inverted index with positions: BM25 by block-max pruning, and must, should and phrase clauses (IDX1, R3, R4).

The index is a Parquet table of posting blocks, one row for a term and a range of
``RANGE`` neighbouring documents: the documents with their term frequencies,
lengths and positions, and the block's size; its largest weight follows from them.  A range lies in one input partition, so blocks are made where the
texts are read and no token is shuffled, only blocks.  Files are sorted by term
and delta coded by the format, so a search for a few terms skips row groups.

A search deals the blocks of its terms once, by groups of ranges, and scores each
group in a task that gives back ``k`` documents per query.  There the sum of a
query's largest weights in a range bounds the score of every document in it; the
best ranges are scored, and of the others those whose bound reaches the k-th best
score found.  What is left out can't be among the best ``k``: results are those
of an exhaustive search.

Edge cases: null, empty and wordless texts count as documents without terms;
repeated ids are documents of their own; ties go to the smaller id; a term that
no document has is ignored, unless a clause that must match holds it; an empty
table gives an index without documents and empty results.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..storage import application_dir, materialize

RANGE = 128
K1, B = 1.2, 0.75
#: Latin tokens, or one CJK character each, so that a CJK word is a phrase of its characters.
TOKEN = re.compile("[A-Za-z0-9][A-Za-z0-9_-]+|[㐀-䶿一-鿿豈-﫿]")
CJK = re.compile("[㐀-䶿一-鿿豈-﫿]{2,}")
#: Longest run of CJK characters that is a term of its own.
LONGEST = 8
#: Ranges of each query and group that are scored first, to get a score to prune by.
FIRST = 2
#: Documents of a group of ranges, which one task scores for all queries.
GROUP = 16_384
#: Terms up to which the set of asked terms is broadcast.
MAX_BROADCAST_TERMS = 100_000
#: The term under which a range lists all its documents: frequency 1 for those that aren't blank, and lengths.
EVERY = ""


@dataclass
class TextIndex:
    """``blocks(term, range, n_docs, max_weight, ids, tfs, lens, positions)`` and the corpus figures."""

    blocks: DataFrame
    n: int
    filled: int
    avg_len: float

    @property
    def terms(self) -> DataFrame:
        return self.blocks.where(F.col("term") != EVERY)


def cjk_grams(text: str) -> Counter[str]:
    """Terms of 2 to ``LONGEST`` CJK characters, as K1 has them; they have no positions, phrases find them by their characters."""
    runs = (m[0] for m in CJK.finditer(text))
    return Counter(g for run in runs for n in range(2, min(LONGEST, len(run)) + 1) for i in range(len(run) - n + 1) if len(set(g := run[i : i + n])) > 1)


def clause_tokens(anchor: Column) -> Column:
    """An anchor's text as the tokens of a clause."""
    return F.transform(F.regexp_extract_all(anchor, F.lit(TOKEN.pattern), F.lit(0)), lambda t: F.lower(t))


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Posting blocks without weights, made where the texts are read."""
    id_type = docs.schema[id_col].dataType
    kind = to_arrow_type(id_type)
    schema = docs.select(F.col(id_col).alias("i")).schema
    names = ["term", "range", "ids", "tfs", "lens", "positions"]

    kinds = [pa.string(), pa.int64(), pa.list_(kind), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))]

    def batch(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def batches_of(number: int, rows: list[tuple[object, str | None]]) -> Iterator[pa.RecordBatch]:
        """A range's blocks: the one of all documents, those of its tokens, those of its CJK terms."""
        found = [TOKEN.findall(t or "") for _, t in rows]
        ids, lens = [i for i, _ in rows], np.array([len(f) for f in found], np.int32)
        yield batch([[EVERY], [number], [ids], [[int(bool((t or "").strip())) for _, t in rows]], [lens], [[[] for _ in rows]]])
        if lens.any():
            # tokens hold no blank, and as they are ASCII or CJK their small letters are as many
            listed = pa.array(" ".join(itertools.chain.from_iterable(found)).lower().split(" ")).dictionary_encode()
            order = pc.sort_indices(listed.dictionary)
            place = np.empty(len(order), np.int64)
            place[order.to_numpy()] = np.arange(len(order))
            code = place[listed.indices.to_numpy()]
            by_term = np.argsort(code, kind="stable")  # documents and positions stay in order
            code, at = code[by_term], np.repeat(np.arange(len(rows)), lens)[by_term]
            places = (np.arange(len(by_term)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)[by_term]
            entry = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (at[1:] != at[:-1])])  # where a term's next document begins
            held, term = at[entry], code[entry]
            block = np.r_[np.flatnonzero(np.r_[True, term[1:] != term[:-1]]), len(term)].astype(np.int32)
            of = lambda values: pa.ListArray.from_arrays(pa.array(block), values)
            inner = pa.ListArray.from_arrays(pa.array(np.r_[entry, len(code)].astype(np.int32)), pa.array(places))
            tfs = np.diff(np.r_[entry, len(code)]).astype(np.int32)
            columns = [listed.dictionary.take(order), pa.array(np.full(len(order), number, np.int64)), of(pa.array(ids, kind).take(pa.array(held))), of(pa.array(tfs)), of(pa.array(lens[held])), of(inner)]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=names)
        grams: dict[str, list[tuple[int, int]]] = {}
        for at, (_, text) in enumerate(rows):
            for term, tf in cjk_grams(text or "").items():
                grams.setdefault(term, []).append((at, tf))
        if grams:
            terms = sorted(grams)
            some = [grams[t] for t in terms]
            yield batch([terms, [number] * len(terms), [[ids[a] for a, _ in h] for h in some], [[tf for _, tf in h] for h in some], [[lens[a] for a, _ in h] for h in some], [[[] for _ in h] for h in some]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        for b in batches:
            for at in range(0, b.num_rows, RANGE):
                part = b.slice(at, RANGE)
                held += zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                if len(held) >= RANGE:
                    yield from batches_of(number, held[:RANGE])
                    number, held = number + 1, held[RANGE:]
        if held:
            yield from batches_of(number, held)

    id_sql = schema["i"].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"term string, range long, ids array<{id_sql}>, tfs array<int>, lens array<int>, positions array<array<int>>")


def norm(tf: Column, length: Column, avg_len: float) -> Column:
    """A term frequency's share of a BM25 weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(max(avg_len, 1e-9))))


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> TextIndex:
    """Index ``docs`` into the new folder ``path`` and open it."""
    spark = docs.sparkSession
    # a range's blocks lie in one partition already, and each file is sorted by term: dealing them anew would only move the positions of all texts
    rows = _blocks(docs, id_col, text_col).select("term", "range", F.size("ids").alias("n_docs"), "ids", "tfs", "lens", "positions")
    rows.sortWithinPartitions("term", "range").write.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").parquet(f"{path}/blocks")
    every = spark.read.parquet(f"{path}/blocks").where(F.col("term") == EVERY)
    figures = every.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), F.sum(F.aggregate("tfs", F.lit(0), lambda s, x: s + x)).alias("filled"), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total")).first()
    avg_len = (figures["total"] or 0) / max(1, figures["n"])
    spark.createDataFrame([(figures["n"], figures["filled"] or 0, avg_len)], "n long, filled long, avg_len double").coalesce(1).write.parquet(f"{path}/figures")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> TextIndex:
    figures = spark.read.parquet(f"{path}/figures").first()
    largest = F.array_max(F.zip_with("tfs", "lens", lambda tf, n: norm(tf, n, figures["avg_len"])))
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("max_weight", F.when(F.col("term") != EVERY, largest).otherwise(0.0))
    return TextIndex(blocks, figures["n"], figures["filled"], figures["avg_len"])


_opened: dict[tuple, TextIndex] = {}


def shared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> TextIndex:
    """The application's index of a stored table, built by its first user.

    It is known by the table's files, so a table written anew has an index of its own.
    """
    spark = docs.sparkSession
    files = tuple(sorted(docs.inputFiles()))
    key = (spark.sparkContext.applicationId, id_col, text_col, files)
    if not files:
        raise ValueError("only a stored table has a shared index; give build() a folder")
    if key not in _opened:
        _opened[key] = build(docs, f"{application_dir(spark)}/text-index-{len(_opened)}", id_col, text_col)
    return _opened[key]


def profile(index: TextIndex) -> DataFrame:
    """A1, A2: (term, df, idf) of the terms."""
    df = index.terms.where(F.length("term") > 1).groupBy("term").agg(F.sum("n_docs").alias("df"))
    return df.select("term", "df", (F.ln(F.lit(1.0 + max(1, index.filled)) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def postings(index: TextIndex, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf): a row for every term (K1) of every document, or for those of ``terms`` that it has."""
    rows = index.terms.where(F.length("term") > 1)
    rows = (rows if terms is None else rows.join(terms, "term", "left_semi")).select("term", F.explode(F.arrays_zip("ids", "tfs")).alias("p"))
    return rows.select(F.col("p.ids").alias("doc_id"), "term", F.col("p.tfs").alias("tf"))


def _asked(index: TextIndex, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query terms with their idf, written, and the blocks of these terms."""
    wanted = queries.select("term").distinct()
    few = wanted.limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS
    blocks = index.terms.join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
    df = blocks.groupBy("term").agg(F.sum("n_docs").alias("df"))
    idf = F.ln(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return materialize(queries.join(df, "term").withColumn("idf", idf), "asked-terms"), blocks


@dataclass
class Pruned:
    """A search's results and, per query, how many ranges hold one of its terms and how many were scored."""

    results: DataFrame
    ranges: DataFrame


def _best_of_group(asked: pa.Table, blocks: pa.Table, k: int, avg_len: float, schema: pa.Schema) -> pa.Table:
    """Of one group of ranges: each query's best ``k`` documents with their scores; a query's first row has how many ranges hold one of its terms and how many were scored.

    Rows of ``asked`` without a term have an id of several documents, which may lie in other groups: such an id is scored whole and given back whatever its score.
    """
    if not asked.num_rows or not blocks.num_rows:
        return schema.empty_table()
    blocks = blocks.combine_chunks()
    several = asked.filter(pc.is_null(asked["term"]))["id"]
    listed = {c: blocks[c].combine_chunks() for c in ("ids", "tfs", "lens")}
    terms, ids = blocks["term"].combine_chunks().dictionary_encode(), listed["ids"].flatten().dictionary_encode(null_encoding="encode")
    # documents are numbered in the order of their ids, so that equal scores are ordered by number
    ordered = pc.array_sort_indices(ids.dictionary, null_placement="at_start")
    number = np.empty(len(ordered), np.int64)
    number[ordered.to_numpy()] = np.arange(len(ordered))
    shared_id = np.zeros(len(ordered), bool)
    shared_id[number] = pc.is_in(ids.dictionary, value_set=several.combine_chunks()).to_numpy(zero_copy_only=False)
    # blocks and their postings by term
    code, size = terms.indices.to_numpy(), listed["ids"].value_lengths().to_numpy().astype(np.int64)
    by_term = np.argsort(code, kind="stable")
    starts = np.cumsum(size) - size
    ends = np.cumsum(size[by_term])
    at = np.arange(int(size.sum())) + np.repeat(starts[by_term] - ends + size[by_term], size[by_term])
    doc = number[ids.indices.to_numpy()[at]]
    tf, length = (listed[c].flatten().to_numpy()[at].astype(np.float64) for c in ("tfs", "lens"))
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(avg_len, 1e-9)))
    ranges, block_range = np.unique(blocks["range"].to_numpy()[by_term], return_inverse=True)
    always = np.zeros(len(ranges), bool)
    always[np.repeat(block_range, size[by_term])[shared_id[doc]]] = True
    of_range, largest = np.repeat(block_range, size[by_term]), np.maximum.reduceat(weight, ends - size[by_term])
    first_block = np.searchsorted(code[by_term], np.arange(len(terms.dictionary) + 1))
    first_posting = np.r_[ends - size[by_term], ends[-1]][first_block]
    # queries one by one
    held = pc.index_in(asked["term"], terms.dictionary).combine_chunks()
    asked = asked.append_column("held", held).filter(pc.is_valid(held)).combine_chunks()
    if not asked.num_rows:
        return schema.empty_table()
    queries = asked["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    by_query = np.argsort(queries.indices.to_numpy(), kind="stable")
    cuts = np.flatnonzero(np.diff(queries.indices.to_numpy()[by_query])) + 1
    all_held, all_idf = asked["held"].to_numpy(), asked["idf"].to_numpy()
    query_at, doc_at, score_at, counts = [], [], [], []
    for rows in np.split(by_query, cuts):
        some = [(h, idf) for h, idf in zip(all_held[rows], all_idf[rows], strict=True)]
        bound = np.zeros(len(ranges))
        for h, idf in some:
            here = slice(first_block[h], first_block[h + 1])
            bound += np.bincount(block_range[here], idf * largest[here], len(ranges))
        posting = [slice(first_posting[h], first_posting[h + 1]) for h, _ in some]
        places = np.concatenate([doc[p] for p in posting])
        weights = np.concatenate([idf * weight[p] for p, (_, idf) in zip(posting, some, strict=True)])
        in_range = np.concatenate([of_range[p] for p in posting])
        scored = bound > 0
        if (n_ranges := int(scored.sum())) > FIRST:
            early = np.zeros(len(ranges), bool)
            early[np.lexsort((ranges, -bound))[:FIRST]] = True
            of = early[in_range]
            found = np.bincount(places[of], weights[of])
            found = found[found > 0]
            if len(found) >= k:  # a bound may miss a rounded score by the rounding
                scored &= early | always | (bound >= np.partition(found, len(found) - k)[len(found) - k] - 1e-6)
                of = scored[in_range]
                places, weights = places[of], weights[of]
        score = np.bincount(places, weights)
        best = np.flatnonzero(score)
        own = best[~shared_id[best]]
        best = np.r_[own[np.lexsort((own, -np.round(score[own], 9)))[:k]], best[shared_id[best]]]
        query_at.append(np.full(len(best), queries.indices[int(rows[0])].as_py()))
        doc_at.append(best)
        score_at.append(score[best])
        counts.append(np.zeros((len(best), 2), np.int64))
        counts[-1][0] = n_ranges, int(scored.sum())
    counted = np.concatenate(counts)
    columns = [queries.dictionary.take(pa.array(np.concatenate(query_at))), ids.dictionary.take(ordered).take(pa.array(np.concatenate(doc_at))), pa.array(np.concatenate(score_at)), pa.array(counted[:, 0]), pa.array(counted[:, 1])]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def bm25(index: TextIndex, queries: DataFrame, k: int = 10) -> Pruned:
    """Results (query_id, chunk_id, score, rank): the best ``k`` documents of each query; ``queries(query_id, term)`` has distinct terms.

    Blocks are shuffled once and the queries once for each group of ranges; a
    group gives back ``k`` rows per query, so no pair of a query and a document
    or range is.  Memory is bounded by a group's blocks and the queries.
    """
    # every step reads the queries, which often come from a search of their own
    asked, blocks = _asked(index, materialize(queries.select("query_id", "term"), "queries"))
    n = max(1, -(-index.n // GROUP), min(queries.sparkSession.sparkContext.defaultParallelism, -(-index.n // RANGE)))
    group = F.pmod(F.xxhash64("range"), F.lit(n)).cast("int").alias("group")
    ids = index.blocks.where(F.col("term") == EVERY).select(F.explode("ids").alias("id"))
    several = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    q = asked.select("query_id", "term", "idf").unionByName(several, allowMissingColumns=True).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    of = blocks.select(group, "term", "range", "ids", "tfs", "lens")
    made = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("chunk_id", of.schema["ids"].dataType.elementType), StructField("score", DoubleType()), StructField("n_ranges", LongType()), StructField("n_scored", LongType())])
    schema, avg_len = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in made]), index.avg_len

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best_of_group(left, right, k, avg_len, schema)

    found = q.groupBy("group").cogroup(of.groupBy("group")).applyInArrow(run, made)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    # an id of two documents may lie in two groups
    results = found.groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 9).alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranges = found.where("n_ranges > 0").groupBy("query_id").agg(F.sum("n_ranges").alias("n_ranges"), F.sum("n_scored").alias("n_scored"))
    return Pruned(results.select("query_id", "chunk_id", "score", "rank"), ranges)


def clause_search(index: TextIndex, clauses: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, n_clauses, rank) for ``clauses(query_id, clause, must, tokens)``.

    A clause of one token matches where the token stands, one of several where
    they stand side by side in this order.  A document needs every clause with
    ``must``, and one clause at least.  A clause's weight is the sum of its
    tokens' idf times the norm of its frequency.
    """
    tokens = clauses.select("query_id", "clause", "must", F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("slot", "token"))
    tokens = materialize(tokens.select("query_id", "clause", "must", "n_tokens", "slot", F.lower("token").alias("term")), "clause-tokens")
    asked, blocks = _asked(index, tokens)
    rows = asked.join(blocks.select("term", "range", "ids", "tfs", "lens", "positions"), "term")
    # where a clause of several tokens is asked, each token's places as places of the clause's first token
    starts = F.transform("p.positions", lambda p: p - F.col("slot"))
    rows = rows.select("query_id", "clause", "must", "n_tokens", "slot", "idf", F.explode(F.arrays_zip("ids", "tfs", "lens", "positions")).alias("p"))
    rows = rows.select("query_id", "clause", "must", "n_tokens", "idf", F.col("p.ids").alias("chunk_id"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"), F.when(F.col("n_tokens") > 1, starts).alias("starts"))
    whole = F.when(F.first("n_tokens") == 1, F.max("tf")).otherwise(F.size(F.expr("reduce(collect_list(starts), first(starts), (a, b) -> array_intersect(a, b))")))
    matched = rows.groupBy("query_id", "clause", "must", "n_tokens", "chunk_id").agg(F.count(F.lit(1)).alias("present"), F.sum("idf").alias("idf"), F.max("len").alias("len"), whole.alias("tf"))
    matched = matched.where((F.col("present") == F.col("n_tokens")) & (F.col("tf") > 0))
    needed = tokens.groupBy("query_id").agg(F.count_distinct(F.when(F.col("must"), F.col("clause"))).alias("n_must"))
    docs = matched.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("idf") * norm(F.col("tf"), F.col("len"), index.avg_len)), 9).alias("score"), F.count(F.lit(1)).alias("n_clauses"), F.count_if("must").alias("n_met"))
    docs = docs.join(needed, "query_id").where(F.col("n_met") == F.col("n_must"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return docs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "n_clauses", "rank")
