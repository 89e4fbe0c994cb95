"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows get global numbers 0..N-1 in a total order that depends only on their
content: by hash bucket, then hash, id, size and checksum.  Bucket sizes are
summed first (one aggregation), so numbering needs no window over more than one
bucket.  A Feistel network over Z_a x Z_b, with a*b the least such product
covering N, permutes the numbers; values of N or more walk the cycle until they
fall below N.  The permuted number p gives shard ``p mod shards`` and slot
``p div shards``: shard sizes differ by one row at most and slots have no gaps.
Given (N, key) anybody can compute a row's place, without moving data.

Law: ``rows``.  ``grown_shard`` is null, since the shard count takes part in
every row's place.

Edge cases: a null text has size 1 and checksum 0; null ids are numbered like
others; rows equal in id and text are interchangeable and get different
numbers; texts of any length only give their size and checksum; an empty table
gives an empty result; extra columns stay, clashing output names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A prime for the round function; its square fits a signed 64-bit number.
PRIME = (1 << 31) - 1
ROUNDS = 6
MADE = ["size", "text_crc32", "row_number", "shard", "slot"]


def round_constants(key: int) -> list[tuple[int, int]]:
    """Two numbers per round from the key, by a linear congruential sequence."""
    out, state = [], key % PRIME
    for _ in range(ROUNDS):
        pair = []
        for _ in range(2):
            state = (state * 48271 + 11) % PRIME
            pair.append(state + 1)
        out.append(tuple(pair))
    return out


def _mix(half, a: int, b: int, apply_mod):
    x = apply_mod(half + b, PRIME)
    return apply_mod(apply_mod(apply_mod(x * x, PRIME) * a, PRIME) + x, PRIME)


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def feistel(number: int, n: int, key: int) -> int:
    """The permuted number, in plain Python; walks the cycle."""
    a, b = sides(n)
    while True:
        left, right = divmod(number, b)
        for i, (p, q) in enumerate(round_constants(key)):
            if i % 2:
                right = (right + _mix(left, p, q, lambda x, m: x % m)) % b
            else:
                left = (left + _mix(right, p, q, lambda x, m: x % m)) % a
        number = left * b + right
        if number < n:
            return number


def _div(number: Column, by: int) -> Column:
    """Whole division of non-negative numbers, exact for all 64-bit values."""
    return F.call_function("div", number, F.lit(by).cast("long"))


def _step(number: Column, n: int, key: int) -> Column:
    """One pass of the network as an expression; structs keep each half computed once."""
    a, b = sides(n)
    halves = F.struct(_div(number, b).alias("l"), F.pmod(number, F.lit(b)).alias("r"))
    rounds = F.array(*(F.struct(F.lit(i % 2).alias("odd"), F.lit(p).cast("long").alias("p"), F.lit(q).cast("long").alias("q")) for i, (p, q) in enumerate(round_constants(key))))

    def one(acc: Column, k: Column) -> Column:
        half = F.when(k["odd"] == 1, acc["l"]).otherwise(acc["r"])
        x = F.pmod(half + k["q"], F.lit(PRIME))
        f = F.pmod(F.pmod(F.pmod(x * x, F.lit(PRIME)) * k["p"], F.lit(PRIME)) + x, F.lit(PRIME))
        return F.struct(
            F.when(k["odd"] == 1, acc["l"]).otherwise(F.pmod(acc["l"] + f, F.lit(a))).alias("l"),
            F.when(k["odd"] == 1, F.pmod(acc["r"] + f, F.lit(b))).otherwise(acc["r"]).alias("r"),
        )

    return F.aggregate(rounds, halves, one, lambda acc: acc["l"] * b + acc["r"])


def permuted(number: Column, n: int, key: int) -> Column:
    """Feistel permutation of 0..n-1 with cycle walking, as an expression.

    Fewer than a of the a*b points lie outside, so a walk of ``a`` steps always
    ends; for large n the chance of 64 steps in a row outside is below
    sqrt(n)**-64, and such a row would raise an error, never be misplaced.
    """
    a, _ = sides(n)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(min(a, 64))),
        _step(number, n, key),
        lambda acc, _: F.when(acc < n, acc).otherwise(_step(acc, n, key)),
        lambda acc: F.when(acc < n, acc).otherwise(F.raise_error(F.lit("the cycle walk did not end")).cast("long")),
    )


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 50_000, max_broadcast: int = 100_000) -> tuple[DataFrame, int]:
    """``docs`` with size, text_crc32 and row_number, and the number of rows.

    Two scans of ``docs``: the first counts buckets.  The offsets have one row
    per ``rows_per_bucket`` rows, under 0.1 % of the data, and are broadcast only
    if there are ``max_broadcast`` of them at most; beyond that the rows of a
    bucket meet its offset by a join on the bucket, which they lie by already.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text)
    keyed = docs.withColumn("size", size).withColumn("text_crc32", crc)
    keyed = keyed.withColumn("__h", F.xxhash64(id_col, "size", "text_crc32"))
    n = docs.count()
    buckets = max(64, -(-n // rows_per_bucket))
    keyed = keyed.withColumn("__bucket", F.pmod("__h", F.lit(buckets)))
    counts = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("rows"))
    offsets = counts.withColumn("__offset", F.sum("rows").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))).select("__bucket", F.coalesce("__offset", F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__bucket").orderBy("__h", id_col, "size", "text_crc32")
    ranked = keyed.withColumn("__rank", F.row_number().over(within))
    joined = ranked.join(F.broadcast(offsets) if buckets <= max_broadcast else offsets, "__bucket")
    return joined.withColumn("row_number", F.col("__offset") + F.col("__rank") - 1).drop("__offset", "__rank", "__bucket", "__h"), n


def shard(docs: DataFrame, shards: int = 8, key: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with size, text_crc32, row_number, shard and slot."""
    rows, n = numbered(docs, id_col, text_col)
    if n == 0:
        return rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    rows = rows.withColumn("__p", permuted(F.col("row_number"), n, key))
    return rows.withColumn("shard", F.pmod("__p", F.lit(shards)).cast("int")).withColumn("slot", _div(F.col("__p"), shards)).drop("__p")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within files."""
    sharded.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
