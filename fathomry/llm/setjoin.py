"""All similar pairs of set-valued records by binary minhash codes.

Each set gets a code of one-bit minhashes: bit ``i`` is one bit of the least value that hash function ``i`` takes on the
set, so a bit of two sets agrees with probability ``(1 + J) / 2``. The code is cut into segments; sets that agree in any
whole segment are candidates. One in ``segments`` segments would have to be free of errors for certain only with radius
+ 1 segments, far too short to tell sets apart; instead segment width follows the number of sets, and the number of
segments is calibrated so that a pair right at the threshold shares none with a probability of at most ``miss``. A
candidate must then lie within a Hamming radius on 128 bits of the code, calibrated by the same bound, and the original
sets decide.

A bucket above the limit of the streaming comparison is dealt again by further segments of the code. What is large even
then (really similar sets, for the most part, all pairs of which belong to the result) is compared in blocks: each block
of rows with each other one, as many tasks as there are pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators.fragment import skewed_join
from ..sources.shipping import map_arrow
from .buckets import LIMIT, bucket_pairs, distinct_pairs, overlap_at_least, within

#: Bits of the code that is compared; binary logarithm of the sets a bucket may hold by accident; width of the segments of a large bucket.
CODE_BITS, TOGETHER, AGAIN = 128, 8, 8


def calibrate(n: int, threshold: float, miss: float) -> tuple[int, int, int]:
    """Segment width, number of segments and Hamming radius on ``CODE_BITS`` bits, for ``n`` sets."""
    agree = (1 + threshold) / 2
    width = min(30, max(8, round(math.log2(max(n, 2))) - TOGETHER))
    segments = max(math.ceil(math.log(miss) / math.log1p(-(agree**width))), math.ceil(CODE_BITS / width))
    tail, radius = 1.0, -1
    while tail > miss:
        radius += 1
        tail -= math.comb(CODE_BITS, radius) * (1 - agree) ** radius * agree ** (CODE_BITS - radius)
    return width, segments, radius


def _codes(width: int, segments: int, seed: int):
    factors = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, size=width * segments, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                yield from part(b.slice(at, 4096))

    def part(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not b.num_rows:
            return
        lists = b.column("items")
        begin = lists.offsets.to_numpy().astype(np.int64)
        x = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        starts = begin[:-1] - begin[0]
        bits = np.empty((len(factors), b.num_rows), dtype=np.uint64)
        for i, f in enumerate(factors):
            # Elements are mixed 64-bit hashes, so a product with an odd factor orders them afresh.
            bits[i] = (np.minimum.reduceat(x * f, starts) >> np.uint64(20)) & np.uint64(1)
        code = [(bits[k : k + 64] * weights[:, None]).sum(axis=0, dtype=np.uint64).view(np.int64) for k in (0, 64)]
        ids = b.column("id").to_numpy(zero_copy_only=False)
        for s in range(segments):
            own = bits[s * width : (s + 1) * width]
            key = (own * weights[:width, None]).sum(axis=0, dtype=np.uint64).view(np.int64) | (s << 32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(code[0]), pa.array(code[1])], names=["key", "id", "c1", "c2"])

    return run


def as_set(items) -> F.Column:
    """Elements as sorted distinct 64-bit hashes; null for null and empty."""
    hashed = F.array_sort(F.array_distinct(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.xxhash64(x))))
    return F.when(F.size(hashed) > 0, hashed)


def _again(big: DataFrame, width: int) -> DataFrame:
    """Rows of large buckets by segments of their codes that don't overlap the bucket's own (``key`` holds its number above bit 32)."""
    first = F.shiftrightunsigned("key", 32) * width
    code = lambda s: F.when(s < 64 // AGAIN, F.shiftrightunsigned("c1", 0)).otherwise(F.col("c2"))
    part = lambda s: F.call_function("shiftrightunsigned", code(s), (s % (64 // AGAIN) * AGAIN).cast("int")).bitwiseAND((1 << AGAIN) - 1)
    free = F.filter(F.sequence(F.lit(0), F.lit(CODE_BITS // AGAIN - 1)), lambda s: (s * AGAIN >= first + width) | ((s + 1) * AGAIN <= first))
    return big.withColumn("s", F.explode(free)).select(F.xxhash64("key", "s", part(F.col("s"))).alias("key"), F.col("a").alias("id"), "c1", "c2")


def _blocks(big: DataFrame, limit: int) -> DataFrame:
    """Rows of large buckets, once for each pair of blocks that theirs is in."""
    blocks = big.groupBy("key").agg(F.ceil(F.count("*") / limit).cast("int").alias("blocks"))
    rows = skewed_join(big, blocks, "key").withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("key", "a", "c1", "c2", "own", other)
    return rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.col("a").alias("id"), "c1", "c2")


def _close(records: DataFrame, key: str, items: str, num: int, den: int, miss: float, seed: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """``(id, key)`` of all records, ``id`` standing for their set, and the pairs ``(a, b)`` of different sets that are close; both stored."""
    hashed = records.select(F.col(key).cast("string").alias("key"), as_set(F.col(items)).alias("items"))
    members = cut(hashed.where("key is not null and items is not null").withColumn("id", F.xxhash64("items")))
    sets = cut(members.groupBy("id").agg(F.first("items").alias("items")))
    width, segments, radius = calibrate(sets.count(), num / den, miss)
    rows = map_arrow(sets, _codes(width, segments, seed), "key bigint, id bigint, c1 bigint, c2 bigint")
    found = cut(bucket_pairs(rows, within(radius), limit))
    pairs = found.select("a", "b")
    big = found.where(F.col("b").isNull()).drop("b")
    if not big.isEmpty():
        more = cut(bucket_pairs(_again(big, width), within(radius), limit))
        pairs = pairs.unionByName(more.select("a", "b"))
        big = more.where(F.col("b").isNull()).drop("b")
        if not big.isEmpty():
            pairs = pairs.unionByName(bucket_pairs(_blocks(big, limit), within(radius), max(limit * 64, 1 << 20)).select("a", "b"))
    return cut(members.select("id", "key").distinct()), cut(overlap_at_least(cut(distinct_pairs(pairs)), sets, num, den))


def similar_pairs(
    records: DataFrame, key: str, items: str, num: int = 4, den: int = 5, miss: float = 1e-4, seed: int = 7, limit: int = LIMIT
) -> DataFrame:
    """Pairs ``(left_key, right_key)``, left before right as text, of records whose sets overlap by ``num / den`` or more.

    ``items`` is an array of strings; the overlap is common elements divided by distinct elements of both. Records with
    equal sets are joined through their set, so codes, candidates and checks are made once for each distinct set.

    Defined cases: null elements don't count, repeated elements count once; records with a null key, or a null or empty
    set, take no part; repeated rows of a record are one record; a key with several sets is paired through each of them;
    equal sets under different keys are a pair; an empty input gives no rows; other columns are ignored. Sets that many
    records have are spread over tasks by load. Elements and sets are compared by 64-bit hashes.
    """
    names, close = _close(records, key, items, num, den, miss, seed, limit)
    one, other = names.select(F.col("id").alias("a"), F.col("key").alias("k")), names.select(F.col("id").alias("b"), F.col("key").alias("l"))
    half = skewed_join(close, one, "a")
    across = skewed_join(cut(half.select("k", "b")), other, "b").select("k", "l")
    inside = skewed_join(names.withColumnRenamed("key", "k"), names.withColumnRenamed("key", "l"), "id").where("k < l").select("k", "l")
    return across.unionByName(inside).select(F.least("k", "l").alias("left_key"), F.greatest("k", "l").alias("right_key"))


def link_counts(
    records: DataFrame, key: str, items: str, num: int = 4, den: int = 5, miss: float = 1e-4, seed: int = 7, limit: int = LIMIT
) -> DataFrame:
    """``(key, class_key, links)``: for each record the least key with its set, and how many other records are similar.

    The form for large groups of copies: they are counted, not expanded into pairs. Defined cases as for
    :func:`similar_pairs`, but for a key with several sets, which has a row for each.
    """
    names, close = _close(records, key, items, num, den, miss, seed, limit)
    classes = cut(names.groupBy("id").agg(F.min("key").alias("class_key"), F.count("*").alias("n")))
    both = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partners = skewed_join(both, classes.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    counted = classes.join(partners, "id", "left").select("id", "class_key", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"))
    return skewed_join(names, counted, "id").select("key", "class_key", "links")
