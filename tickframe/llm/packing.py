"""Shards of equal size by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts stay together. Groups above a fixed share of the total are items of
their own, so there are few; all others fall into a fixed number of bundles by the hash of
their text. The items, thousands at most for any input, are packed on the driver: largest
first, each into the bin with the tightest remaining capacity that holds it, found in a
balanced tree. The smallest capacity that needs no more bins than shards asked for is found
by bisection (MULTIFIT, Coffman, Garey and Johnson 1978).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from tickframe.llm.neardup import written

#: Groups of at least this part of all bytes are items; the rest falls into as many bundles.
HEAVY_PART = 4096
#: Ranges of documents whose slots are numbered apart and then put end to end.
SLOT_BUCKETS = 1024


class Tree:
    """A height-balanced search tree of distinct keys."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # nodes: [key, left, right, height]

    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _fix(self, node):
        left, right = self._height(node[1]), self._height(node[2])
        if left > right + 1:
            if self._height(node[1][2]) > self._height(node[1][1]):
                node[1] = self._turn(node[1], 2)
            return self._turn(node, 1)
        if right > left + 1:
            if self._height(node[2][1]) > self._height(node[2][2]):
                node[2] = self._turn(node[2], 1)
            return self._turn(node, 2)
        node[3] = 1 + max(left, right)
        return node

    def _turn(self, node, side: int):
        """Lift the child on a side above its parent."""
        child = node[side]
        node[side], child[3 - side] = child[3 - side], node
        for n in (node, child):
            n[3] = 1 + max(self._height(n[1]), self._height(n[2]))
        return child

    def insert(self, key) -> None:
        def put(node):
            if node is None:
                return [key, None, None, 1]
            side = 1 if key < node[0] else 2
            node[side] = put(node[side])
            return self._fix(node)

        self.root = put(self.root)

    def remove(self, key) -> None:
        def take(node, key):
            if key != node[0]:
                side = 1 if key < node[0] else 2
                node[side] = take(node[side], key)
                return self._fix(node)
            if node[1] is None or node[2] is None:
                return node[1] or node[2]
            least = node[2]
            while least[1]:
                least = least[1]
            node[0] = least[0]
            node[2] = take(node[2], least[0])
            return self._fix(node)

        self.root = take(self.root, key)

    def at_least(self, key):
        """The smallest key not below ``key``."""
        node, best = self.root, None
        while node:
            if node[0] >= key:
                best, node = node[0], node[1]
            else:
                node = node[2]
        return best


def best_fit_decreasing(sizes: dict, capacity: int) -> dict:
    """Bin of each item. Bins are numbered as they open; an item above the capacity has one alone.

    Equal sizes go in order of their names, equal remains in order of their bins.
    """
    place, tree, bins = {}, Tree(), 0
    for name, size in sorted(sizes.items(), key=lambda item: (-item[1], item[0])):
        found = tree.at_least((size, -1))
        if found is None:
            remains, bin_ = max(capacity, size), bins
            bins += 1
        else:
            remains, bin_ = found
            tree.remove(found)
        place[name] = bin_
        tree.insert((remains - size, bin_))
    return place


def pack(sizes: dict, bins: int) -> tuple[dict, int]:
    """Items into at most ``bins`` bins of the smallest capacity that bisection finds, and that capacity."""
    total, most = sum(sizes.values()), max(sizes.values(), default=0)
    low = max(most, -(-total // bins))
    high = max(2 * low, most)  # best fit never needs more bins than this at twice the mean
    best = best_fit_decreasing(sizes, high)
    while low < high:
        middle = (low + high) // 2
        trial = best_fit_decreasing(sizes, middle)
        if max(trial.values(), default=0) < bins:
            best, high = trial, middle
        else:
            low = middle + 1
    return best, high


def _named(spark, place: dict, key: str, kind: str) -> DataFrame:
    return spark.createDataFrame(list(place.items()), f"{key} {kind}, shard int")


def shard_by_size(
    docs: DataFrame, shards: int, size: Column, group: Column, id_col: str = "doc_id", carry: tuple[Column, ...] = ()
) -> DataFrame:
    """``id_col``, the ``carry`` columns, size, shard (from 0) and slot (gapless from 0 in each shard).

    ``group`` is a binary or string key; rows of one group share a shard. A group larger than
    the mean shard makes its shard as large as itself and no larger than need be. Null groups
    are one group. Repeated rows are rows of their own. Shards may stay empty if there are
    fewer groups than shards.
    """
    spark = docs.sparkSession
    rows = written(
        docs.select(
            F.col(id_col).alias("id"), size.cast("long").alias("size"), F.coalesce(group, F.lit(b"")).alias("group"), *carry
        ),
        "sizes",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"))
    heavy = groups.where(F.col("size") * HEAVY_PART >= F.lit(total).cast("decimal(38,0)"))
    heavy = {bytes(r["group"]): r["size"] for r in heavy.collect()}  # at most HEAVY_PART rows
    heavy_rows = spark.createDataFrame([(k,) for k in heavy], "group binary")
    bundle = F.pmod(F.xxhash64("group"), F.lit(HEAVY_PART)).cast("int")
    light = rows.join(F.broadcast(heavy_rows), "group", "left_anti").withColumn("bundle", bundle)
    light = {r["bundle"]: r["size"] for r in light.groupBy("bundle").agg(F.sum("size").alias("size")).collect()}
    place, _ = pack({("group", k): v for k, v in heavy.items()} | {("rest", k): v for k, v in light.items()}, shards)
    # both tables hold at most HEAVY_PART rows
    by_group = _named(spark, {k[1]: v for k, v in place.items() if k[0] == "group"}, "group", "binary")
    by_bundle = _named(spark, {k[1]: v for k, v in place.items() if k[0] == "rest"}, "bundle", "int")
    placed = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(by_group.withColumnRenamed("shard", "own")), "group", "left")
        .join(F.broadcast(by_bundle), "bundle", "left")
        .withColumn("shard", F.coalesce("own", "shard"))
        .withColumn("bucket", F.pmod(F.xxhash64("id", "size", "group"), F.lit(SLOT_BUCKETS)).cast("int"))
        .drop("own", "bundle")
    )
    # slots: numbered in each (shard, bucket), after the rows of the shard's earlier buckets
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Over.partitionBy("shard").orderBy("bucket").rowsBetween(Over.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Over.partitionBy("shard", "bucket").orderBy("id", "size", "group")
    numbered = placed.withColumn("number", F.row_number().over(order))
    joined = numbered.join(F.broadcast(offsets), ["shard", "bucket"])  # shards * SLOT_BUCKETS rows at most
    return joined.select(
        F.col("id").alias(id_col),
        *(c for c in rows.columns if c not in ("id", "size", "group")),
        "size",
        "shard",
        (F.col("offset") + F.col("number") - 1).alias("slot"),
    )


def text_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents into shards of nearly equal bytes; equal texts share a shard.

    A document's size is its UTF-8 bytes (none for a null text) plus 1; text_crc32 is that
    of its UTF-8 bytes, 0 for null and empty texts. Null and empty texts are one group.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return shard_by_size(
        docs,
        shards,
        F.octet_length(text) + 1,
        F.unhex(F.md5(text)),
        id_col,
        (F.crc32(text).alias("text_crc32"),),
    )
