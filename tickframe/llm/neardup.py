"""Near-duplicate texts: DartMinHash signatures, banded joining, exact verification.

A text is the weighted set of its five-word shingles, weighted by how often each
occurs. Every element owns regions of the weight axis; hashed darts arrive in a
region one after another in order of rank, at the rate of the region's width, and a
dart counts if it lands below the element's weight. The earliest dart of each
coordinate is kept, so two texts agree in a coordinate with the probability of their
weighted Jaccard similarity (Christiani 2020, DartMinHash).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm import words as W
from tickframe.llm.common import free_names
from tickframe.session import work_path

SHINGLE = 5
SIMILARITY = 0.8
#: 36 bands of 6 coordinates: a pair at similarity 0.8 shares no band once in 50,000 times.
BANDS, BAND_ROWS = 36, 6
#: Texts of a block, when all texts of a cluster of buckets are compared.
BLOCK = 100
_U = W.U64


def shingles(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of every distinct shingle; a shorter text is one shingle."""
    words = W.split(raw, at)
    per_row = words.per_row()
    rows, hashes = [], []
    for n in range(1, SHINGLE + 1):
        start, h = W.grams(words, n)
        row = words.row[start]
        if n < SHINGLE:
            short = per_row[row] == n
            row, h = row[short], h[short]
        rows.append(row)
        hashes.append(h)
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], h[first], np.diff(np.append(first, len(h)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1) * 2.0**-53


def dart_signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, coords: int) -> np.ndarray:
    """One hash per row and coordinate: the earliest dart. Rows without elements stay 0.

    ``weight`` may be any positive numbers. Darts are thrown up to a rank at which all
    coordinates are likely to be hit; rows that still miss one are thrown at up to twice
    that rank, and so on, which changes no coordinate already hit.
    """
    out = np.zeros((rows, coords), _U)
    total = np.bincount(row, weight, rows)
    todo = np.flatnonzero(total > 0)
    reach = coords * (math.log(coords) + 2)
    # regions [0, 1), [1, 2), [2, 4), [4, 8), ... below each element's weight
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))) + 1, 1).astype(np.int64)
    item = np.repeat(np.arange(len(row)), levels)
    level = np.arange(len(item)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    region = W.mix(element[item] + level.astype(_U) * W.GRAM)
    region_row, top = row[item], weight[item]
    while len(todo):
        place = np.full(rows, -1)
        place[todo] = np.arange(len(todo))
        live = np.flatnonzero(place[region_row] >= 0)
        limit = reach / total[region_row[live]]
        rank, key = np.zeros(len(live)), region[live]
        slots, ranks, darts = [], [], []
        dart = 0
        while len(live):
            dart += 1
            thrown = W.mix(key + _U(dart * 0x9E3779B97F4A7C15 % (1 << 64)))
            rank = rank - np.log(_unit(thrown)) / width[live]
            go = rank < limit
            live, rank, limit, key, thrown = live[go], rank[go], limit[go], key[go], thrown[go]
            spot = W.mix(thrown + W.GRAM)
            hit = low[live] + width[live] * _unit(spot) <= top[live]
            cell = (W.mix(spot) >> _U(32)) * _U(coords) >> _U(32)
            slots.append((place[region_row[live]] * coords + cell.astype(np.int64))[hit])
            ranks.append(rank[hit])
            darts.append(thrown[hit])
        slot, rank, thrown = map(np.concatenate, (slots, ranks, darts))
        best = np.full(len(todo) * coords, np.inf)
        np.minimum.at(best, slot, rank)
        first = best[slot] == rank
        kept = np.zeros(len(todo) * coords, _U)
        kept[slot[first]] = thrown[first]
        out[todo] = kept.reshape(-1, coords)
        todo = todo[np.isinf(best.reshape(-1, coords)).any(1)]
        reach *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, band_rows: int) -> np.ndarray:
    """A 64-bit key per row and band."""
    parts = signature.reshape(len(signature), bands, band_rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), parts.shape[:2]).copy()
    for k in range(band_rows):
        key = W.mix(key * W.GRAM + parts[:, :, k])
    return key


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of each pair of texts; 0 without words."""
    out = []
    for lo, hi, raw, at in W.chunks(left):
        row, h, n = shingles(raw, at)
        other_row, other_h, other_n = shingles(*W.text_bytes(right.slice(lo, hi - lo)))
        key = np.concatenate((W.mix(h + row.astype(_U) * W.GRAM), W.mix(other_h + other_row.astype(_U) * W.GRAM)))
        count, rows = np.concatenate((n, other_n)), np.concatenate((row, other_row))
        order = np.argsort(key, kind="stable")
        key, count, rows = key[order], count[order], rows[order]
        both = np.flatnonzero(key[1:] == key[:-1])
        shared = np.bincount(rows[both], np.minimum(count[both], count[both + 1]), hi - lo)
        total = np.bincount(rows, count, hi - lo) - shared
        out.append(shared / np.maximum(total, 1))
    return np.concatenate(out) if out else np.zeros(0)


def block_links(texts: pa.Array, label: np.ndarray, block: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs at the threshold that join texts of different labels, as few as connect the same labels.

    Compares all texts of one block, or each text of one block with each of the other.
    """
    rows, units = [], []
    for lo, _, raw, at in W.chunks(texts):
        row, h, n = shingles(raw, at)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # the weight as that many units
        rows.append(np.repeat(row, n) + lo)
        units.append(W.mix(np.repeat(h, n) + nth.astype(_U) * W.GRAM))
    row, unit = np.concatenate(rows), np.concatenate(units)
    size = np.bincount(row, minlength=len(texts))
    order = np.argsort(unit, kind="stable")
    holders = row[order]
    new = np.concatenate(([True], unit[order][1:] != unit[order][:-1]))
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(unit)))
    group = np.empty(len(unit), np.int64)
    group[order] = np.cumsum(new) - 1
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    across = block.min() != block.max()
    label, links = label.copy(), []
    for k in range(len(texts)):
        if across and block[k] != block.min():
            continue
        own = group[first[k] : first[k + 1]]
        n = count[own]
        met = holders[np.repeat(start[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        shared = np.bincount(met, minlength=len(texts))
        like = shared >= (threshold - 1e-12) * (size + size[k] - shared)
        like &= (block != block[k]) if across else (np.arange(len(texts)) > k)
        for other in np.flatnonzero(like).tolist():
            if label[other] != label[k]:
                links.append((k, other))
                label[label == label[other]] = label[k]
    return links


def digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.col(text_col)))


def _sketch(bands: int, band_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi, raw, at in W.chunks(batch.column(2)):
                row, h, n = shingles(raw, at)
                filled = np.bincount(row, minlength=hi - lo) > 0
                signature = dart_signatures(row, h, n.astype(np.float64), hi - lo, bands * band_rows)
                keys.append(band_keys(signature[filled], bands, band_rows).ravel().view(np.int64))
                sizes.append(np.where(filled, bands, 0))
            ends = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["id", "digest", "bands"])

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # compared as whole numbers over the union would need both sums; a margin far
            # below the step between two such fractions keeps ties at the threshold in
            same = similarities(batch.column(2), batch.column(3)) >= threshold - 1e-12
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(same))

    return run


def _compare(threshold: float):
    """Over rows sorted by group: the links inside each group."""

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        node, label, block = (whole.column(c).to_numpy() for c in ("node", "label", "block"))
        text = whole.column("text").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        pairs = np.array(block_links(text, label, block, threshold), np.int64).reshape(-1, 2)
        ends = np.sort(node[pairs], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if hi == lo:
                    continue
                name = tuple(keys[:, lo].tolist())
                if name != now and held:
                    yield links(held)
                    held = []
                now = name
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield links(held)

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, so that lineage ends and lost executors cost nothing."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of pairs ``(a, b)``: each node with the smallest node it reaches.

    Roots joined by an edge hook onto the smaller one; hooks are then shortened by
    pointer doubling. Both loops end when a count finds nothing left to change.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = written(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        left = labels.select(F.col("node").alias("a"), F.col("label").alias("x"))
        right = labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
        crossing = edges.join(left, "a").join(right, "b").where("x != y")
        hooks = written(
            crossing.groupBy(F.greatest("x", "y").alias("root")).agg(F.min(F.least("x", "y")).alias("to")), "hooks"
        )
        if hooks.isEmpty():
            return labels
        while True:
            onward = hooks.select(F.col("root").alias("to"), F.col("to").alias("next"))
            longer = hooks.join(onward, "to")
            if longer.isEmpty():
                break
            hooks = written(
                hooks.join(onward, "to", "left").select("root", F.coalesce("next", "to").alias("to")), "hooks"
            )
        onward = hooks.select(F.col("root").alias("label"), "to")
        labels = written(
            labels.join(onward, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels"
        )


def text_classes(
    docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, band_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Every row's ``(id, digest, filled)``, and per distinct text with words its ``(digest, rep, label, node)``.

    ``rep`` is the smallest id of the text, ``label`` names the class, equal texts count once.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    sketch = written(
        source.mapInArrow(_sketch(bands, band_rows), f"id {kind}, digest binary, bands array<bigint>"), "sketch"
    )
    rows = sketch.select("id", "digest", (F.size("bands") > 0).alias("filled"))
    distinct = sketch.where(F.size("bands") > 0).groupBy("digest").agg(
        F.min("id").alias("rep"), F.any_value("bands").alias("bands")
    )
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # texts that share a band with another one meet through the bucket's smallest node
    entries = nodes.select("node", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("center")).where("n > 1")
    members = written(entries.join(buckets.select("key", "center"), "key"), "members")
    stars = members.where("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    stars = written(stars, "stars")

    named = nodes.join(members.select("node").distinct(), "node").select("digest", F.col("rep").alias("id"), "node")
    texts = source.where(F.col("digest").isNotNull()).join(
        named, (source.digest == named.digest) & source.id.eqNullSafe(named.id)
    )
    texts = written(texts.select("node", "text"), "texts")

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    both = stars.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    edges = written(both.mapInArrow(_verify(threshold), "a bigint, b bigint"), "edges")
    labels = components(edges)

    # buckets that still hold several classes: all their texts are compared, in blocks
    placed = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
    meets = members.where("node != center").join(mixed.select("key"), "key")
    meets = written(meets.select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "meets")
    clusters = components(meets).withColumnRenamed("label", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = clusters.join(sizes, "cluster").join(labels, "node", "left")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    blocks = blocks.select("cluster", "blocks", "node", F.coalesce("label", "node").alias("label"), block.alias("block"))
    # a block meets every block of its cluster, itself included, in a group of its own
    copies = blocks.join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    copies = copies.select(
        "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "label", "block", "text"
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = copies.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")
    more = written(copies.mapInArrow(_compare(threshold), "a bigint, b bigint"), "links")
    if not more.isEmpty():
        labels = components(edges.union(more))

    classes = nodes.select("digest", "rep", "node").join(labels, "node", "left")
    return rows, written(classes.withColumn("label", F.coalesce("label", "node")), "classes")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = SIMILARITY,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """One row ``(id_col, class_id)`` per row of ``docs``; class_id is the smallest id of its class.

    Texts belong together if a chain of pairs at ``threshold`` or more joins them. Repeated
    rows come back repeated, equal texts share a class whatever their ids. Null texts and
    texts without words are alike to nothing: their class_id is their own id. Null ids never
    name a class unless it has no other id. Columns besides the two are not read.
    """
    rows, classes = text_classes(docs, id_col, text_col, threshold, bands, band_rows)
    named = written(classes.groupBy("label").agg(F.min("rep").alias("class_id")), "named")
    by_text = written(classes.join(named, "label").select("digest", "class_id"), "by_text")
    filled = rows.where("filled").join(by_text, "digest").select(F.col("id").alias(id_col), "class_id")
    return filled.union(rows.where("not filled").select("id", "id"))


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = SIMILARITY,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """One row, all columns, of each class: the one with the smallest id.

    Texts without words (and null texts) stay. Of rows equal in id and text one stays.
    """
    _, classes = text_classes(docs, id_col, text_col, threshold, bands, band_rows)
    first = classes.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "node", "digest")).alias("k"))
    keep = written(first.select(F.col("k.digest").alias("digest"), F.col("k.rep").alias("id")), "keep")
    # an own id column, as the join must keep null ids and the caller's columns apart
    own_digest, own_id = free_names(docs, "_digest", "_id")
    marked = docs.withColumns({own_digest: digest(text_col), own_id: F.col(id_col)})
    filled = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    left = marked.where(filled).alias("d")
    found = left.join(
        keep.alias("k"),
        (F.col(f"d.{own_digest}") == F.col("k.digest")) & F.col(f"d.{own_id}").eqNullSafe(F.col("k.id")),
        "left_semi",
    )
    one = found.dropDuplicates([own_digest, own_id]).drop(own_digest, own_id)
    return one.unionByName(docs.where(~filled))
