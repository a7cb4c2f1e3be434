"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased runs of letters and digits of any script, in compatibility form (NFKC);
scripts written without blanks count by character. A text that shares a seed (a run of a
few tokens) with a benchmark item is tiled against it: the longest run both still hold
unmarked, found by Karp-Rabin hashes, is marked again and again until no run of the least
length is left. The marked share of the item decides, so passages in another order count.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm import words as W
from tickframe.llm.common import free_names
from tickframe.session import work_path

#: Tokens of a seed, and of the shortest tile. An item with fewer tokens is one seed.
LEAST_TILE = 5
#: Share of an item's tokens inside tiles, in hundredths, at which a text is contaminated.
COVERAGE = 50
#: Benchmarks up to this many bytes of text are broadcast; larger ones are joined by seed.
BROADCAST_BYTES = 16 << 20

COLUMNS = ["item_id", "item_tokens", "covered_tokens", "n_tiles"]


#: Characters that only steer line breaks and joining, and scripts written without blanks.
_UNSEEN = r"[\x{AD}\x{200C}\x{200D}\x{2060}\x{FEFF}]"
_UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"


def _plain(column: pa.Array) -> pa.Array:
    """Lower-cased texts in which blanks and ASCII signs alone separate tokens; nulls stay."""
    other = pc.invert(pc.fill_null(pc.string_is_ascii(column), True))
    if pc.any(other).as_py():
        # not Arrow's own normalisation, which leaves letters and their marks apart
        texts = pa.array([unicodedata.normalize("NFKC", t) for t in column.filter(other).to_pylist()], column.type)
        texts = pc.replace_substring_regex(texts, _UNSEEN, "")
        texts = pc.replace_substring_regex(texts, r"[^\x00-\x7F\p{L}\p{M}\p{N}]+", " ")
        texts = pc.replace_substring_regex(texts, _UNSPACED, r" \0 ")
        column = pc.replace_with_mask(column, other, texts)
    return pc.utf8_lower(column)


def tokens(column: pa.Array) -> Iterator[tuple[int, int, W.Words]]:
    """Words of each chunk of texts, as runs of letters and digits without case."""
    for lo, hi, raw, at in W.chunks(_plain(column)):
        yield lo, hi, W.split(raw, at, W.NOT_ALNUM)


def _rolled(ids: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and Karp-Rabin hash of every window of ``n`` tokens that are all free."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, W.U64)
    taken = np.concatenate(([0], np.cumsum(~free)))
    start = np.flatnonzero(taken[n:] == taken[:-n])
    up, down = W.powers(len(ids) + 1)
    sums = np.zeros(len(ids) + 1, W.U64)
    np.cumsum(ids * up[: len(ids)], out=sums[1:])
    return start, W.mix((sums[start + n] - sums[start]) * down[start])


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles ``(item start, text start, length)`` of two token arrays, longest first.

    Among equally long runs the one that begins earliest in the item, then in the text, is marked.
    """
    free_item = np.isin(item, text)
    free_text = np.isin(text, item)
    tiles = []
    high = min(len(item), len(text))
    while True:
        low, best = least, None  # the longest length with a common free window, by bisection
        while low <= high:
            n = (low + high) // 2
            starts, keys = _rolled(item, free_item, n)
            places, others = _rolled(text, free_text, n)
            if np.isin(keys, others).any():
                best, low = (n, starts, keys, places, others), n + 1
            else:
                high = n - 1
        if best is None:
            return tiles
        n, starts, keys, places, others = best
        spots = defaultdict(list)
        for place, key in zip(places[found := np.isin(others, keys)].tolist(), others[found].tolist(), strict=True):
            spots[key].append(place)
        for start, key in zip(starts.tolist(), keys.tolist(), strict=True):
            if not free_item[start : start + n].all():
                continue
            for place in spots.get(key, ()):
                if free_text[place : place + n].all() and (item[start : start + n] == text[place : place + n]).all():
                    free_item[start : start + n] = False
                    free_text[place : place + n] = False
                    tiles.append((start, place, n))
                    break
        high = n - 1


def tile_pair(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Tokens of the item, how many of them tiles cover, and the number of tiles."""
    least = min(LEAST_TILE, len(item))
    # tokens that the item lacks only keep runs apart: one of them is as good as many
    known = np.isin(text, item)
    known |= np.append(False, known[:-1])
    tiles = greedy_tiles(item, text[known], least) if least else []
    return len(item), sum(n for _, _, n in tiles), len(tiles)


class Items:
    """Benchmark items held by a task, and their seeds."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        self.ids, self.tokens = ids, [None] * len(texts)
        seeds = defaultdict(list)
        for lo, hi, words in tokens(texts):
            for k in range(hi - lo):
                own = words.hash[words.first[k] : words.first[k + 1]]
                self.tokens[lo + k] = own
                n = min(LEAST_TILE, len(own))
                for s in {int(x) for x in _seed_hashes(own, n)}:
                    seeds[n, s].append(lo + k)
        self.seeds = {}
        for n in range(1, LEAST_TILE + 1):
            pairs = sorted((s, k) for (m, s), ks in seeds.items() if m == n for k in ks)
            self.seeds[n] = (np.array([s for s, _ in pairs], W.U64), np.array([k for _, k in pairs], np.int64))

    def candidates(self, words: W.Words) -> np.ndarray:
        """Distinct (row, item) pairs that share a seed."""
        out = [np.zeros((0, 2), np.int64)]
        for n, (seeds, items) in self.seeds.items():
            if not len(seeds):
                continue
            start, keys = W.grams(words, n)
            near = np.searchsorted(seeds, keys)
            hit = seeds[np.minimum(near, len(seeds) - 1)] == keys
            start, keys = start[hit], keys[hit]
            first, last = np.searchsorted(seeds, keys), np.searchsorted(seeds, keys, "right")
            count = last - first
            which = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            out.append(np.column_stack((np.repeat(words.row[start], count), items[which])))
        return np.unique(np.concatenate(out), axis=0)


def _seed_hashes(own: np.ndarray, n: int) -> np.ndarray:
    one = W.Words(own, np.zeros(len(own), np.int64), own, own, np.array([0, len(own)]))
    return W.grams(one, n)[1] if n else np.zeros(0, W.U64)


def _tile_rows(items: Items, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """Row, item, its tokens, covered tokens and tiles, for pairs at the threshold."""
    for lo, _, words in tokens(column):
        for row, k in items.candidates(words).tolist():
            size, covered, n = tile_pair(items.tokens[k], words.hash[words.first[row] : words.first[row + 1]])
            if 100 * covered >= COVERAGE * size:
                yield lo + row, k, size, covered, n


def _small(benchmark: DataFrame, text_col: str, most: int) -> bool:
    size = benchmark.agg(F.sum(F.octet_length(text_col) + 64)).first()[0]
    return (size or 0) <= most


def _held(items: DataFrame):
    """The items as a broadcast pair of Arrow columns; their size was checked before."""
    table = items.toArrow()
    return items.sparkSession.sparkContext.broadcast(tuple(_whole(c) for c in table.columns))


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """A row per text and benchmark item whose tiles cover half of the item or more.

    Columns: ``id_col``, item_id, item_tokens, covered_tokens, n_tiles. Repeated rows of either
    table give repeated results. Null texts and texts or items without letters or digits match
    nothing; null ids are carried along. Both tables may have other columns.

    The benchmark is measured first: up to ``broadcast_bytes`` it is sent to all tasks,
    beyond it the seeds of both sides are joined and only texts that share one are tiled.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("item_text"))
    kinds = [source.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()]
    schema = f"`{id_col}` {kinds[0]}, item_id {kinds[1]}, item_tokens long, covered_tokens long, n_tiles long"
    if _small(items, "item_text", broadcast_bytes):
        held = _held(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(*held.value)
            for batch in batches:
                found = list(zip(*_tile_rows(known, batch.column(1)), strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(found[0], pa.int64())),
                        known.ids.take(pa.array(found[1], pa.int64())),
                        *(pa.array(x, pa.int64()) for x in found[2:]),
                    ],
                    [id_col, *COLUMNS],
                )

        return source.mapInArrow(run, schema)
    pairs = _candidate_pairs(source, items)

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                item, text = (
                    np.concatenate([np.zeros(0, W.U64), *(w.hash for _, _, w in tokens(batch.column(c).slice(k, 1)))])
                    for c in (3, 1)
                )
                size, covered, n = tile_pair(item, text)
                if 100 * covered >= COVERAGE * size:
                    found.append((k, size, covered, n))
            found = list(zip(*found, strict=True)) or [()] * 4
            rows = pa.array(found[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(2).take(rows), *(pa.array(x, pa.int64()) for x in found[1:])],
                [id_col, *COLUMNS],
            )

    return pairs.mapInArrow(tile, schema)


def _seeds(lengths: range | None):
    """Distinct seeds of each text: (key, length, hash). Items seed with their own length only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, W.U64)]
            for lo, _, words in tokens(batch.column(1)):
                per_row = words.per_row()
                for n in range(1, LEAST_TILE + 1):
                    start, h = W.grams(words, n)
                    row = words.row[start]
                    if lengths is None:
                        own = np.minimum(per_row[row], LEAST_TILE) == n
                        row, h = row[own], h[own]
                    elif n not in lengths:
                        continue
                    keys.append(row + lo)
                    sizes.append(np.full(len(row), n))
                    hashes.append(h)
            place = pa.array(np.concatenate(keys))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(place),
                    pa.array(np.concatenate(sizes)),
                    pa.array(np.concatenate(hashes).view(np.int64)),
                ],
                ["key", "size", "seed"],
            )

    return run


def _candidate_pairs(source: DataFrame, items: DataFrame) -> DataFrame:
    """(id, text, item, item_text) of all rows that share a seed, joined by seed and then by text.

    Texts and items enter the joins once each, by digest, however often they are repeated.
    """
    spark = source.sparkSession
    path = work_path(spark, "seeds")
    texts = source.where("text is not null").withColumn("key", F.md5("text"))
    goals = items.where("item_text is not null").withColumn("goal", F.md5("item_text"))
    goal_seeds = (
        goals.select("goal", "item_text").dropDuplicates(["goal"]).mapInArrow(_seeds(None), "key string, size long, seed long")
        .distinct().withColumnRenamed("key", "goal")
    )
    goal_seeds.write.parquet(path)
    goal_seeds = spark.read.parquet(path)
    lengths = [r[0] for r in goal_seeds.select("size").distinct().collect()]  # at most LEAST_TILE
    text_seeds = texts.select("key", "text").mapInArrow(
        _seeds(range(min(lengths), max(lengths) + 1) if lengths else range(0)), "key string, size long, seed long"
    )
    shared = text_seeds.join(goal_seeds, ["size", "seed"]).select("key", "goal").distinct()
    return texts.join(shared, "key").join(goals, "goal").select("id", "text", "item", "item_text")


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The rows, all columns, whose text covers no benchmark item to the threshold.

    Decided row by row where the benchmark is small, else by the text's digest: no id is needed.
    Null and empty texts stay, repeated rows stay or go together, an empty benchmark drops nothing.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    if not _small(items, "text", broadcast_bytes):
        texts = docs.select(F.md5(text_col).alias("key"), F.col(text_col).alias("text")).where("text is not null")
        hits = contaminated(texts.dropDuplicates(["key"]), items, "key", broadcast_bytes=broadcast_bytes)
        (own,) = free_names(docs, "_key")
        marked = docs.withColumn(own, F.md5(text_col))
        return marked.join(hits.select(F.col("key").alias(own)), own, "left_anti").drop(own).select(*docs.columns)
    place = docs.columns.index(text_col)
    held = _held(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items(*held.value)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[row for row, *_ in _tile_rows(known, batch.column(place))]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
