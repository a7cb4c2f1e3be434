"""Interpolated modified Kneser-Ney n-gram models of whole corpora.

N-grams are counted in blocks: every task counts its own windows, sends one block to each
part of the key space, and the task of a part adds the blocks up, writes the part's sorted
keys and counts into the shared folder, and passes on what the next lower order and the
contexts need. N-grams of three words and more lie with their contexts, which needs no
shuffle of these; bigrams do not, as some words stand before very many others. Scoring tasks memory-map those arrays and look up their texts' n-grams.

Blocks name the most frequent words by short codes, which a sample of the texts gives, and carry the
hashes of all others; codes only shorten blocks, every n-gram of every text is counted.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm import words as W
from tickframe.session import work_path

_U = W.U64
#: Markers before and after a text; other tokens are hashes of words.
BEGIN, END = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
#: Windows a counting task gathers before it sends blocks: bounds its memory.
FLUSH = 2_500_000
GRAMS, CONTEXTS, TOTALS = 0, 1, 2
#: Words of the n-grams that lie in the part of their context.
BY_CONTEXT = 3
_BLOCK = "part int, kind int, level int, body binary"
#: Words that have codes at most, and the share of texts they are taken from.
CODED, CODED_FROM = 1 << 20, 1 / 12
#: Keys from which on an array of them keeps 48 bits of each; the others follow from its place.
SPLIT = 1 << 17


def gram_keys(columns: list[np.ndarray]) -> np.ndarray:
    """One key per row of word hashes."""
    key = np.full(len(columns[0]), _U(len(columns)))
    for c in columns:
        key = W.mix(key * W.GRAM + c)
    return key


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """The part of the key space; parts follow the order of keys."""
    return ((key >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def beside(level: int, order: int) -> bool:
    """Whether n-grams lie in the same parts as the contexts of as many words, and so need no keys of their own."""
    return 1 < level < order and level < BY_CONTEXT <= level + 1


def sentences(raw: np.ndarray, at: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The last ``order`` tokens up to every word and text end, as columns, and the row of each."""
    words = W.split(raw, at, lower=True)
    n = words.per_row()
    size = n + order
    first = np.concatenate(([0], np.cumsum(size)))
    tokens = np.full(first[-1], BEGIN)
    row = np.repeat(np.arange(len(n)), size)
    place = np.arange(len(words.hash)) + np.repeat(first[:-1] + order - 1 - words.first[:-1], n)
    tokens[place] = words.hash
    tokens[first[1:] - 1] = END
    last = np.arange(first[-1]) >= first[row] + order - 1
    last = np.flatnonzero(last)
    return [tokens[last - k] for k in range(order - 1, -1, -1)], row[last]


def _added(key: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """A place of each distinct key, by key, and the sums of ``values``."""
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return order[start], [np.add.reduceat(v[order], start, dtype=_U) if len(start) else np.zeros(0, _U) for v in values]


@dataclass(frozen=True)
class Codes:
    """Frequent words, the most frequent first; their places stand for them in blocks."""

    words: np.ndarray
    known: np.ndarray  #: the same, ascending
    rank: np.ndarray  #: and the places of these
    begin: np.ndarray  #: where those of each upper 20 bits begin

    def numbered(self, columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Codes of hashes; those beyond the known words are places in an ascending list of the rest."""
        out = []
        for c in columns:
            found = np.full(len(c), -1, np.int32)
            out.append(found)
            upper = (c >> _U(44)).astype(np.int32)
            at, end = self.begin[upper], self.begin[upper + 1]
            open_ = np.flatnonzero(at < end)
            at, end = at[open_], end[open_]
            while len(open_):  # few words share their upper bits
                hit = self.known[at] == c[open_]
                found[open_[hit]] = self.rank[at[hit]]
                more = np.flatnonzero(~hit & (at + 1 < end))
                open_, at, end = open_[more], at[more] + 1, end[more]
        other = [c[p < 0] for c, p in zip(columns, out, strict=True)]
        rest = np.unique(np.concatenate(other))
        for p, c in zip(out, other, strict=True):
            p[p < 0] = len(self.words) + np.searchsorted(rest, c)
        return out, rest


def _codes(words: np.ndarray) -> Codes:
    rank = np.argsort(words).astype(np.int32)
    begin = np.searchsorted(words[rank], np.arange(1 << 20, dtype=_U) << _U(44))
    return Codes(words, words[rank], rank, np.append(begin, len(words)).astype(np.int32))


UNCODED = _codes(np.zeros(0, _U))


@lru_cache(maxsize=2)
def codes(path: str) -> Codes:
    return _codes(_load(path, "codes"))


def _blocks(kind: int, level: int, key: np.ndarray, columns: list[np.ndarray], parts: int, coding: Codes) -> Iterator[tuple]:
    """A block of columns for each part; sorted by the first columns, which packs well. Takes the columns out of their list."""
    hashed = level if kind == GRAMS else 1
    part = part_of(gram_keys(columns[: level - 1]) if kind == GRAMS and level >= BY_CONTEXT else key, parts)
    places, rest = coding.numbered(columns[:hashed])
    numbers = columns[hashed:]
    columns.clear()
    del key
    bits, left = (len(coding.words) + len(rest)).bit_length(), 63 - int(parts).bit_length()
    edges = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))
    for p in places[: max(1, left // max(bits, 1))]:
        part = part << bits | p
    order = np.argsort(part)
    del part
    for p in np.flatnonzero(np.diff(edges)).tolist():
        own = order[edges[p] : edges[p + 1]]
        yield p, kind, level, _packed([c[own] for c in places], [c[own] for c in numbers], rest, len(coding.words))


_ZSTD = pa.Codec("zstd", 1)


def _planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones: what repeats lies together."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _packed(places: list[np.ndarray], numbers: list[np.ndarray], rest: np.ndarray, coded: int) -> bytes:
    """Columns of codes, with a list of the words that have none, then columns of numbers; compressed."""
    whole = np.stack(places).astype(np.int64)
    other = whole >= coded
    listed, at = np.unique(whole[other], return_inverse=True)
    whole[other] = coded + at
    whole[0, 1:] = np.diff(whole[0])  # the first column ascends
    known = rest[listed - coded]
    steps = np.diff(known, prepend=_U(0))  # the list ascends, so steps have fewer bytes
    kind = np.uint32 if all(int(c.max(initial=0)) < 1 << 32 for c in numbers) else _U
    counts = np.array(numbers, kind).reshape(len(numbers), -1)
    body = _planes(steps) + b"".join(_planes(c) for c in whole.astype(np.uint32)) + b"".join(_planes(c) for c in counts)
    head = np.array([len(known), whole.shape[1], len(places), len(numbers), counts.itemsize, coded, len(body)], np.int64)
    return head.tobytes() + bytes(memoryview(_ZSTD.compress(body)))


def _unpacked(bodies: list[bytes], coding: Codes) -> np.ndarray:
    """The columns of blocks, one after the other, as rows of one array. Takes the blocks out of their list."""
    heads = [np.frombuffer(b, np.int64, 7).tolist() for b in bodies]
    if any(h[5] not in (0, len(coding.words)) for h in heads):
        raise ValueError("the codes of words that blocks were made with are not to be found")
    out, lo = np.empty((heads[0][2] + heads[0][3], sum(h[1] for h in heads)), _U), 0
    bodies.reverse()
    for head in heads:
        _unpack(head, bodies.pop(), coding, out[:, lo : lo + head[1]])
        lo += head[1]
    return out


def _unpack(head: list[int], body: bytes, coding: Codes, out: np.ndarray) -> None:
    n, size, hashed, numbers, width, coded, length = head
    rest, at = memoryview(_ZSTD.decompress(memoryview(body)[56:], length)), 0

    def column(count: int, wide: int) -> np.ndarray:
        nonlocal at
        planes = np.frombuffer(rest, np.uint8, wide * count, at).reshape(wide, -1).T
        at += wide * count
        return np.ascontiguousarray(planes).view(f"u{wide}").reshape(-1)

    known = np.cumsum(column(n, 8), dtype=_U)
    for k in range(hashed):
        place = column(size, 4).astype(np.int64)
        if k == 0:
            place = np.cumsum(place)
        other = np.flatnonzero(place >= coded)
        listed = known[place[other] - coded]
        if coded:
            place[other] = 0
            out[k] = coding.words[place]
        out[k, other] = listed
    for k in range(hashed, hashed + numbers):
        out[k] = column(size, width)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    part, kind, level, body = zip(*rows, strict=True) if rows else ((),) * 4
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip((part, kind, level, body), kinds, strict=True)], ["part", "kind", "level", "body"]
    )


def _emit(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Blocks in batches of some megabytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[3])
        if size > 1 << 23:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of some texts with their counts, by task."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    held, n = [], 0
    for batch in batches:
        for _, _, raw, at in W.chunks(batch.column(0)):
            held.append(sentences(raw, at, 1)[0][0])
            n += len(held[-1])
            if n >= FLUSH:
                yield counted(held)
                held, n = [], 0
    if held:
        yield counted(held)


def _save_codes(texts: DataFrame, path: str) -> None:
    """The most frequent words of a sample of the texts, which blocks name by codes, into the shared folder."""
    words = texts.sample(CODED_FROM, seed=1).mapInArrow(_frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in batches)]
        _save(path, "codes", np.concatenate(found).view(_U))
        yield pa.RecordBatch.from_arrays([pa.array([0])], ["done"])

    most = words.orderBy(F.desc("n"), "word").limit(CODED).select("word")
    most.coalesce(1).mapInArrow(save, "done long").collect()


def _count(order: int, parts: int, path: str | None = None):
    def flush(columns: list[list[np.ndarray]]) -> Iterator[tuple]:
        whole = []
        for c in columns:
            whole.append(np.concatenate(c))
            c.clear()
        key = gram_keys(whole)
        first, (count,) = _added(key, [np.ones(len(key), np.uint8)])
        key = key[first]
        whole = [*(c[first] for c in whole), count, count]
        del first, count
        yield from _blocks(GRAMS, order, key, whole, parts, codes(path) if path else UNCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held, n = [[] for _ in range(order)], 0
            for batch in batches:
                for _, _, raw, at in W.chunks(batch.column(0)):
                    columns, row = sentences(raw, at, order)
                    for h, c in zip(held, columns, strict=True):
                        h.append(c)
                    n += len(row)
                    if n >= FLUSH:
                        yield from flush(held)
                        n = 0
            if n:
                yield from flush(held)

        yield from _emit(rows())

    return run


def _save(path: str, name: str, array: np.ndarray) -> None:
    """Write an array under a name of its own and rename it: a repeated task does no harm."""
    store, at = fs.FileSystem.from_uri(path)
    body = io.BytesIO()
    np.save(body, array)
    trial = f"{at}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(trial) as out:
        out.write(body.getbuffer())
    store.move(trial, f"{at}/{name}.npy")


def _load(path: str, name: str) -> np.ndarray:
    """An array that an earlier stage has written; empty if it has not."""
    store, at = fs.FileSystem.from_uri(path)
    try:
        with store.open_input_file(f"{at}/{name}.npy") as file:
            return np.load(io.BytesIO(file.read()))
    except FileNotFoundError:
        return np.zeros(0, _U)


def _save_keys(path: str, name: str, part: int, key: np.ndarray) -> None:
    """Ascending keys: whole, or of many 48 bits of each and where the keys of each of 65,536 ranges begin."""
    if len(key) >= SPLIT:
        first = int(key[0])
        shift = max(0, (int(key[-1]) - first).bit_length() - 16)
        key = key - _U(first)
        starts = np.searchsorted(key >> _U(shift), np.arange(1 << 16, dtype=_U))
        starts = [*starts, len(key), first & 0xFFFFFFFF, first >> 32, shift]
        _save(path, f"{name}.starts.{part:05d}", np.array(starts, np.uint32))
        key = np.ascontiguousarray((key & _U((1 << shift) - 1)).view(np.uint16).reshape(-1, 4)[:, :3])
    _save(path, f"{name}.keys.{part:05d}", key)


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Where ranges begin, the first key, and the bits a key has within its range."""
    low, high, shift = starts[-3:].tolist()
    return starts[:-3], high << 32 | low, shift


def _load_keys(path: str, name: str, part: int) -> np.ndarray:
    key = _load(path, f"{name}.keys.{part:05d}")
    if key.ndim == 1:
        return key
    starts, first, shift = _ranges(_load(path, f"{name}.starts.{part:05d}"))
    upper = np.repeat(np.arange(1 << 16, dtype=_U) << _U(shift), np.diff(starts.astype(np.int64)))
    return (upper | _low_bits(key)) + _U(first)


def _low_bits(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), 4), np.uint16)
    out[:, :3] = rows
    return out.view(_U)[:, 0]


def _places(own: np.ndarray, starts: np.ndarray | None, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ascending ``asked`` keys there are, and their places."""
    if own.ndim == 1:
        place = np.minimum(np.searchsorted(own, asked), len(own) - 1)
        hit = np.flatnonzero(own[place] == asked)
        return hit, place[hit]
    starts, first, shift = _ranges(starts)
    since = asked - _U(first)  # keys before the first one wrap around to beyond the last
    upper = since >> _U(shift)
    known = np.flatnonzero(upper < _U(1 << 16))
    upper, want = upper[known].astype(np.int64), since[known] & _U((1 << shift) - 1)
    low, high = starts[upper].astype(np.int64), starts[upper + 1].astype(np.int64)
    last, open_ = high, np.flatnonzero(low < high)
    at, end, own_want = low[open_], high[open_], want[open_]
    while len(open_):  # the first key that is not below, by halves
        middle = (at + end) >> 1
        below = _low_bits(own.take(middle, 0)) < own_want
        at, end = np.where(below, middle + 1, at), np.where(below, end, middle)
        low[open_] = at
        more = np.flatnonzero(at < end)
        open_, at, end, own_want = open_[more], at[more], end[more], own_want[more]
    hit = np.flatnonzero(low < last)
    hit = hit[_low_bits(own.take(low[hit], 0)) == want[hit]]
    return known[hit], low[hit]


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and the number of each row's key among them."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(key)]
    back = np.empty(len(key), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], order[new], back


def _save_counts(path: str, name: str, part: int, key: np.ndarray | None, count: np.ndarray, raw: np.ndarray | None) -> None:
    """Keys (None: another table has them), counts of one byte, and apart from them the counts that need more."""
    if key is not None:
        _save_keys(path, name, part, key)
    _save(path, f"{name}.count.{part:05d}", np.minimum(count, _U(255)).astype(np.uint8))
    large = np.flatnonzero(count >= 255)
    _save(path, f"{name}.large.{part:05d}", np.stack((large.astype(_U), count[large])))
    if raw is not None:
        _save(path, f"{name}.raw.{part:05d}", raw)


def _save_contexts(path: str, level: int, part: int, key: np.ndarray, sums: list[np.ndarray]) -> None:
    """Keys, the number of their four sums among the 255 most frequent ones, and apart from them all other sums."""
    whole = np.stack(sums, 1)
    small = (whole < 255).all(1)
    four = np.where(small, whole.T, _U(255)).astype(np.uint8).T
    kinds, at, n = np.unique(np.ascontiguousarray(four).view(np.uint32)[:, 0], return_inverse=True, return_counts=True)
    common = np.argsort(-n, kind="stable")[:256]
    common = common[kinds[common] != 0xFFFFFFFF][:255]
    number = np.full(len(kinds), 255, np.uint8)
    number[common] = np.arange(len(common))
    table = np.zeros((256, 4), np.uint8)
    table[: len(common)] = kinds[common].view(np.uint8).reshape(-1, 4)
    _save_keys(path, f"context{level}", part, key)
    _save(path, f"context{level}.sums.{part:05d}", number[at])
    _save(path, f"context{level}.kinds.{part:05d}", table)
    large = np.flatnonzero(number[at] == 255)
    rare = np.column_stack((large.astype(_U), whole[large]))
    _save(path, f"context{level}.large.{part:05d}", rare.astype(np.uint32) if int(rare.max(initial=0)) < 1 << 32 else rare)


def _merge(order: int, parts: int, path: str):
    """Add up the blocks of each part, write its arrays, and pass the rest on."""

    def contexts(part: int, level: int, whole: np.ndarray) -> None:
        first, sums = _added(whole[0], list(whole[1:]))
        _save_contexts(path, level, part, whole[0][first], sums)

    def grams(part: int, level: int, bodies: list[bytes]) -> Iterator[tuple]:
        whole = _unpacked(bodies, codes(path))
        key = gram_keys(list(whole[:level]))
        first, (count, raw) = _added(key, [whole[-2], whole[-1]])
        columns, key = [c[first] for c in whole[:level]], key[first]
        del whole, first
        if level < order:  # nothing can stand left of a text's beginning
            count = np.where(columns[0] == BEGIN, raw, count)
        if beside(level, order):  # most bigrams are contexts too, whose keys are stored
            known = _load_keys(path, f"context{level + 1}", part)
            place = np.searchsorted(known, key)
            hit = np.append(known, _U(0))[place] == key
            hit &= place < len(known)
            shared = np.zeros(len(known), _U)
            shared[place[hit]] = count[hit]
            _save_counts(path, f"shared{level}", part, None, shared, None)
            _save_counts(path, f"gram{level}", part, key[~hit], count[~hit], None)
        else:
            _save_counts(path, f"gram{level}", part, key, count, raw if level == 1 else None)
        ones = [count == k for k in (1, 2, 3, 4)]
        more = count >= 3
        totals = [*(x.sum() for x in (*ones, more)), len(key), count.sum(), raw.sum()]
        del key
        yield -1, TOTALS, level, np.array(totals, _U).tobytes()
        if level == 1:
            return
        context = gram_keys(columns[:-1])
        at, sums = _added(context, [count, ones[0], ones[1], more])
        if level >= BY_CONTEXT:  # all n-grams of the context are here
            _save_contexts(path, level, part, context[at], sums)
        else:
            yield from _blocks(CONTEXTS, level, context[at], [context[at], *sums], parts, UNCODED)
        del context, at, sums, count, ones, more
        columns = columns[1:]
        rest = gram_keys(columns)
        at, sums = _added(rest, [np.ones(len(rest), np.uint8), raw])
        rest, columns = rest[at], [*(c[at] for c in columns), *sums]
        del at, sums, raw
        yield from _blocks(GRAMS, level - 1, rest, columns, parts, codes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(name: tuple, bodies: list[bytes]) -> Iterator[tuple]:
            part, kind, level = name
            if kind == TOTALS:
                yield from ((part, kind, level, b) for b in bodies)
                return
            if kind == CONTEXTS:
                contexts(part, level, _unpacked(bodies, codes(path)))
            else:
                yield from grams(part, level, bodies)

        def rows():
            now, held = None, []
            for batch in batches:
                for part, kind, level, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (part, kind, level) != now and held:
                        yield from finished(now, held)
                        held = []
                    now = (part, kind, level)
                    held.append(body)
            if held:
                yield from finished(now, held)

        yield from _emit(rows())

    return run


@dataclass(frozen=True)
class Model:
    """Where the arrays of a model are, and what holds for all of it."""

    path: str
    order: int
    parts: int
    discounts: tuple[tuple[float, float, float], ...]  #: by order, from 1: for counts 1, 2, 3 or more
    total: int  #: sum of the unigram counts
    ones: tuple[int, int, int]  #: unigrams of count 1, 2, 3 or more
    vocabulary: int
    tokens: int


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of Chen and Goodman, from the numbers of n-grams that occur 1, 2, 3 and 4 times.

    Where one of these numbers is 0 the estimate is undefined and 0.5, 1, 1.5 are used.
    """
    if min(n) == 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def _made(spark: SparkSession, path: str) -> str:
    """A new folder with the file system that Spark takes a plain path to be on: a table of one row tells."""
    spark.range(1).write.parquet(f"{path}/place")
    file = spark.read.parquet(f"{path}/place").inputFiles()[0]
    return unquote(file[: file.rindex("/place/")])


def train(texts: DataFrame, text_col: str = "text", order: int = 2, parts: int | None = None) -> Model:
    """Count all n-grams of all texts and write the model into the shared folder.

    Lower-case A-Z; tokens are words and one end per text, which for a null or empty text is
    its only one. ``parts`` (the session's shuffle partitions by default) should leave some
    million n-grams to each part; results don't depend on it.
    """
    spark = texts.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = _made(spark, work_path(spark, "kneser-ney"))
    texts = texts.select(F.col(text_col).alias("text"))
    _save_codes(texts, path)
    blocks = texts.mapInArrow(_count(order, parts, path), _BLOCK)
    for _ in range(order):
        blocks = blocks.repartition(parts, "part").sortWithinPartitions("part", "kind", "level")
        blocks = blocks.mapInArrow(_merge(order, parts, path), _BLOCK)
    totals = {m: np.zeros(8, np.int64) for m in range(1, order + 1)}
    # a batch holds few blocks, so that a task holds the blocks of one part only
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "64")
    try:
        rows = blocks.select("level", "body").collect()  # one row of numbers per part and order
    finally:
        spark.conf.set(setting, before)
    for r in rows:
        totals[r["level"]] += np.frombuffer(r["body"], _U).astype(np.int64)
    found = tuple(discounts(totals[m][:4].tolist()) for m in range(1, order + 1))
    one = totals[1].tolist()
    return Model(path, order, parts, found, one[6], (one[0], one[1], one[4]), one[5], one[7])


class Arrays:
    """Memory-mapped arrays of a model, opened where they are first needed."""

    def __init__(self, path: str):
        store, at = fs.FileSystem.from_uri(path)
        if not isinstance(store, fs.LocalFileSystem):
            # a store that cannot be mapped: this worker's machine keeps a copy of what it maps
            local = os.path.join(tempfile.gettempdir(), f"model-{os.path.basename(at)}-{os.getpid()}")
            os.makedirs(local, exist_ok=True)
            self.fetch = lambda name: fs.copy_files(f"{at}/{name}", f"{local}/{name}", source_filesystem=store)
            at = local
        else:
            self.fetch = None
        self.at, self.open = at, {}

    def get(self, name: str) -> np.ndarray | None:
        if name not in self.open:
            path = f"{self.at}/{name}.npy"
            if self.fetch and not os.path.exists(path):
                try:
                    self.fetch(f"{name}.npy")
                except FileNotFoundError:
                    pass
            if not os.path.exists(path):
                self.open[name] = None  # a part without keys
            else:
                small = os.path.getsize(path) < 4096
                self.open[name] = np.load(path, mmap_mode=None if small else "r").view(np.ndarray)
        return self.open[name]

    def find(
        self, name: str, parts: int, keys: np.ndarray, context: np.ndarray | None = None
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per part: its number, which of the ascending ``keys`` it holds, and where. Keys may lie by their ``context``."""
        part = part_of(keys if context is None else context, parts)
        order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
        edges = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))
        for part in np.flatnonzero(np.diff(edges)).tolist():
            own = self.get(f"{name}.keys.{part:05d}")
            if own is None or not len(own):
                continue
            which = order[edges[part] : edges[part + 1]]
            starts = self.get(f"{name}.starts.{part:05d}") if own.ndim > 1 else None
            hit, place = _places(own, starts, keys[which])
            yield part, which[hit], place

    def counts(
        self,
        name: str,
        parts: int,
        keys: np.ndarray,
        raw: bool = False,
        context: np.ndarray | None = None,
        shared: tuple[str, str] | None = None,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Counts (0 if unseen) of ascending keys, and the raw counts if asked for."""
        out, whole = np.zeros(len(keys)), np.zeros(len(keys), np.int64)
        for keys_of, counts_of in ((name, name), *([shared] if shared else [])):
            for part, which, place in self.find(keys_of, parts, keys, context):
                own = self.get(f"{counts_of}.count.{part:05d}")
                if own is None:
                    continue
                got = own[place].astype(np.float64)
                large, values = self.get(f"{counts_of}.large.{part:05d}")
                more = np.flatnonzero(got == 255)
                got[more] = values[np.searchsorted(large, place[more].astype(_U))]
                out[which] = got
                if raw:
                    whole[which] = self.get(f"{name}.raw.{part:05d}")[place]
        return out, whole

    def contexts(self, level: int, parts: int, keys: np.ndarray) -> np.ndarray:
        """Total and numbers of continuations of count 1, 2, 3 or more, for ascending keys."""
        out = np.zeros((len(keys), 4))
        for part, which, place in self.find(f"context{level}", parts, keys):
            number = self.get(f"context{level}.sums.{part:05d}")[place]
            got = self.get(f"context{level}.kinds.{part:05d}")[number].astype(np.float64)
            more = np.flatnonzero(number == 255)
            if len(more):
                large = self.get(f"context{level}.large.{part:05d}")
                got[more] = large[np.searchsorted(large[:, 0], place[more].astype(large.dtype)), 1:]
            out[which] = got
        return out


@lru_cache(maxsize=2)
def arrays(path: str) -> Arrays:
    return Arrays(path)


def token_scores(model: Model, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of the last token of each window, and its raw count."""
    held = arrays(model.path)
    p = raw = None
    for m in range(1, model.order + 1):
        own = columns[model.order - m :]
        keys, first, back = _distinct(gram_keys(own))
        context = gram_keys([c[first] for c in own[:-1]]) if m >= BY_CONTEXT else None
        shared = (f"context{m + 1}", f"shared{m}") if beside(m, model.order) else None
        count, whole = held.counts(f"gram{m}", model.parts, keys, raw=m == 1, context=context, shared=shared)
        d = np.array([0.0, *model.discounts[m - 1]])
        kept = np.maximum(count - d[np.minimum(count, 3).astype(np.int64)], 0.0)
        if m == 1:
            raw = whole[back]
            if not model.total:  # nothing was learned: every token is as likely as any
                return np.full(len(back), -np.log10(model.vocabulary + 1.0)), raw
            rest = float(np.dot(model.ones, d[1:])) / model.total / (model.vocabulary + 1)
            p = (kept / model.total + rest)[back]
            continue
        keys, _, place = _distinct(gram_keys(own[:-1]))
        sums = held.contexts(m, model.parts, keys)
        total = np.where(sums[:, 0] > 0, sums[:, 0], 1.0)
        share = np.where(sums[:, 0] > 0, sums[:, 1:] @ d[1:] / total, 1.0)
        p = kept[back] / total[place] + share[place] * p
    return np.log10(p), raw


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, n_known, train_tokens, base_score, score and perplexity of every whole text.

    score is the model's log10 probability of the text with its end, base_score that of
    unigrams with one added to each count. A null or empty text is its end alone. Repeated
    rows and null ids come back as they are; other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2]
            for lo, hi, raw, at in W.chunks(batch.column(1)):
                columns, row = sentences(raw, at, model.order)
                value, count = token_scores(model, columns)
                base = np.log10((count + 1.0) / (model.tokens + model.vocabulary + 1.0))
                n = hi - lo
                parts.append(
                    (
                        np.bincount(row, minlength=n),
                        np.bincount(row[count > 0], minlength=n),
                        np.bincount(row, base, n),
                        np.bincount(row, value, n),
                    )
                )
            tokens, known, base, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            perplexity = 10.0 ** np.minimum(-value / np.maximum(tokens, 1), 300.0)
            trained = np.full(len(tokens), model.tokens, np.int64)
            found = [pa.array(x) for x in (tokens.astype(np.int64), known.astype(np.int64), trained, base, value, perplexity)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], [id_col, *names])

    return source.mapInArrow(
        run,
        f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double",
    )
