"""Ranked lexical search by dual trees: the best documents of every item, exactly.

Documents become sparse vectors over the items' terms in one pass; corpus statistics come
from all of these. Then every task builds a tree over its documents, chunk by chunk, whose
nodes hold the largest impact of each term below them, and walks it together with a tree over
the items, whose nodes hold the union of their terms with their weights. The product of two
nodes bounds every score between them from above; if it doesn't beat the weakest kth score of
the node's items, the whole batch is left out (Ram and Gray 2012, dual-tree search for
maximum inner products; Curtin, Ram and Gray 2013). What tasks find is merged per item.

Thresholds start from a first search over one in ``SEED`` documents: the kth best score among
some documents never exceeds the one among all, so this loses nothing.

Items are searched in blocks of bounded text, so what tasks hold of them is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from tickframe.llm import words as W
from tickframe.llm.neardup import written

#: Documents returned per item.
K = 50
#: Text of the items of one block, in bytes on average.
BLOCK_BYTES = 1 << 20
#: One document in so many is searched first.
SEED = 64
#: Fixed values of the score (the factor of a weight; saturation and length, in thousandths).
WEIGHT, IMPACT, TF, LENGTH = 1000, 1_000_000_000, 1000, 20
_LAST = np.iinfo(np.int64).max  # after every id; a null id comes just before it


@dataclass(frozen=True)
class Shape:
    """How trees are built; results don't depend on it."""

    docs: int = 4096  #: documents of a tree
    entries: int = 2_000_000  #: entries of its vectors
    leaf: int = 4  #: documents of a leaf
    fan: int = 8  #: children of a node
    item_fan: int = 4  #: children of an item node
    step: int = 16  #: leaves whose documents are scored before the thresholds are looked at again


def document_vectors(vocabulary: np.ndarray):
    """A function over batches ``(id, text)``: ``id``, ``n`` terms in all, known terms and how often each occurs.

    ``vocabulary`` holds sorted hashes; a term's number is its place. Texts without terms give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(len(vocabulary), 1)
        for batch in batches:
            for lo, hi, raw, at in W.chunks(batch.column(1)):
                words = W.split(raw, at, W.NOT_ALNUM, lower=True)
                n = words.per_row()
                place = np.searchsorted(vocabulary, words.hash)
                place[place == len(vocabulary)] = 0
                known = vocabulary[place] == words.hash if len(vocabulary) else np.zeros(len(place), bool)
                cells, times = np.unique(words.row[known] * size + place[known], return_counts=True)
                ends = np.searchsorted(cells, np.arange(hi - lo + 1) * size).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (cells % size, times)]
                out = [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays(out, ["id", "n", "terms", "times"]).filter(pa.array(n > 0))

    return run


def item_terms(texts: list[str]) -> list[np.ndarray]:
    """Distinct hashes of the terms of each text."""
    out = []
    for _, _, raw, at in W.chunks(pa.array(texts, pa.string())):
        words = W.split(raw, at, W.NOT_ALNUM, lower=True)
        out += [np.unique(h) for h in np.split(words.hash, words.first[1:-1])]
    return out


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """The weight of terms that ``df`` of ``n_docs`` documents hold; 0 for one that none holds."""
    return np.where(df > 0, np.floor(WEIGHT * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))), 0).astype(np.int64)


def impacts(times: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each occurrence count adds to a score per unit of weight; ``n`` are the documents' lengths."""
    exact = n.astype(object) if len(n) and int(n.max()) * n_docs >= _LAST // 50 else n
    m = np.asarray(50 + (50 * exact * n_docs) // max(n_terms, 1), np.int64)
    return (IMPACT * times) // (TF * times + LENGTH * m)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of some runs, one run after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class ItemTree:
    """Items in order of their heaviest term; level 0 are items, nodes above hold the terms of the items below."""

    def __init__(self, terms: list[np.ndarray], weight: np.ndarray, shape: Shape = Shape()):
        self.shape = shape
        kept = [t[weight[t] > 0] for t in terms]
        heavy = np.array([t[np.argmax(weight[t])] if len(t) else len(weight) for t in kept], np.int64)
        order = np.argsort(heavy, kind="stable")
        self.order = order[heavy[order] < len(weight)]  # items that can score at all
        self.weight = weight
        self.union = [[kept[i] for i in self.order]]
        self.spans = [[(k, k + 1) for k in range(len(self.order))]]  # per level, the items of each node
        fan = shape.item_fan
        while len(self.union[-1]) > 1:
            below, spans = self.union[-1], self.spans[-1]
            starts = range(0, len(below), fan)
            self.union.append([np.unique(np.concatenate(below[k : k + fan])) for k in starts])
            self.spans.append([(spans[k][0], spans[min(k + fan, len(spans)) - 1][1]) for k in starts])


class DocumentTree:
    """Documents in order of their heaviest term; level 0 are documents, each level above holds coordinate maxima.

    A level's entries are sorted by term and node, so the nodes that hold a term lie together.
    """

    def __init__(self, ids, start, terms, impact, weight, shape: Shape = Shape()):
        """Every document has an entry; ``start`` has where its entries begin, and their number at the end."""
        self.shape = shape
        size = np.diff(start)
        row = np.repeat(np.arange(len(ids)), size)
        by_value = np.lexsort((weight[terms] * impact, row))
        heavy = terms[by_value[start[1:] - 1]]
        order = np.lexsort((ids, heavy))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        node = place[row]
        by_term = np.lexsort((node, terms))
        term, node, impact = terms[by_term], node[by_term], impact[by_term]
        self.first_id, self.key, self.node, self.impact, self.start = [ids[order]], [], [], [], []
        fan = shape.leaf
        while True:
            n = len(self.first_id[-1])
            self.key.append(term * n + node)
            self.node.append(node)
            self.impact.append(impact)
            self.start.append(np.searchsorted(term, np.arange(len(weight) + 1)))
            if n <= 1:
                break
            node = node // fan
            first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (node[1:] != node[:-1])))
            impact = np.maximum.reduceat(impact, first)
            term, node = term[first], node[first]
            self.first_id.append(np.minimum.reduceat(self.first_id[-1], np.arange(0, n, fan)))
            fan = shape.fan

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The nodes of the level below."""
        fan = self.shape.leaf if level == 1 else self.shape.fan
        below = len(self.first_id[level - 1])
        return _ranges(nodes * fan, np.minimum(below - nodes * fan, fan))

    def products(self, level: int, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Inner products of some nodes with the weights of some terms."""
        start = self.start[level][terms]
        size = self.start[level][terms + 1] - start
        n, impact = len(self.first_id[level]), self.impact[level]
        if 16 * len(nodes) * len(terms) < size.sum():  # few nodes: each entry is looked up
            asked = terms[:, None] * n + nodes
            at = np.minimum(np.searchsorted(self.key[level], asked), len(impact) - 1)
            return (np.where(self.key[level][at] == asked, impact[at], 0) * weights[:, None]).sum(0)
        at = _ranges(start, size)
        value = impact[at] * np.repeat(weights, size)
        if weights.sum() * (IMPACT // TF) < 1 << 53:  # sums of doubles are exact
            return np.bincount(self.node[level][at], value, n)[nodes].astype(np.int64)
        out = np.zeros(n, np.int64)
        np.add.at(out, self.node[level][at], value)
        return out[nodes]


class Best:
    """The k best documents of each item so far: by score, then by id."""

    def __init__(self, items: int, k: int, least: np.ndarray | None = None):
        self.k = k
        self.score = np.zeros(items, np.int64)
        self.id = np.full(items, np.iinfo(np.int64).min)
        if least is not None:  # known to be reached by k documents: equal scores may still get in
            self.score = least.copy()
            self.id[least > 0] = _LAST
        self.found = [[] for _ in range(items)]
        self.held = np.zeros(items, np.int64)

    def weakest(self, lo: int, hi: int) -> tuple[int, int]:
        """What a document has to beat to be among the best of any of these items."""
        low = self.score[lo:hi].min()
        return int(low), int(self.id[lo:hi][self.score[lo:hi] == low].max())

    def add(self, item: int, score: np.ndarray, ids: np.ndarray) -> None:
        better = (score > self.score[item]) | ((score == self.score[item]) & (ids < self.id[item]))
        if not better.any():
            return
        self.found[item].append((score[better], ids[better]))
        self.held[item] += int(better.sum())
        if self.held[item] >= self.k:
            self.trim(item)

    def trim(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        score, ids = (np.concatenate(parts) for parts in zip(*self.found[item], strict=True))
        order = np.lexsort((ids, -score))[: self.k]
        score, ids = score[order], ids[order]
        self.found[item], self.held[item] = [(score, ids)], len(score)
        if len(score) == self.k:
            self.score[item], self.id[item] = score[-1], ids[-1]
        return score, ids


def dual_search(items: ItemTree, docs: DocumentTree, best: Best) -> None:
    """Bring the documents of a tree into the best of all items."""

    def beats(bound: np.ndarray, first_id: np.ndarray, span: tuple[int, int]) -> np.ndarray:
        low, tie = best.weakest(*span)
        return (bound > low) | ((bound == low) & (first_id < tie))

    def score(item: int, leaves: np.ndarray, bound: np.ndarray) -> None:
        """Score the documents of leaves, those of the best bounds first, and the others if they still may get in."""
        terms, step = items.union[0][item], items.shape.step
        while len(leaves):
            rows = docs.children(1, leaves[:step]) if len(docs.first_id) > 1 else leaves
            best.add(item, docs.products(0, rows, terms, items.weight[terms]), docs.first_id[0][rows])
            leaves, bound = leaves[step:], bound[step:]
            level = min(1, len(docs.first_id) - 1)
            go = beats(bound, docs.first_id[level][leaves], (item, item + 1))
            leaves, bound = leaves[go], bound[go]
            step *= 8

    def visit(item_level: int, node: int, level: int, nodes: np.ndarray) -> None:
        terms, span = items.union[item_level][node], items.spans[item_level][node]
        bound = docs.products(level, nodes, terms, items.weight[terms])
        go = beats(bound, docs.first_id[level][nodes], span)
        nodes, bound = nodes[go], bound[go]
        if not len(nodes):
            return
        if item_level == 0 and level <= 1:
            order = np.argsort(-bound, kind="stable")
            score(node, nodes[order], bound[order])
            return
        below = docs.children(level, nodes) if level > 1 else nodes
        down = max(level - 1, min(level, 1))
        if item_level == 0:
            visit(0, node, down, below)
            return
        fan = items.shape.item_fan
        for child in range(node * fan, min((node + 1) * fan, len(items.spans[item_level - 1]))):
            visit(item_level - 1, child, down, below)

    top = len(docs.first_id) - 1
    for node in range(len(items.spans[-1])):
        visit(len(items.spans) - 1, node, top, np.arange(len(docs.first_id[top])))


def _searched(items: ItemTree, n_docs: int, n_terms: int, k: int, least: np.ndarray | None):
    """A function over batches of vectors: ``(item, doc, score)`` of the best of a task."""

    def tree(held: list[pa.RecordBatch]) -> DocumentTree | None:
        whole = pa.Table.from_batches(held).combine_chunks()
        lists = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (whole.column("terms"), whole.column("times"))]
        size = np.diff(lists[0].offsets.to_numpy())
        terms, times = (x.flatten().to_numpy().astype(np.int64) for x in lists)
        impact = impacts(times, np.repeat(whole.column("n").to_numpy(), size), n_docs, n_terms)
        use = items.weight[terms] > 0
        row = np.repeat(np.arange(len(size)), size)[use]
        rows = np.flatnonzero(np.bincount(row, minlength=len(size)))
        if not len(rows):
            return None
        ids = whole.column("id").combine_chunks()
        ids = ids.fill_null(_LAST - 1).to_numpy()[rows]
        start = np.append(np.searchsorted(row, rows), len(row))
        return DocumentTree(ids, start, terms[use], impact[use], items.weight, items.shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items.order), k, least)
        held, docs, entries = [], 0, 0

        def search() -> None:
            made = tree(held)
            if made is not None:
                dual_search(items, made, best)

        for batch in batches:
            held.append(batch)
            docs += batch.num_rows
            entries += len(batch.column(2).flatten())
            if docs >= items.shape.docs or entries >= items.shape.entries:
                search()
                held, docs, entries = [], 0, 0
        if docs:
            search()
        for k_, found in enumerate(best.found):
            if found:
                score, ids = best.trim(k_)
                item = pa.array(np.full(len(score), items.order[k_]), pa.int64())
                ids = pa.array(ids, pa.int64(), mask=ids == _LAST - 1)
                yield pa.RecordBatch.from_arrays([item, ids, pa.array(score)], ["item", "doc", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Over.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, texts: list[str], k: int, shape: Shape) -> DataFrame:
    """``item`` (place among the texts), ``doc``, ``score``, ``rank`` for one block of item texts."""
    hashes = item_terms(texts)
    vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, W.U64)
    terms = [np.searchsorted(vocabulary, h) for h in hashes]
    kind = "id bigint, n bigint, terms array<int>, times array<int>"
    vectors = written(docs.mapInArrow(document_vectors(vocabulary), kind), "vectors")
    total = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # terms of one block
        df[row["term"]] = row["count"]
    items = ItemTree(terms, term_weights(total.docs, df), shape)

    def search(part: DataFrame, least: np.ndarray | None) -> DataFrame:
        run = _searched(items, total.docs, total.terms or 0, k, least)
        return _ranked(part.mapInArrow(run, "item bigint, doc bigint, score bigint"), k)

    least = np.zeros(len(items.order), np.int64)
    place = {int(i): p for p, i in enumerate(items.order)}
    first = search(vectors.where(F.pmod(F.xxhash64("id"), F.lit(SEED)) == 0), None)
    for row in first.where(F.col("rank") == k).collect():  # one row per item of the block
        least[place[row["item"]]] = row["score"]
    return search(vectors, least)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    shape: Shape = Shape(),
) -> DataFrame:
    """``item_col, rank, id_col, score`` of the ``k`` highest-scoring documents of every item, all of them if fewer score.

    Terms are runs of letters, digits and characters beyond ASCII, with A-Z in lower case,
    told apart by 64-bit hashes. Equal scores go by ascending id, null ids last; ids are
    whole numbers. Null texts hold no terms; items without terms, or whose terms no document
    holds, give no rows, as do empty tables. Every row of ``items`` is an item of its own
    (equal texts are searched once); repeated documents are ranked each. Other columns are
    not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    rows = rows.where(F.col("text").isNotNull()).withColumn("digest", F.unhex(F.md5("text")))
    asked = written(rows.groupBy("digest").agg(F.any_value("text").alias("text")), "asked")
    blocks = int((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) + 1
    of = F.pmod(F.xxhash64("digest"), F.lit(blocks))
    found = None
    for block in range(blocks):
        own = sorted((bytes(r["digest"]), r["text"]) for r in asked.where(of == block).collect())
        named = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(own)], "item bigint, digest binary")
        part = _search_block(texts, [t for _, t in own], k, shape).join(named, "item")
        part = written(part.select("digest", "rank", "doc", "score"), "ranked")
        found = part if found is None else found.union(part)
    return found.join(rows.select("item_id", "digest"), "digest").select(
        F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score"
    )
