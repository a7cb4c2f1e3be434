"""Dual-tree search against scoring every item with every document."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tickframe.llm import dualtree
from tickframe.llm.queries import QUERIES, ranked_search_sql

from . import brute
from .brute import DATA

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain_ranking(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 50 + (50 * c.total() * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms(text))
                if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def ranked(docs, items, **options):
    return Counter(map(tuple, dualtree.rank_documents(docs, items, **options).collect()))


def random_rows(seed, n, words=60, most=40):
    """Texts with skewed words, copies and empty ones."""
    rng = random.Random(seed)
    texts = [" ".join(f"W{int(rng.paretovariate(0.7)) % words}" for _ in range(rng.randrange(most))) for _ in range(n)]
    texts += [texts[3]] * (n // 3) + [None, "", "...", "naïve 漢字 naïve"]
    return [(k * 7919 % 100_003, t) for k, t in enumerate(texts)]


#: Trees of several levels over few rows.
SMALL = dualtree.Shape(docs=90, leaf=3, fan=2, item_fan=2, step=2)


@pytest.mark.parametrize("k", [1, 5, 50])
def test_equals_brute_force(spark, k):
    docs, items = random_rows(1, 400), random_rows(2, 37, most=9)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_ranking(docs, items, k)
    assert ranked(*frames, k=k, shape=SMALL) == want and len(want) > 30 * k


def test_blocks_of_items(spark):
    docs, items = random_rows(3, 200), random_rows(4, 60, most=9)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_ranking(docs, items, 4)
    assert ranked(*frames, k=4, block_bytes=400, shape=SMALL) == want


def test_whole_batches_are_left_out():
    """Of documents that hold a rare term or not, those without are never scored one by one."""
    rng = random.Random(5)
    n = 2000
    lists = [sorted({rng.randrange(5, 300) for _ in range(12)} | ({k % 5} if k < 50 else set())) for k in range(n)]
    start = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    flat = np.concatenate(lists).astype(np.int64)
    weight = dualtree.term_weights(n, np.bincount(flat, minlength=300))
    tree = dualtree.DocumentTree(np.arange(n), start, flat, np.full(len(flat), 1000), weight)
    items = dualtree.ItemTree([np.array([k, 7 + k, 50 + k]) for k in range(5)], weight, dualtree.Shape(step=2))
    best = dualtree.Best(5, 3)
    rows = []
    products = tree.products
    tree.products = lambda level, nodes, *rest: rows.append((level, len(nodes))) or products(level, nodes, *rest)
    dualtree.dual_search(items, tree, best)
    assert sum(size for level, size in rows if level == 0) < 5 * n / 4
    for place, item in enumerate(items.order):
        own = {int(item), 7 + int(item), 50 + int(item)}
        scores = sorted((-sum(1000 * int(weight[t]) for t in own & set(x)), k) for k, x in enumerate(lists))[:3]
        score, ids = best.trim(place)
        assert [(-int(s), int(i)) for s, i in zip(score, ids, strict=True)] == scores


def test_node_bounds_hold():
    rng = np.random.default_rng(6)
    start = np.concatenate(([0], np.cumsum(rng.integers(1, 9, 500))))
    terms_ = np.concatenate([np.sort(rng.choice(40, size, replace=False)) for size in np.diff(start)])
    weight = rng.integers(1, 1000, 40)
    tree = dualtree.DocumentTree(np.arange(500), start, terms_, rng.integers(1, 1000, len(terms_)), weight)
    every = np.arange(40)
    exact = tree.products(0, np.arange(500), every, weight)
    for level in range(1, len(tree.first_id)):
        for node in range(len(tree.first_id[level])):
            below, at = np.array([node]), level
            while at:
                below, at = tree.children(at, below), at - 1
            assert tree.products(level, np.array([node]), every, weight)[0] >= exact[below].max()
            assert tree.first_id[level][node] == tree.first_id[0][below].min()


def test_query_equals_sql(spark):
    frame = QUERIES["op12_dual_tree"](spark, DATA)
    answer = duckdb.sql(ranked_search_sql(f"'{DATA}/documents.parquet'", f"'{DATA}/benchmark.parquet'"))
    assert frame.columns == answer.columns
    assert Counter(map(tuple, frame.collect())) == Counter(answer.fetchall())


def test_large_products_do_not_overflow():
    times, n = np.array([3, 3]), np.array([10**9, 5])
    m = [50 + 50 * int(x) * 10**10 // 10**11 for x in n]
    assert dualtree.impacts(times, n, 10**10, 10**11).tolist() == [3 * 10**9 // (3000 + 20 * x) for x in m]


def test_odd_rows(spark, odd, none):
    docs = [(i, t) for i, t, *_ in brute.odd_rows()]
    items = [(1, "w0x0 changed"), (1, "w0x0 changed"), (None, "漢字 line t0"), (2, None), (3, ""), (4, "nowhere"), (5, "One TWO w1x1")]
    asked = spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, doc_id long, score string")
    assert ranked(odd, asked) == plain_ranking(docs, items, 50)
    assert ranked(none, asked) == Counter() == ranked(odd, asked.where("false"))
