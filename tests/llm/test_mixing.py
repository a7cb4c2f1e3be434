"""Mixing by pivotal rounding: against a plain Python version, and its invariants."""

import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tickframe.llm import mixing
from tickframe.llm.queries import QUERIES

from . import brute
from .brute import DATA


def spark_hash(*values):
    """xxhash64 of Spark over longs and (last) integers; nulls are left out."""
    seed = 42
    for v in values:
        if v is None:
            continue
        kind, v = ("<i", v.n) if isinstance(v, Int) else ("<q", v)
        seed = xxhash.xxh64(struct.pack(kind, v), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


class Int:
    def __init__(self, n):
        self.n = n


def draw(*values):
    return spark_hash(*values) % (1 << 53) / (1 << 53)


def targets(sizes, weights=mixing.WEIGHTS, most=mixing.MOST, share=1.0):
    """Per source its target: capped sources leave the round with what they can hold."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        level = total / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * level > most * sizes[s]]
        if not above:
            out |= {s: weight[s] * level for s in open_}
            break
        for s in above:
            out[s] = float(most * sizes[s])
            total -= out[s]
            open_.remove(s)
    return names, out


def rounded(units, level, seed):
    """Bits of one chunk's units ``(key, id, copy, size, mass)``, and the unit left fractional."""
    units = sorted(units, key=lambda u: (-u[3], u[0]))
    words = [u[4] for u in units]
    bits, left = {}, None
    for k, u in enumerate(units):
        rest, size, x = range(k + 1, len(units)), u[3], words[k]
        m, s = sum(words[j] for j in rest), sum(units[j][3] for j in rest)
        if x <= 1e-9 or x >= size - 1e-9:
            bits[u[:3]] = int(2 * x > size)
            continue
        up, down = min(size - x, m), min(x, s - m)
        if draw(u[0], Int(level), Int(seed)) * (up + down) < down:
            for j in rest:
                words[j] *= (m - up) / m if m else 1
            moved = up
        else:
            for j in rest:
                room = units[j][3] - words[j]
                words[j] = units[j][3] - room * ((s - m - down) / (s - m) if s - m else 1)
            moved = -down
        x += moved
        if x <= 1e-9 or x >= size - 1e-9:
            bits[u[:3]] = int(2 * x > size)
        else:
            left = (*u[:4], x)
    return bits, left


def plain_mix(rows, seed=13):
    """Copies of every row ``(id, source, size)``, sorted by row."""
    sizes, filled = Counter(), Counter()
    for _, source, size in rows:
        sizes[source] += size
        filled[source] += size > 0
    names, target = targets(sizes)
    out, times = [], Counter(rows)
    for src, name in enumerate(names, 1):
        wanted = min(target[name] / sizes[name], mixing.MOST) if sizes[name] else 0.0
        whole, part, chunks = int(wanted), wanted - int(wanted), max(-(-filled[name] // mixing.CHUNK), 1)
        groups, owner = defaultdict(list), {}
        for (i, source, size), n in times.items():
            if source != name:
                continue
            if part <= 0 or size <= 0:
                out += [(i, source, size, whole)] * n
                continue
            for copy in range(1, n + 1):
                key = spark_hash(src, i, size, copy, Int(seed))
                owner[key, i, copy] = size
                groups[key % chunks].append((key, i, copy, size, part * size))
        level, bits = 0, {}
        while groups:
            lefts = {}
            for c, units in groups.items():
                found, left = rounded(units, level, seed)
                bits |= found
                if left:
                    lefts[c] = left
            groups = defaultdict(list)
            if chunks <= 1:
                bits |= {u[:3]: int(draw(u[0], Int(-1), Int(seed)) * u[3] < u[4]) for u in lefts.values()}
                break
            for c, u in lefts.items():
                groups[c // mixing.CHUNK].append(u)
            chunks, level = -(-chunks // mixing.CHUNK), level + 1
        out += [(u[1], name, size, whole + bits[u]) for u, size in owner.items()]
    return Counter(out), target, sizes


def same_order(row):
    return tuple((v is None, v) for v in row)


@pytest.fixture(scope="module")
def sized(spark):
    """Sources of very unequal sizes, repeated rows, empty documents, null sources and ids."""
    rows = [(k, f"s{k % 7 % 4}", k * k % 97) for k in range(900)]
    rows += [(5000 + k, "tiny", 3) for k in range(4)] + [(6000, "zero", 0)] * 3 + [(None, "s1", 40)] * 5
    rows += [(7000, None, 50)] * 300 + [(k, None, 9000 * (k == 7100)) for k in range(7099, 7102)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, size long")


def test_equals_brute_force(sized):
    rows, frame = sized
    found = mixing.mix_sources(frame, F.col("size")).collect()
    want, target, sizes = plain_mix(rows)
    assert Counter((r.doc_id, r.source, r.size, r.copies) for r in found) == want
    for r in found:
        assert r.target == pytest.approx(target[r.source], rel=1e-12) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= mixing.MOST


def test_many_levels_and_repeats(sized, monkeypatch):
    rows, frame = sized
    monkeypatch.setattr(mixing, "CHUNK", 4)
    monkeypatch.setattr(mixing, "REPEATS", 7)
    found = mixing.mix_sources(frame, F.col("size")).collect()
    assert Counter((r.doc_id, r.source, r.size, r.copies) for r in found) == plain_mix(rows)[0]


def test_sources_come_near_their_targets(sized):
    rows, frame = sized
    found = mixing.mix_sources(frame, F.col("size")).collect()
    taken, most = Counter(), Counter()
    for r in found:
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for r in found:
        assert abs(taken[r.source] - r.target) < max(most[r.source], 1e-6)
    assert sum({r.source: r.target for r in found}.values()) == pytest.approx(sum(r[2] for r in rows))


def test_probabilities_are_kept(spark):
    """Over many seeds each document is taken as often as its fraction says."""
    rows = [(k, "a", s) for k, s in enumerate([400, 5, 60, 60, 7, 90, 33, 1])] + [(99, "b", 1000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long").coalesce(1).cache()
    units = [(k, s, s * 0.35) for k, _, s in rows[:-1]]
    seen = Counter()
    for seed in range(3000):
        found, left = rounded([(spark_hash(k, seed), k, 1, s, m) for k, s, m in units], 0, seed)
        if left:
            found[left[:3]] = draw(left[0], Int(-1), Int(seed)) * left[3] < left[4]
        for (_, k, _), bit in found.items():
            seen[k] += bit
    assert all(abs(seen[k] / 3000 - 0.35) < 0.035 for k, _, _ in units)
    once, again = (sorted(map(tuple, mixing.mix_sources(f, F.col("size"), seed=5).collect())) for f in (frame, frame.repartition(3)))
    assert once == again


def test_query_and_odd_rows(spark, odd, none, documents):
    found = QUERIES["op13_pivotal_mix"](spark, DATA).collect()
    texts = dict(documents)
    assert sorted(r.doc_id for r in found) == sorted(texts)
    assert all(r.size == len(brute.words(texts[r.doc_id])) and r.taken <= 3 * r.size for r in found)
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want, target, _ = plain_mix([(r.doc_id, sources[r.doc_id], r.size) for r in found])
    assert Counter((r.doc_id, r.source, r.size, r.copies) for r in found) == want
    mixed = mixing.mix_words(odd).collect()
    assert Counter((r.doc_id, r.size) for r in mixed) == Counter((i, len(brute.words(t))) for i, t, *_ in brute.odd_rows())
    assert mixing.mix_words(none).count() == 0


def test_runs_without_python(sized, capsys):
    mixing.mix_sources(sized[1], F.col("size")).explain()
    assert not any(name in capsys.readouterr().out for name in ("Python", "Pandas", "Arrow"))
