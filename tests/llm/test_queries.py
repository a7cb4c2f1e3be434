"""The registered queries on the smallest test tables, against SQL or brute force."""

from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from tickframe.llm.queries import QUERIES, TRICKY, repetition_sql
from tickframe.llm.secrets import MASK

from . import brute
from .brute import DATA


def rows(spark, name):
    return QUERIES[name](spark, DATA).collect()


@pytest.fixture(scope="module")
def benchmark(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry_point.queries())


def test_op1(spark, documents):
    found = Counter((r.doc_id, r.start, r.stop) for r in rows(spark, "op1_secret_forest"))
    assert found == Counter((i, *m.span()) for i, t in documents for m in brute.SECRET.finditer(t))


def test_op2(spark, documents):
    score = brute.kneser_ney_scorer([t for i, t in documents if brute.crc(i) % 7 != 2], 2)
    texts = dict(documents)
    found = rows(spark, "op2_kneser_ney")
    assert len(found) == len(documents)
    for r in found:
        n, known, total, base, value = score(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (brute.crc(r.doc_id) % 7 == 2, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-7) and r.score == pytest.approx(value, abs=1e-7)
    unseen = [r for r in found if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_op2_trigrams(spark, documents):
    score = brute.kneser_ney_scorer([t for i, t in documents if brute.crc(i) % 7 != 2], 3)
    texts = dict(documents)
    found = entry_point.queries()["op2_kneser_ney_trigrams"](spark, DATA).collect()
    assert len(found) == len(documents)
    for r in found:
        n, known, total, base, value = score(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (brute.crc(r.doc_id) % 7 == 2, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-7) and r.score == pytest.approx(value, abs=1e-7)


def test_op3(spark):
    frame = QUERIES["op3_repetition"](spark, DATA)
    answer = duckdb.sql(repetition_sql(f"'{DATA}/documents.parquet'"))
    assert sorted(answer.columns) == sorted(frame.columns)
    assert sorted(map(tuple, frame.select(*answer.columns).collect())) == sorted(answer.fetchall())


def test_op4(spark, documents, benchmark):
    want = brute.contamination([t for _, t in documents], [t for _, t in benchmark])
    found = Counter(map(tuple, rows(spark, "op4_string_tiling")))
    assert found == Counter((documents[a][0], benchmark[k][0], *v) for (a, k), v in want.items()) and found


def test_op5(spark, documents):
    found = rows(spark, "op5_best_fit")
    texts = dict(documents)
    load, where, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in found:
        text = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, brute.zlib.crc32(text), "bytes", None)
        load[r.shard] += r.size
        where[text].add(r.shard)
        slots[r.shard].append(r.slot)
    assert len(found) == len(documents) and set(load) == set(range(8))
    assert max(load.values()) <= 1.01 * min(load.values()) and all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op6(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-7] = [("user", TRICKY), ("assistant", TRICKY)]
    found = {r.conv_id: r for r in rows(spark, "op6_budgeted_windows")}
    assert set(found) == set(turns)
    for c, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        r = found[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), brute.sha("".join(f"{a}\n{t}\n" for a, t in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha(loss))
        assert r.formatted_chars > sum(len(t) for _, t in own)


def test_op7(spark, documents):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    found = rows(spark, "op7_rule_ensemble")
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in documents)
    assert all(r.held_out == (brute.crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    assert all(r.predicted == (r.score >= 0.3) for r in found)
    seen = [r.predicted == labels[r.doc_id] for r in found if r.doc_id in labels and r.held_out]
    assert sum(seen) >= 0.9 * len(seen)


def test_op8(spark, documents):
    found = {r.doc_id: r for r in rows(spark, "op8_bpe")}
    for i, text in documents:
        ids, decoded = brute.encoded(text)
        r = found[i]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == brute.sha(decoded)


def test_op9(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = rows(spark, "op9_bigru_langid")
    assert len(found) == len(langs) and all(r.held_out == (brute.crc(r.doc_id) % 4 == 2) for r in found)
    unseen = [r.lang_pred == langs[r.doc_id] for r in found if r.held_out and langs[r.doc_id]]
    assert sum(unseen) >= 0.95 * len(unseen)


def test_op10(spark, documents):
    want = brute.classes(documents)
    first = {}
    for at, (i, _) in enumerate(documents):
        first[want[at]] = min(first.get(want[at], i), i)
    assert {(r.doc_id, r.class_id) for r in rows(spark, "op10_dart_minhash")} == {
        (i, first[want[at]]) for at, (i, _) in enumerate(documents)
    }


def test_pipeline(spark, documents, benchmark):
    """All stages by brute force, over all documents."""
    left = [(i, t) for i, t in documents if brute.repetition(t)["kept"]]
    of = brute.classes(left)
    first = {}
    for at in sorted(of, key=lambda at: left[at][0]):
        first.setdefault(of[at], left[at])
    left = sorted(first.values())
    dirty = {a for a, _ in brute.contamination([t for _, t in left], [t for _, t in benchmark])}
    left = [(i, brute.SECRET.sub(MASK, t)) for k, (i, t) in enumerate(left) if k not in dirty]
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert sorted(found) == [i for i, _ in left]
    for i, text in left:
        ids, decoded = brute.encoded(text)
        assert (found[i].ids, found[i].n_tokens, found[i].decoded_sha256) == (ids, len(ids), brute.sha(decoded))


def test_stages_with_odd_rows(spark, odd, none):
    frame = odd.withColumn("n_chars", odd.n_chars + 0)
    for docs in (frame, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, DATA)
            assert made.columns == docs.columns and [f.dataType for f in made.schema] == [f.dataType for f in docs.schema], name
            assert made.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()
