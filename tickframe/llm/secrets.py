"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

Dictionary and character transitions are counted over the whole corpus; every candidate is
then described by its length, its character transitions, how much of it dictionary words
cover, its path and the words around it. A forest learned from labelled findings votes.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm import words as W
from tickframe.llm.neardup import written

#: Words of the dictionary (the most frequent of 4 to 12 letters in the corpus), and labelled
#: findings of either label that the forest is fitted on (those with the smallest hashes).
DICTIONARY, SAMPLE = 20_000, 8_000
TREES, DEPTH, SEED = 30, 6, 5
MASK = "[SECRET]"

_KEYWORD = r"pass(?:word|wd|phrase)?|pwd|secret|token|credential|auth|api[_-]?key|access[_-]?key|private[_-]?key"
#: Long runs of key characters; values that a name around a keyword is assigned, up to
#: blank, quote or delimiter; passwords in addresses.
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_SEPARATOR = re.compile(r"[:=]")
_VALUE = re.compile(r"[:=]*>?\s{0,3}[\"']?([^\s\"'`,;<>]{8,})")
_SHORT = re.compile(_VALUE.pattern.replace("{8,}", "+"))
_OPENING = re.compile(r"[(\[{]")
_KEY_CHARS = re.compile(r"[A-Za-z0-9+/_.~-]+={0,2}")
_NAME = re.compile(r"([\w.-]+)[\"']?\]?\s{0,3}$")
_KEY = re.compile(rf"(?i:{_KEYWORD})")
_URL = re.compile(r"://[^\s:/@\"'<>]*:([^\s/\"'<>]+)@(?=[\w\[])")
_IN_URL = re.compile(r"://[^\s:/@\"'<>]*:$")
#: Keywords as words or parts of names: DB_PASSWORD, password_prod, dbPassword, passwordProd.
_PARTS = r"Pass(?:word|wd|phrase)?|Pwd|Secret|Token|Credential|Auth|Api[_-]?Key|Access[_-]?Key|Private[_-]?Key"
_NEAR = re.compile(
    rf"(?<![^\W\d_])(?i:{_KEYWORD})(?![^\W\d_])|(?<![^\W\d_])(?:{_KEYWORD})(?=[A-Z])|(?<=[a-z])(?:{_PARTS})(?![a-z])"
)
_ASSIGNED = re.compile(r"[:=]>?\s*[\"']?$")
_WORD = re.compile(r"[^\W\d_]+")
_FORMATS = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}")
_HEX = re.compile(r"(?:[0-9a-f]{16,}|[0-9A-F]{16,})")

PATH_BUCKETS, WORD_BUCKETS = 4, 8
FEATURES = [
    "length", "class_changes", "transitions", "entropy", "digits", "capitals", "distinct", "hex", "coverage",
    "quoted", "assigned", "keyword", "test_path",
    *(f"path_{k}" for k in range(PATH_BUCKETS)), *(f"before_{k}" for k in range(WORD_BUCKETS)),
]


@dataclass(frozen=True)
class Corpus:
    """What the features know of the corpus: frequent words, and log probabilities of letter pairs."""

    dictionary: frozenset[str]
    pairs: np.ndarray  #: (37, 37): letters without case, digits, all else


_CLASS = np.full(256, 36, np.int64)
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = np.arange(26)
_CLASS[ord("0") : ord("9") + 1] = 26 + np.arange(10)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of dictionary words and of pairs of characters inside words, by chunk."""
    for batch in batches:
        for _, _, raw, at in W.chunks(batch.column(0)):
            words = W.split(raw, at, W.NOT_ALNUM, lower=True)
            size = words.end - words.start
            letter = np.concatenate(([0], np.cumsum(_CLASS[raw] < 26)))
            plain = np.flatnonzero((size >= 4) & (size <= 12) & (letter[words.end] - letter[words.start] == size))
            _, first, count = np.unique(words.hash[plain], return_index=True, return_counts=True)
            body = raw.tobytes().lower()
            names = [body[words.start[k] : words.end[k]].decode() for k in plain[first].tolist()]
            inside = np.ones(len(raw), bool)
            inside[words.start] = False
            second = np.flatnonzero(inside & ~W.NOT_ALNUM[raw])
            second = second[second > 0]
            pair = np.bincount(_CLASS[raw[second - 1]] * 37 + _CLASS[raw[second]], minlength=37 * 37)
            seen = np.flatnonzero(pair)
            names += [f" {k}" for k in seen.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(np.concatenate((count, pair[seen])))], ["name", "n"]
            )


def corpus(docs: DataFrame, text_col: str = "text", dictionary: int = DICTIONARY) -> Corpus:
    """Count words and transitions over all texts; the driver gets the most frequent words only."""
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_statistics, "name string, n long")
    counts = written(rows.groupBy("name").agg(F.sum("n").alias("n")), "word-counts")
    pair = F.startswith("name", F.lit(" "))
    top = counts.where(~pair).orderBy(F.desc("n"), "name").limit(dictionary).collect()
    table = np.ones((37, 37))  # one added to each of the 37 * 37 counts
    for r in counts.where(pair).collect():  # at most 37 * 37 rows
        table[divmod(int(r["name"]), 37)] += r["n"]
    return Corpus(frozenset(r["name"] for r in top), np.log(table / table.sum(1, keepdims=True)))


@dataclass
class Candidate:
    start: int
    stop: int
    kind: str
    value: str
    features: list[float]
    label: int | None


def _coverage(value: str, known: frozenset[str]) -> float:
    """Share of the characters inside dictionary words, longest first from the left."""
    text, at, covered = value.lower(), 0, 0
    while at < len(text):
        for n in range(min(12, len(text) - at), 3, -1):
            if text[at : at + n] in known:
                covered += n
                at += n
                break
        else:
            at += 1
    return covered / len(text)


def _entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _kinds(value: str) -> str:
    return "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" for c in value)


def describe(text: str, start: int, stop: int, path: str, known: Corpus) -> list[float]:
    """The features of a candidate, in the order of ``FEATURES``."""
    value, kinds = text[start:stop], _kinds(text[start:stop])
    n = len(value)
    classes = _CLASS[np.frombuffer(value.encode("latin-1", "replace"), np.uint8)]
    before, after = text[max(0, start - 48) : start], text[stop : stop + 24]
    near = _WORD.findall(before)[-1:]
    bucket = zlib.crc32(near[0].lower().encode()) % WORD_BUCKETS if near else -1
    place = zlib.crc32(path.encode()) % PATH_BUCKETS
    return [
        float(n),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(n - 1, 1),
        float(known.pairs[classes[:-1], classes[1:]].mean()) if n > 1 else 0.0,
        _entropy(value),
        kinds.count("0") / n,
        kinds.count("A") / n,
        len(set(value)) / n,
        sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        _coverage(value, known.dictionary),
        float(before[-1:] in "\"'" and before != "" and after[:1] in "\"'" and after != ""),
        float(_ASSIGNED.search(before) is not None),
        float(any(map(bool, (_NEAR.search(before), _NEAR.search(after), _IN_URL.search(before))))),
        float(re.search(r"(?i)test|example|sample|doc|fixture", path) is not None),
        *(float(place == k) for k in range(PATH_BUCKETS)),
        *(float(bucket == k) for k in range(WORD_BUCKETS)),
    ]


def known_label(text: str, start: int, stop: int) -> int | None:
    """1 for formats that only secrets have, 0 for what is surely none, else unknown.

    Secrets: issued key formats; random hexadecimal or mixed values that a telling name is
    assigned or that stand for the password in an address. No secrets: letters of one case or capitalised, numbers, one character again
    and again, words joined by hyphens or underscores.
    """
    value, before = text[start:stop], text[max(0, start - 48) : start]
    if _FORMATS.fullmatch(value):
        return 1
    kinds = set(_kinds(value))
    if kinds <= {"a", "-"} or kinds <= {"A", "-"} or kinds <= {"0", "-"} or len(set(value)) < 5:
        return 0
    if value.isalpha() and value[1:].islower():
        return 0
    if _ASSIGNED.search(before) and (_NEAR.search(before) or _IN_URL.search(before)) and (_HEX.fullmatch(value) or len(kinds) >= 3):
        return 1
    return None


def _assigned(text: str) -> list[tuple[int, int]]:
    """Spans of the values that telling names are assigned, in order and apart.

    A value that is itself a name with a value gives way to it; a further assignment inside a
    value belongs to it unless a delimiter of addresses comes before.
    """
    named = []
    for sep in _SEPARATOR.finditer(text):
        name = _NAME.search(text, max(0, sep.start() - 80), sep.start())
        if name and _KEY.search(name[1]):
            named.append((name.start(), sep.end()))
    spans, bound = [], len(text)
    for start, after in reversed(named):
        if not (value := _VALUE.match(text, after, bound)) and not spans:
            continue
        if value is None:  # short before the next name: one value with it, or none
            short = _SHORT.match(text, after, bound)
            if short is None or short.end() < bound or text[bound - 1] in "&|?":
                continue
            value = short
        first, last = value.span(1)
        if last == bound < len(text) and text[last - 1] not in "&|?":
            last = spans.pop()[1]
        elif last == bound < len(text):
            last -= 1
        if text[last - 1] in ")]}" and not _OPENING.search(text, first, last):  # closing brackets are not the value's
            while last > first and text[last - 1] in ")]}":
                last -= 1
        if last - first >= 8:
            spans.append((first, last))
            bound = start
    return spans[::-1]


def candidates(text: str | None, path: str | None, known: Corpus) -> list[Candidate]:
    """All candidates of a text in order. They overlap only where a value holds tokens besides other characters.

    A null or empty text has none.
    """
    out, text = [], text or ""
    taken = _assigned(text)
    spans = {m.span(1): "url" for m in _URL.finditer(text)} | dict.fromkeys(taken, "assigned")
    for found in _TOKEN.finditer(text):
        start, stop = found.span()
        near = bisect_left(taken, (stop,))  # the last value that begins before the token ends
        if near == 0 or taken[near - 1][1] <= start or not _KEY_CHARS.fullmatch(text, *taken[near - 1]):
            spans.setdefault((start, stop), "token")
    for (start, stop), kind in sorted(spans.items(), key=lambda span: (span[0][0], -span[0][1])):
        value = text[start:stop]
        kind = "key_format" if _FORMATS.fullmatch(value) else kind
        features = describe(text, start, stop, path or "", known)
        out.append(Candidate(start, stop, kind, value, features, known_label(text, start, stop)))
    return out


def _apart(found: list[tuple[Candidate, float]]) -> list[tuple[Candidate, float]]:
    """Findings that overlap become one: that with the first start, up to the last end."""
    out: list[tuple[Candidate, float]] = []
    for c, votes in found:
        if out and c.start < out[-1][0].stop:
            first, most = out[-1]
            if c.stop > first.stop:
                value = first.value + c.value[first.stop - c.start :]
                first = replace(first, stop=c.stop, value=value)
            out[-1] = first, max(most, votes)
        else:
            out.append((c, votes))
    return out


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: feature (-1 at leaves), threshold, child if above, vote; a child if below follows its node."""

    trees: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]

    def votes(self, features: np.ndarray) -> np.ndarray:
        """Share of the trees that vote for a secret."""
        total = np.zeros(len(features))
        for feature, threshold, above, vote in self.trees:
            at = np.zeros(len(features), np.int64)
            while (inner := feature[at] >= 0).any():
                which = np.flatnonzero(inner)
                node = at[which]
                low = features[which, feature[node]] <= threshold[node]
                at[which] = np.where(low, node + 1, above[node])
            total += vote[at]
        return total / max(len(self.trees), 1)


def parse_tree(description: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A printed tree as arrays, in the order of printing."""
    feature, threshold, above, vote, opened = [], [], [], [], []
    for line in description.splitlines():
        split = re.search(r"(If|Else) \(feature (\d+) (?:<=|>) (\S+)\)", line)
        leaf = re.search(r"Predict: (\S+)", line)
        if split and split[1] == "If":
            opened.append(len(feature))
            feature.append(int(split[2]))
            threshold.append(float(split[3]))
            above.append(-1)
            vote.append(0.0)
        elif split:
            above[opened.pop()] = len(feature)
        elif leaf:
            feature.append(-1)
            threshold.append(0.0)
            above.append(-1)
            vote.append(float(leaf[1]))
    return np.array(feature), np.array(threshold), np.array(above), np.array(vote)


def train(labelled: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """A forest from labelled findings: columns features (array of double) and label (0 or 1).

    At most ``sample`` findings of either label are used, those with the smallest hashes. None
    if one of the labels is missing.
    """
    picked = []
    for label in (0, 1):
        own = labelled.where(F.col("label") == label).select("features", F.col("label").cast("double").alias("label"))
        picked.append(own.orderBy(F.xxhash64("features"), "features").limit(sample))
    rows = written(picked[0].union(picked[1]).repartition(1).sortWithinPartitions("label", "features"), "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    model = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="vector", featureSubsetStrategy="sqrt"
    ).fit(rows.withColumn("vector", array_to_vector("features")))
    return Forest(tuple(parse_tree(t.toDebugString) for t in model.trees))


def judged(known: Corpus, forest: Forest | None) -> Callable[[str | None, str | None], list[tuple[Candidate, float]]]:
    """A function from text and path to the candidates that stay, with their share of votes."""

    def judge(text: str | None, path: str | None) -> list[tuple[Candidate, float]]:
        found = candidates(text, path, known)
        if not found:
            return []
        if forest is None:
            return _apart([(c, 1.0) for c in found if c.label == 1])
        votes = forest.votes(np.array([c.features for c in found]))
        return _apart([(c, float(v)) for c, v in zip(found, votes, strict=True) if v >= 0.5])

    return judge


def weak_findings(docs: DataFrame, known: Corpus, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Findings that patterns alone can label: features and label, one per distinct candidate and place."""
    source = docs.select(F.col(text_col).alias("text"), F.col(path_col).cast("string").alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                c
                for text, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for c in candidates(text, path, known)
                if c.label is not None
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([c.features for c in found], pa.list_(pa.float64())),
                    pa.array([c.label for c in found], pa.int32()),
                ],
                ["features", "label"],
            )

    return source.mapInArrow(run, "features array<double>, label int")


def fit(docs: DataFrame, text_col: str = "text", path_col: str = "source") -> tuple[Corpus, Forest | None]:
    """Corpus statistics, and a forest from the findings that patterns can label."""
    known = corpus(docs, text_col)
    return known, train(written(weak_findings(docs, known, text_col, path_col), "findings"))


def find_secrets(
    docs: DataFrame,
    known: Corpus,
    forest: Forest | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
) -> DataFrame:
    """One row per secret: ``id_col``, start, stop (code points), kind, value_sha256, votes.

    Whole texts; null and empty texts have none, a null path is an empty one, null ids and
    repeated rows give rows of their own. Without a forest (no labels to learn from) the
    known formats stay. Votes of exactly one half keep a candidate.
    """
    source = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(path_col).cast("string").alias("path")
    )
    kind = source.schema["id"].dataType.simpleString()
    judge = judged(known, forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (k, c.start, c.stop, c.kind, hashlib.sha256(c.value.encode()).hexdigest(), votes)
                for k, (text, path) in enumerate(
                    zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
                )
                for c, votes in judge(text, path)
            ]
            at, start, stop, kinds, digest, votes = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array(start, pa.int64()),
                    pa.array(stop, pa.int64()),
                    pa.array(kinds, pa.string()),
                    pa.array(digest, pa.string()),
                    pa.array(votes, pa.float64()),
                ],
                [id_col, "start", "stop", "kind", "value_sha256", "votes"],
            )

    return source.mapInArrow(
        run, f"`{id_col}` {kind}, start long, stop long, kind string, value_sha256 string, votes double"
    )


def redact(
    docs: DataFrame, known: Corpus, forest: Forest | None, text_col: str = "text", path_col: str = "source"
) -> DataFrame:
    """All rows and columns, each secret in the text replaced by ``MASK``; other texts stay as they are."""
    text_at, path_at = docs.columns.index(text_col), docs.columns.index(path_col)
    judge = judged(known, forest)

    def masked(text: str | None, path) -> str | None:
        for c, _ in reversed(judge(text, None if path is None else str(path))):
            text = text[: c.start] + MASK + text[c.stop :]
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = map(masked, batch.column(text_at).to_pylist(), batch.column(path_at).to_pylist())
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
