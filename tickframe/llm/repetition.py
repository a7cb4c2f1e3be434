"""Quality rules from repetition: characters inside duplicated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickframe.llm import words as W

#: Fixed published limits, in hundredths of a text's word characters. For short n-grams: what the
#: repeats of the single most repetitive one may make up. For long ones: what may lie inside n-grams
#: seen before. First occurrences never count, so a header that comes back once as a footer stays
#: below in all but the shortest texts; the limits fall with the length, so that each can decide.
TOP_LIMITS = {2: 20, 3: 18, 4: 16}
GRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Likewise for lines equal to an earlier one: share of lines, share of characters.
LINE_LIMIT, LINE_CHAR_LIMIT = 50, 30
#: The base rule: fewest words, window, share of words in repeated windows.
LEAST_WORDS, BASE_WINDOW, BASE_LIMIT = 20, 8, 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

MEASURES = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "base_failed": "boolean",
    "kept": "boolean",
    "n_lines": "long",
    "dup_line_chars": "long",
    **{f"top_chars_{n}": "long" for n in TOP_LIMITS},
    **{f"dup_chars_{n}": "long" for n in GRAM_LIMITS},
}


def _lines(raw: np.ndarray, at: np.ndarray, words: W.Words, chars: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per row: lines with a word, how many equal an earlier one, and the characters of these."""
    rows = len(at) - 1
    breaks = np.flatnonzero(raw == 10)
    # a row's lines begin where the row begins and after each of its line ends
    start = np.concatenate((breaks + 1, at[:-1]))
    row = np.concatenate((np.searchsorted(at, breaks, "right") - 1, np.arange(rows)))
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = at[row + 1]
    followed = np.flatnonzero(row[1:] == row[:-1])
    end[followed] = start[followed + 1] - 1
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, row = start[filled], end[filled], row[filled]
    keys = W.mix(W.span_hashes(raw, start, end) + row.astype(W.U64) * W.GRAM)
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    size = chars[end] - chars[start]
    count = lambda mask, weight=None: np.bincount(row[mask], weight, rows).astype(np.int64)
    return count(slice(None)), count(same), count(same, size[same])


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """All measures and both verdicts for a column of texts."""
    parts = []
    for _, _, raw, at in W.chunks(column):
        rows = len(at) - 1
        words, chars = W.split(raw, at), W.code_points(raw)
        size = chars[words.end] - chars[words.start]
        out = {"n_words": words.per_row(), "word_chars": W.row_sums(size, words.first)}
        out["n_symbols"] = W.row_sums(_SYMBOL[raw], at)
        out["n_lines"], out["n_dup_lines"], out["dup_line_chars"] = _lines(raw, at, words, chars)

        def covered(starts: np.ndarray, n: int, weight: np.ndarray | None) -> np.ndarray:
            depth = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(depth, starts, 1)
            np.subtract.at(depth, starts + n, 1)
            inside = np.cumsum(depth[:-1]) > 0
            return W.row_sums(inside if weight is None else np.where(inside, weight, 0), words.first)

        # a repeated window of n + 1 words begins with a repeated window of n words
        least = min(TOP_LIMITS)
        before = np.concatenate(([0], np.cumsum(size)))
        starts, rolling = W.grams(words, least)
        for n in range(least, max(GRAM_LIMITS) + 1):
            if n > least:
                fits = starts + n <= len(words.hash)
                starts, rolling = starts[fits], rolling[fits]
                fits = words.row[starts] == words.row[starts + n - 1]
                starts, rolling = starts[fits], rolling[fits]
                rolling = rolling * W.GRAM + words.hash[starts + n - 1]
            keys = W.mix(rolling + words.row[starts].astype(W.U64) * W.GRAM)
            twice, later = W.occurrences(keys)
            if n in TOP_LIMITS:
                _, first, count = np.unique(keys[twice], return_index=True, return_counts=True)
                first = starts[twice][first]
                out[f"top_chars_{n}"] = np.zeros(rows, np.int64)
                again = (count - 1) * (before[first + n] - before[first])
                np.maximum.at(out[f"top_chars_{n}"], words.row[first], again)
            else:
                out[f"dup_chars_{n}"] = covered(starts[later], n, size)
            starts, rolling = starts[twice], rolling[twice]
            if n == BASE_WINDOW:
                out["n_repeat_words"] = covered(starts, n, None)
        n_words, chars_in = out["n_words"], out["word_chars"]
        out["base_failed"] = (n_words < LEAST_WORDS) | (100 * out["n_repeat_words"] > BASE_LIMIT * n_words)
        rejected = out["base_failed"] | (100 * out["n_dup_lines"] > LINE_LIMIT * out["n_lines"])
        rejected |= 100 * out["dup_line_chars"] > LINE_CHAR_LIMIT * chars_in
        for n, limit in TOP_LIMITS.items():
            rejected |= 100 * out[f"top_chars_{n}"] > limit * chars_in
        for n, limit in GRAM_LIMITS.items():
            rejected |= 100 * out[f"dup_chars_{n}"] > limit * chars_in
        out["kept"] = ~rejected
        assert all(len(v) == rows for v in out.values())
        parts.append(out)
    empty = {k: np.zeros(0, bool if t == "boolean" else np.int64) for k, t in MEASURES.items()}
    return {k: np.concatenate([empty[k], *(p[k] for p in parts)]) for k in MEASURES}


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repetition measures and verdict of every text: ``id_col`` and the columns of ``MEASURES``.

    Whole texts, row by row: nulls in ``id_col`` and repeated rows come back as they are,
    null and empty texts have no words and fail the base rule, other columns are not read.
    ``kept`` is false if the base rule fails or a duplicated share is above its limit; a
    share exactly at its limit passes.
    """
    source = docs.select(docs[id_col], docs[text_col])
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], [id_col, *found])

    return source.mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{k} {t}" for k, t in MEASURES.items())]))


def drop_repetitive(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, all columns, whose text passes; decided row by row, so no key is needed.

    Null, empty and short texts fail the base rule and go; repeated rows stay or go together.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(measure(batch.column(place))["kept"]))

    return docs.mapInArrow(run, docs.schema)
