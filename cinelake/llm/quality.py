"""Quality rules on repetition: how much of a text lies inside n-grams and lines that it has already said.

Word windows of several lengths are compared by rolling hashes in numpy, text by text; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cinelake.llm.texts import Spans, Words, cover, mix, repeated, runs, sums_by

#: The largest share of a text's word characters inside n-grams that occurred earlier in it, by n.
NGRAM_SHARES = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
LINE_SHARE, LINE_CHAR_SHARE = 0.30, 0.20
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "kept boolean, repeat_char_share double, dup_line_char_share double"
)


def _measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    words = Words(data, offsets)
    n_texts = len(offsets) - 1
    starts_char = (data & 0xC0) != 0x80
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(words.inside & starts_char, out=chars[1:])
    n_words = np.diff(words.bounds)
    word_chars = chars[offsets[1:]] - chars[offsets[:-1]]
    lengths = chars[words.ends] - chars[words.starts]

    spans = Spans(words.hashes)
    salt = mix(words.text.astype(np.uint64) + np.uint64(1))
    failed = np.zeros(n_texts, bool)
    worst = np.zeros(n_texts)
    repeat_words = np.zeros(n_texts, np.int64)
    # a longer n-gram repeats only where the shorter one at its start does, so each length is looked for among those left
    alive = np.arange(len(words.hashes))
    for n in sorted({*NGRAM_SHARES, WINDOW}):
        whole = alive[alive + n <= len(words.hashes)]
        whole = whole[words.text[whole + n - 1] == words.text[whole]]
        both, later = repeated(spans.of(whole, whole + n) ^ salt[whole])
        alive = whole[both]
        if n == WINDOW:
            repeat_words = sums_by(cover(alive, n, len(words.hashes)), words.bounds)
        if n in NGRAM_SHARES:
            share = sums_by(cover(whole[later], n, len(words.hashes)) * lengths, words.bounds) / np.maximum(word_chars, 1)
            worst = np.maximum(worst, share)
            failed |= share > NGRAM_SHARES[n]

    cuts = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    line_texts = np.searchsorted(offsets, line_starts, "right") - 1
    real = (line_starts < len(data)) & (line_texts < n_texts)
    line_starts, line_texts = line_starts[real], line_texts[real]
    at = np.searchsorted(cuts, line_starts)
    next_cut = np.append(cuts, len(data))[at]
    line_ends = np.minimum(next_cut, offsets[line_texts + 1])
    full = np.searchsorted(words.starts, line_ends) > np.searchsorted(words.starts, line_starts)
    line_starts, line_ends, line_texts = line_starts[full], line_ends[full], line_texts[full]
    _, again = repeated(words.bytes.of(line_starts, line_ends) ^ mix(line_texts.astype(np.uint64) + np.uint64(1)))
    n_lines = np.bincount(line_texts, minlength=n_texts)
    dup_lines = np.bincount(line_texts[again], minlength=n_texts)
    dup_chars = np.bincount(line_texts[again], weights=(chars[line_ends] - chars[line_starts])[again], minlength=n_texts) / np.maximum(word_chars, 1)
    failed |= (dup_lines > 1) & ((dup_lines > LINE_SHARE * n_lines) | (dup_chars > LINE_CHAR_SHARE))

    base_failed = (n_words < LEAST_WORDS) | (100 * repeat_words > MOST_REPEATED * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": sums_by(_SYMBOL[data], offsets), "n_dup_lines": dup_lines, "n_repeat_words": repeat_words,
        "base_failed": base_failed, "kept": ~base_failed & ~failed, "repeat_char_share": worst, "dup_line_char_share": dup_chars,
    }


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, data, offsets in runs(batch.column(1)):
            found = _measure(data, offsets)
            yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(first, len(offsets) - 1), **found})


def repetition_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and the verdict for every row of `docs`, whole texts, one row each, repeated rows included.

    A text is kept if it has at least 20 words, at most 30 % of them inside 8-word windows found twice or more, and no share above
    `NGRAM_SHARES` (characters inside n-grams that occurred earlier, the first occurrence not counted) or, with two or more repeated
    lines, above the line shares.
    A null text has no words and fails; a null id stays null; other columns are ignored.
    """
    return docs.select(docs[doc_id].cast("bigint"), docs[text]).mapInArrow(_batches, SCHEMA)
