"""The lexemes of a text with their positions, found inside Arrow batches without moving a word between tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from larder.functions.text import MAX_POSITION, MAX_POSITIONS, parts, word_counts


def _postings(ids: pa.Array, lists: pa.Array, limits: bool) -> pa.RecordBatch:
    sizes = word_counts(lists)
    words = lists.flatten().dictionary_encode()
    codes = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    known = (codes >= 0) & (codes != words.dictionary.index("").as_py())  # '' marks a stop word
    if limits:
        at = np.minimum(at + 1, MAX_POSITION)
    n, span = max(1, len(words.dictionary)), int(at.max(initial=0)) + 1
    # one number each: row, lexeme, position
    keys = np.sort(((row * n + codes) * span + at)[known])
    if limits:
        keys = keys[np.diff(keys, prepend=-1) != 0]
    groups = keys // span
    first = np.flatnonzero(np.diff(groups, prepend=-1) != 0)
    if limits:
        lengths = np.diff(first, append=len(keys))
        keys = keys[np.arange(len(keys)) - np.repeat(first, lengths) < MAX_POSITIONS]
        groups = keys // span
        first = np.flatnonzero(np.diff(groups, prepend=-1) != 0)
    heads = groups[first]
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(keys)).astype(np.int32)), pa.array((keys % span).astype(np.int32)))
    return pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(heads % n)), ids.take(pa.array(heads // n)), positions], names=["lexeme", "id", "at"])


def posting_batches(limits: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over (id, tokens): a row per lexeme of a text with its ascending positions.

    Positions start at 0 and are whole; with ``limits`` they start at 1 and keep the limits of a stored text vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("id"), batch.column("tokens")
            for start, length in parts(lists):
                yield _postings(ids.slice(start, length), lists.slice(start, length), limits)

    return run
