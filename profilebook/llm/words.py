"""Words and word shingles of a batch of texts as numpy arrays (used inside Arrow tasks)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
        0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def split_words(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (runs of anything but U+0020 and U+0009 to U+000D) and how many each text has.

    ``lower`` turns A to Z into a to z and nothing else.  A null text has no words.
    """
    flat: list[bytes] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts.to_pylist()):
        if text:
            raw = text.encode("utf-8", "surrogatepass")
            own = (raw.lower() if lower else raw).split()  # of bytes: ASCII letters and ASCII white space only
            counts[i] = len(own)
            flat.extend(own)
    return pa.array(flat, type=pa.large_binary()), counts


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word of the batch is hashed once."""
    if len(words) == 0:
        return np.zeros(0, dtype=np.uint64)
    coded = words.dictionary_encode()
    distinct = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return distinct[coded.indices.to_numpy(zero_copy_only=False)]


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the word shingles of each text, ascending, and their number by text.

    A text with fewer words than ``width`` has its whole sequence as its one shingle; a text without words has none.
    """
    counts = np.asarray(counts, dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    n = len(hashes)
    with np.errstate(over="ignore"):
        run = np.zeros(max(n - width + 1, 0), dtype=np.uint64)
        for j in range(width):
            run += mix(hashes[j:n - width + 1 + j] + np.uint64(MULT[j])) * np.uint64(MULT[j])
        per = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        owner = np.repeat(np.arange(len(counts)), per)
        first = np.concatenate([[0], np.cumsum(per)])[:-1]
        at = starts[owner] + (np.arange(len(owner)) - first[owner])
        value = np.zeros(len(owner), dtype=np.uint64)
        whole = counts[owner] >= width
        value[whole] = mix(run[at[whole]])
        for k in np.flatnonzero(~whole):
            doc = owner[k]
            x = np.uint64(counts[doc])
            for h in hashes[starts[doc]:starts[doc] + counts[doc]]:
                x = mix(np.array([x * np.uint64(MULT[0]) + h], dtype=np.uint64))[0]
            value[k] = x
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(counts)).astype(np.int64)


def pieces(batch: pa.RecordBatch, column: str, most: int = 1_000_000, most_rows: int = 2_000):
    """Row ranges of a batch that hold about ``most`` bytes of text (a longer text is alone) and at most ``most_rows`` rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and (total + size > most or i - begin >= most_rows):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(size)
    if begin < len(sizes):
        yield batch.slice(begin)
