"""Hashed words and character n-grams of words."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from statloom.llm.text import SliceHash, Words

_EDGE = 1  # stands before and after each word, so that n-grams at its ends differ from those inside


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, …`` (``counts[0]`` values), then the same for the next, and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def subword_buckets(words: Words, which: np.ndarray, sizes: Sequence[int], buckets: int,
                    whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams in bytes of the chosen words, and for each the position in ``which``.

    With ``whole`` a bucket for the word itself comes on top; without it only a word too short for any n-gram has one.
    """
    lengths = words.end[which] - words.start[which]
    total = int(lengths.sum() + 2 * len(lengths))
    begin = np.cumsum(lengths + 2) - lengths - 2
    data = np.full(total, _EDGE, np.uint8)
    data[ragged(begin + 1, lengths)] = words.data[ragged(words.start[which], lengths)]
    owner = np.repeat(np.arange(len(which), dtype=np.int32), lengths + 2)
    stop = (begin + lengths + 2)[owner]
    slices = SliceHash(data)
    itself = np.arange(len(which), dtype=np.int32)
    if not whole:
        itself = itself[lengths + 2 < min(sizes)]
    found, owners = [slices(begin[itself], (begin + lengths + 2)[itself]) % np.uint64(buckets)], [itself]
    for size in sizes:
        at = np.flatnonzero(np.arange(total) + size <= stop)
        found.append(slices(at, at + size) % np.uint64(buckets))
        owners.append(owner[at])
    return np.concatenate(found).astype(np.int32), np.concatenate(owners)
