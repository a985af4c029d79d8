"""Token ids of whole texts, equal to what the tokenizer gives for each text at once, but faster.

The tokenizer first splits a text and never joins what a single blank or line break between two other characters
separates. So a text is cut there, equal pieces of a chunk are encoded once, and pieces seen before are looked up in
a bounded memory. New pieces are encoded together, those of ASCII and Latin characters by the faster of the two
libraries that read this vocabulary. A text with any other white space (doubled, leading, trailing, tabs, …) is one
piece and goes to the tokenizer as it is. Pieces are told apart by a 64-bit hash.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd

from statloom.llm.text import LASTING, SliceHash

REMEMBERED = 600_000  # pieces kept per Python worker, some 30 MB

_FAST = re.compile("[\\x21-\\x7e\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f \n]*")
_BAD = np.zeros(256, bool)
_BAD[[0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20)]] = True


def default_tokenizer() -> str:
    """The public byte-level vocabulary; its place is asked for on the machine that tokenizes."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _marked(size: int, *places: np.ndarray) -> np.ndarray:
    out = np.zeros(size, bool)
    for some in places:
        out[some] = True
    return out


def _cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start, and which texts are a single piece because of other white space."""
    blank = (data == 0x20) | (data == 0x0A)
    at = np.flatnonzero(blank)
    bad = [np.flatnonzero(_BAD[data])]
    if len(at):
        after = np.minimum(at + 1, len(data) - 1)
        edge = _marked(len(data) + 1, offsets)
        first, last = edge[at], edge[at + 1]
        bad.append(at[first | last | blank[after]])
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    a, b, c = padded[lead], padded[lead + 1], padded[lead + 2]
    white = (((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80))
             | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
             | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)))
    bad.append(lead[white])
    single = np.zeros(len(offsets) - 1, bool)
    # the text that holds a byte is the last one that starts at or before it, empty texts aside
    single[np.searchsorted(offsets, np.concatenate(bad), side="right") - 1] = True
    if single.any():
        at = at[~single[np.searchsorted(offsets, at, side="right") - 1]]
    return at, single


class Encoder:
    """Encodes the texts of a chunk to unsigned 32-bit ids."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        path = path or default_tokenizer()
        self.tokenizer = Tokenizer.from_file(path)
        self.byte_lengths = np.array([len(self.tokenizer.id_to_token(i) or "")
                                      for i in range(self.tokenizer.get_vocab_size())], np.int64)
        self.ranks = None
        if os.path.exists(ranks := path.removesuffix(".json") + ".tiktoken"):
            from public_tokenizers import PATTERN
            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        self.keys = np.zeros(0, np.uint64)      # hashes of known pieces, sorted
        self.place = np.zeros(0, np.int64)      # where each one's ids start
        self.sizes = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, parts: list[str]) -> list[np.ndarray] | None:
        """Ids of pieces that can follow one another; a line break before a text's first piece is taken off again."""
        joined = np.array(self.ranks.encode_ordinary("".join(parts)), np.uint32)
        ends = np.cumsum(self.byte_lengths[joined])
        wanted = np.cumsum(np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts)))
        stops = np.searchsorted(ends, wanted, side="right")
        if not len(ends) or not np.array_equal(ends[stops - 1], wanted):
            return None
        edges = [0, *stops.tolist()]
        return [joined[a:b] for a, b in zip(edges, edges[1:])]

    def _encode_new(self, pieces: list[str], single: np.ndarray) -> list[np.ndarray]:
        found: list[np.ndarray | None] = [None] * len(pieces)
        fast = [n for n, p in enumerate(pieces) if self.ranks and not single[n] and "<|" not in p and _FAST.fullmatch(p)]
        for lot in range(0, len(fast), 20_000):
            some = fast[lot:lot + 20_000]
            first = [pieces[n][0] not in " \n" for n in some]
            ids = self._together(["\n" + pieces[n] if f else pieces[n] for n, f in zip(some, first)])
            for n, f, x in zip(some, first, ids or ()):
                found[n] = x[1:] if f else x
        slow = [n for n, x in enumerate(found) if x is None]
        for n, x in zip(slow, self._whole([pieces[n] for n in slow])):
            found[n] = x
        return found

    def _append(self, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(self.used + len(ids), np.uint32)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in ``data`` (none without ``ids``), and where each text's ids begin (one more at the end)."""
        filled = offsets[:-1][np.diff(offsets) > 0]
        if not len(filled):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cuts, single = _cuts(data, offsets)
        start = np.flatnonzero(_marked(len(data), filled, cuts))
        end = np.append(start[1:], len(data))
        piece, hashes = pd.factorize(SliceHash(data)(start, end))  # numbered as they come
        shown = np.flatnonzero(np.diff(np.maximum.accumulate(piece), prepend=-1))

        at = np.searchsorted(self.keys, hashes)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == hashes[known]
        place, sizes = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int32)
        place[known], sizes[known] = self.place[at[known]], self.sizes[at[known]]
        new = np.flatnonzero(~known)
        kept, lasting = self.used, np.zeros(0, np.int64)
        if len(new):
            begin, stop = start[shown[new]], end[shown[new]]
            alone = single[np.searchsorted(offsets, begin, side="right") - 1]
            raw = data.tobytes()
            found = self._encode_new([raw[a:b].decode("utf-8", "replace") for a, b in zip(begin.tolist(), stop.tolist())],
                                     alone)
            order = np.argsort(alone, kind="stable")  # single texts last, as they aren't remembered
            lengths = np.fromiter((len(found[n]) for n in order), np.int64, len(order))
            starts = self.used + np.cumsum(lengths) - lengths
            place[new[order]], sizes[new[order]] = starts, lengths
            self._append(np.concatenate([found[n] for n in order]))
            room = max(0, REMEMBERED - len(self.keys))
            lasting = new[order[:min(room, int((~alone).sum()))]]
            if len(lasting):
                kept = int(place[lasting[-1]] + sizes[lasting[-1]])

        counts = sizes[piece].astype(np.int64)
        ends = np.cumsum(counts)
        out = self.flat[np.repeat(place[piece] - (ends - counts), counts) + np.arange(ends[-1])] if ids else np.zeros(0, np.uint32)
        before = np.concatenate([[0], ends])[np.searchsorted(start, offsets)]
        self.used = kept
        if len(lasting):
            lasting = lasting[np.argsort(hashes[lasting])]
            where = np.searchsorted(self.keys, hashes[lasting])
            self.keys = np.insert(self.keys, where, hashes[lasting])
            self.place = np.insert(self.place, where, place[lasting])
            self.sizes = np.insert(self.sizes, where, sizes[lasting])
        return out, before


@lru_cache(maxsize=1)
def encoder(path: str | None = None) -> Encoder:
    """One encoder per Python worker, so what it remembers lasts from task to task, until one that has no use for it."""
    return Encoder(path)


LASTING.append(encoder)
