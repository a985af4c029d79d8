"""License scans: an exact set-similarity join of text blocks with license templates.

A window of a document's words is twice as wide as the template's text. It matches if it holds at least ``percent`` of the
template's distinct tokens and all of its ``obligatory`` ones, as those that name the license. With ``every_start`` it starts at every word, and matching windows that overlap are one block,
so a label does not depend on how many words stand before a notice; without, it starts at multiples of half its width
only and is a block by itself. The join is exact: tokens are put in the order of their frequency over all documents,
rarest first; a match must hold one of the first ``|T| - need + 1`` tokens of a template (prefix), have ``need`` template
tokens at all (length), and leave enough tokens on both sides behind its first common one (position, which the prefix
implies for windows at every start). Only windows that pass are compared. Templates are a short fixed list and travel with
the code; documents never leave their task.

Apart from that, fixed phrases are looked for as consecutive words.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.text import Words, chunks, split, utf8, words_of

# Phrases and the labels they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices as their licenses word them.
TEMPLATES = (
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

# The tokens without which a notice is that of another license, or none, per template. Short notices need
# all their words but one that may well be left out.
IDENTIFYING = ("gnu general public license licensed 3", "gnu general public", "licensed under apache license version 2 0", "apache 2 0",
               "licensed cc by nc 4 0", "creative commons attribution license 4 0", "released under mit license", "", "", "", "mozilla 2 0")


@dataclass(frozen=True)
class LicensePlan:
    templates: Sequence[tuple[str, str]] = TEMPLATES
    phrases: Mapping[str, str] = None
    percent: int = 80
    every_start: bool = False
    obligatory: Sequence[str] = ()  # per template, tokens that a window must hold in any case


#: Every block of a text, wherever it starts, and none of another license.
WHOLE = LicensePlan(every_start=True, obligatory=IDENTIFYING)


def _hashed(text: str) -> np.ndarray:
    raw = text.encode()
    return split(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), alphanumeric=True).hashes()


class _Templates:
    """Token ids, and per template its width, its tokens in global order, and the bit of each token id."""

    def __init__(self, plan: LicensePlan):
        self.plan = plan
        texts = [_hashed(text) for _, text in plan.templates]
        if any(len(t) == 0 or len(np.unique(t)) > 64 for t in texts):
            raise ValueError("a template has 1 to 64 distinct tokens")
        self.vocabulary = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint64)
        self.widths = [2 * len(t) for t in texts]
        self.tokens = [np.searchsorted(self.vocabulary, np.unique(t)) for t in texts]
        obligatory = [np.unique(_hashed(text)) for text in plan.obligatory] or [np.zeros(0, np.uint64)] * len(texts)
        if len(obligatory) != len(texts) or any(not np.isin(o, t).all() for o, t in zip(obligatory, texts)):
            raise ValueError("obligatory tokens are listed per template, and it holds them")
        self.obligatory = [np.searchsorted(self.vocabulary, o) for o in obligatory]
        phrases = PHRASES if plan.phrases is None else plan.phrases
        self.phrases = [(_hashed(p), label) for p, label in phrases.items()]

    def order_by(self, frequency: np.ndarray) -> None:
        """Rank the tokens by ``frequency``, ties by hash."""
        self.rank = np.empty(len(self.vocabulary), np.int64)
        self.rank[np.lexsort((self.vocabulary, frequency))] = np.arange(len(self.vocabulary))
        self.tokens = [t[np.argsort(self.rank[t])] for t in self.tokens]
        self.need = [-(-len(t) * self.plan.percent // 100) for t in self.tokens]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The token id of each word, or the size of the vocabulary."""
        at = np.searchsorted(self.vocabulary, hashes)
        other = at == len(self.vocabulary)
        other[~other] = self.vocabulary[at[~other]] != hashes[~other]
        at[other] = len(self.vocabulary)
        return at


def _candidates(words: Words, ids: np.ndarray, prefix: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of the windows that hold a word of ``prefix``, without repetition."""
    hit = np.flatnonzero(np.isin(ids, prefix))
    if not len(hit):
        return hit, hit
    text = np.searchsorted(words.first, hit, side="right") - 1
    step, inside = width // 2, hit - words.first[text]
    begin = []
    for back in (0, 1):  # each word lies in two windows
        at = inside // step - back
        begin.append((words.first[text] + at * step)[at >= 0])
    begin = np.unique(np.concatenate(begin))
    return begin, np.minimum(begin + width, words.first[np.searchsorted(words.first, begin, side="right")])


def _matches(words: Words, ids: np.ndarray, templates: _Templates) -> list[tuple[int, int, int, float]]:
    """(template, first word, end, containment) of every matching block of the chunk."""
    found = []
    for n, (tokens, need, width) in enumerate(zip(templates.tokens, templates.need, templates.widths)):
        begin, end = _candidates(words, ids, tokens[:len(tokens) - need + 1], width)
        if not len(begin):
            continue
        bits = np.zeros(len(templates.vocabulary) + 1, np.uint64)  # the rarest token has the lowest bit
        bits[tokens] = np.uint64(1) << np.arange(len(tokens), dtype=np.uint64)
        size = end - begin
        place = np.cumsum(size) - size
        word = np.arange(int(size.sum())) + np.repeat(begin - place, size)
        held = np.bitwise_or.reduceat(bits[ids[word]], place)
        # length: enough words at all; position: enough of the template behind the first common token
        lowest = np.bitwise_count((held & (~held + np.uint64(1))) - np.uint64(1))
        must = np.bitwise_or.reduce(bits[templates.obligatory[n]], initial=np.uint64(0))
        able = np.flatnonzero((size >= need) & (len(tokens) - lowest.astype(np.int64) >= need) & (held & must == must))
        common = np.bitwise_count(held[able])
        for k in able[common >= need].tolist():
            found.append((n, int(begin[k]), int(end[k]), int(np.bitwise_count(held[k])) / len(tokens)))
    return found


def _sliding(words: Words, ids: np.ndarray, templates: _Templates) -> list[tuple[int, int, int, float]]:
    """The same over the windows from every word on: (template, first word, end, best containment) of merged blocks.

    A template token counts in the windows from after its previous occurrence, so the number of distinct tokens of all
    windows is a running sum over the places of tokens.
    """
    found = []
    mine = np.zeros(len(templates.vocabulary) + 1, bool)
    for n, (tokens, need, width) in enumerate(zip(templates.tokens, templates.need, templates.widths)):
        hit = np.flatnonzero(np.isin(ids, tokens[:len(tokens) - need + 1]))
        if not len(hit):
            continue
        mine[:] = False
        mine[tokens] = True
        place = np.flatnonzero(mine[ids])
        # length: enough template tokens in the windows that hold the hit
        text = np.searchsorted(words.first, hit, side="right") - 1
        low = np.searchsorted(place, np.maximum(hit - width + 1, words.first[text]))
        high = np.searchsorted(place, np.minimum(hit + width, words.first[text + 1]))
        near = high - low >= need
        if not near.any():
            continue
        edge = np.bincount(low[near], minlength=len(place) + 1) - np.bincount(high[near], minlength=len(place) + 1)
        place = place[np.cumsum(edge)[:-1] > 0]
        start = words.first[np.searchsorted(words.first, place, side="right") - 1]
        # each place counts for the starts in [since, place]
        order = np.lexsort((place, ids[place]))
        before = np.full(len(place), -1)
        same = ids[place[order[1:]]] == ids[place[order[:-1]]]
        before[order[1:][same]] = place[order[:-1][same]]
        since = np.maximum(np.maximum(before + 1, place - width + 1), start)
        at, step = np.unique(np.concatenate([since, place + 1]), return_inverse=True)
        opened, closed = step[:len(place)], step[len(place):]

        def running(some: np.ndarray | slice) -> np.ndarray:
            return np.cumsum(np.bincount(opened[some], minlength=len(at)) - np.bincount(closed[some], minlength=len(at)))

        held, must = running(slice(None)), templates.obligatory[n]
        # the starts from at[k] to before at[k + 1]
        able = np.flatnonzero((held >= need) & (running(np.isin(ids[place], must)) == len(must)))
        if not len(able):
            continue
        first, last = at[able], at[able + 1] - 1
        text = np.searchsorted(words.first, first, side="right") - 1
        end = np.minimum(last + width, words.first[text + 1])
        new = np.ones(len(able), bool)
        new[1:] = first[1:] >= end[:-1]  # ends ascend with starts, and none is beyond its text
        opens = np.flatnonzero(new)
        closes = np.append(opens[1:], len(able)) - 1
        best = np.maximum.reduceat(held[able], opens)
        for k in range(len(opens)):
            found.append((n, int(first[opens[k]]), int(end[closes[k]]), int(best[k]) / len(tokens)))
    return found


def _frequencies(docs: DataFrame, plan: LicensePlan) -> np.ndarray:
    """How often each template token stands in all documents."""
    templates = _Templates(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(templates.vocabulary) + 1, np.int64)
        for chunk in chunks(batches, "_bytes"):
            total += np.bincount(templates.ids(words_of(chunk, "_bytes", alphanumeric=True).hashes()), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["token", "n"])

    counts = docs.select(utf8("text").alias("_bytes")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    out = np.zeros(len(templates.vocabulary), np.int64)
    for row in counts.collect():  # a row per template token
        if row["token"] < len(out):
            out[row["token"]] = row["n"]
    return out


RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "blocks array<struct<label: string, first_word: long, last_word: long, containment: double>>")


def scan(docs: DataFrame, plan: LicensePlan = LicensePlan()) -> DataFrame:
    """``doc_id`` and ``RESULT`` for every row of ``docs`` (doc_id, text).

    Words are runs of ASCII letters and digits and of other characters, A-Z lower-cased, counted from 0. ``n_base``
    counts the places of phrases, ``first_word`` and ``last_word`` are their least and greatest start (NULL without
    any). ``labels`` has the labels of phrases and of matching blocks, sorted and joined by commas; ``blocks`` the
    blocks themselves (NULL without any). ``score`` is 1 with a phrase, else the best containment of a matching block,
    else 0. A NULL text is empty and has no words; repeated rows give equal results; other columns are ignored.
    """
    templates = _Templates(plan)
    templates.order_by(_frequencies(docs, plan))
    names = ["doc_id", *(c.split()[0] for c in RESULT.split(", ", 7))]
    block = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                                ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "_bytes"):
            words = words_of(chunk, "_bytes", alphanumeric=True)
            hashes, texts = words.hashes(), chunk.num_rows
            n_base, score = np.zeros(texts, np.int64), np.zeros(texts)
            low, high = np.full(texts, np.iinfo(np.int64).max), np.full(texts, -1)
            base: dict[int, set[str]] = {}
            own: dict[int, list] = {}
            for phrase, label in templates.phrases:
                at = np.flatnonzero(hashes[:max(0, len(hashes) - len(phrase) + 1)] == phrase[0])
                for k in range(1, len(phrase)):
                    at = at[hashes[at + k] == phrase[k]]
                text = np.searchsorted(words.first, at, side="right") - 1
                whole = at + len(phrase) <= words.first[text + 1]
                at, text = at[whole], text[whole]
                np.add.at(n_base, text, 1)
                np.minimum.at(low, text, at - words.first[text])
                np.maximum.at(high, text, at - words.first[text])
                for t in np.unique(text).tolist():
                    base.setdefault(t, set()).add(label)
                    score[t] = 1.0
            matches = _sliding if plan.every_start else _matches
            for n, begin, end, containment in matches(words, templates.ids(hashes), templates):
                t = int(np.searchsorted(words.first, begin, side="right")) - 1
                own.setdefault(t, []).append({"label": plan.templates[n][0], "first_word": begin - int(words.first[t]),
                                              "last_word": end - 1 - int(words.first[t]), "containment": containment})
                score[t] = max(score[t], containment)
            labels = [",".join(sorted(base.get(t, set()) | {b["label"] for b in own.get(t, ())})) for t in range(texts)]
            none = n_base == 0
            yield pa.RecordBatch.from_arrays([
                chunk.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(n_base), pa.array(low, mask=none),
                pa.array(high, mask=none), pa.array([",".join(sorted(base.get(t, ()))) for t in range(texts)]),
                pa.array(labels), pa.array(score), pa.array([own.get(t) for t in range(texts)], block)], names)

    return (docs.select(F.col("doc_id").cast("long"), utf8("text").alias("_bytes"))
            .mapInArrow(run, f"doc_id long, {RESULT}"))
