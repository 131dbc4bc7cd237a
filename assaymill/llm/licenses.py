"""Licence scans: matching statistics on a suffix automaton of licence texts.

All licence templates go into one generalised suffix automaton over words. A
document's words stream through it; after each word the automaton holds the
longest suffix read so far that occurs in some template (the matching
statistics). Where that match cannot be extended it is kept as a maximal match,
and maximal matches that follow one another in the document and in a template,
with small gaps on both sides, are chained into a span. A span's score is the
share of the template's words that it covers.

The automaton is small (a few hundred states) and built in every task; texts are
only read, never shuffled. Words outside the templates' vocabulary reset the
automaton, so numpy finds the stretches that can match at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assaymill.llm.common import bounded_batches, hash_of_text, pieces, text_of, without, words_of

OUTPUT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")

# The phrases that count as base matches, and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Usual notices of public licences, as words.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
]

COVERED = 0.8  # share of a template that makes a label
GAP = 8  # words that may lie between two chained matches, on either side
SHORTEST = 2  # words of the shortest match that is chained
WORDS = np.zeros(256, bool)
WORDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word numbers."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for which, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].add((which, at))
        # A state ends wherever a state that links to it ends.
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(dict(moves))
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, parent: int, symbol: int, child: int) -> int:
        """A state for the strings of ``child`` that follow ``parent``; ``child`` itself if it holds no others."""
        if self.length[child] == self.length[parent] + 1:
            return child
        clone = self._state(self.length[parent] + 1, self.next[child], self.link[child])
        self.link[child] = clone
        while parent >= 0 and self.next[parent].get(symbol) == child:
            self.next[parent][symbol] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol, self.next[last][symbol])
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, symbol, self.next[last][symbol])
        return new

    def step(self, state: int, length: int, symbol: int) -> tuple[int, int]:
        """The longest suffix of the words read so far that occurs in a sequence."""
        while state and symbol not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if symbol in self.next[state]:
            return self.next[state][symbol], length + 1
        return 0, 0


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]) -> None:
        texts = [*phrases, *(text for _, text in templates)]
        names = sorted({w for t in texts for w in t.split()})
        number = {w: k for k, w in enumerate(names)}
        sequences = [[number[w] for w in t.split()] for t in texts]
        self.phrase_labels = list(phrases.values())
        self.sizes = [len(s) for s in sequences]
        self.labels = [*self.phrase_labels, *(label for label, _ in templates)]
        self.automaton = SuffixAutomaton(sequences)
        hashes = np.array([hash_of_text(w) for w in names], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        count, automaton = len(phrases), self.automaton
        self.templates_at = [sorted((t, at) for t, at in ends if t >= count) for ends in automaton.ends]
        # Phrases that end here: whole phrases of this state, and those of the states it links to.
        self.phrases_at: list[list[tuple[int, int]]] = [[] for _ in automaton.ends]
        for state in sorted(range(1, len(automaton.ends)), key=automaton.length.__getitem__):
            link = automaton.link[state]
            whole = [(self.sizes[t], t) for t, at in automaton.ends[state] if t < count and at == self.sizes[t] - 1]
            self.phrases_at[state] = self.phrases_at[link] + [x for x in whole if automaton.length[link] < x[0] <= automaton.length[state]]

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Word numbers, -1 outside the vocabulary."""
        k = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[k] == words, self.numbers[k], -1)

    def read(self, symbols: list[int], first: int, base: list[tuple[int, int]], matches: list[tuple[int, int, int]]) -> None:
        """Stream one stretch: base phrases as (start, phrase), maximal matches as (start, end, state)."""
        automaton, state, length = self.automaton, 0, 0
        for k, symbol in enumerate(symbols):
            new, grown = automaton.step(state, length, symbol)
            if grown <= length and length >= SHORTEST:
                matches.append((first + k - length, first + k, state))
            state, length = new, grown
            for size, phrase in self.phrases_at[state]:
                if size <= length:
                    base.append((first + k - size + 1, phrase))
        if length >= SHORTEST:
            matches.append((first + len(symbols) - length, first + len(symbols), state))

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chain maximal matches per template; the best span of each chain as (label, start, end, share)."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for start, end, state in matches:
            for template, at in self.templates_at[state]:
                by_template.setdefault(template, []).append((start, end, at + 1))
        spans = []
        for template, found in by_template.items():
            found.sort()
            best: list[tuple[int, int]] = []  # (words covered by the chain that ends here, its start)
            for k, (start, end, at) in enumerate(found):
                size = end - start
                cover, begin = size, start
                j = k - 1
                # A match that starts too far back cannot be followed by this one.
                while j >= 0 and found[j][0] >= start - GAP - self.sizes[template]:
                    s, e, a = found[j]
                    overlap = max(0, e - start, a - (at - size))
                    if s < start and a < at and start - e <= GAP and at - size - a <= GAP and overlap < size and best[j][0] + size - overlap > cover:
                        cover, begin = best[j][0] + size - overlap, best[j][1]
                    j -= 1
                best.append((cover, begin))
            tops: dict[int, tuple[float, int]] = {}
            for (cover, begin), (_, end, _) in zip(best, found):
                tops[begin] = max(tops.get(begin, (0.0, 0)), (cover / self.sizes[template], end))
            spans.extend((self.labels[template], begin, end, min(1.0, share)) for begin, (share, end) in tops.items())
        return spans


def _scan(names: list[str], phrases: dict[str, str], templates: list[tuple[str, str]]):
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column("_text")):
                words, at = words_of(data, offsets, WORDS)
                symbols = scanner.symbols(words)
                n = last - first
                base: list[list] = [[] for _ in range(n)]
                matches: list[list] = [[] for _ in range(n)]
                known = symbols >= 0
                row = np.repeat(np.arange(n), np.diff(at))
                edge = np.flatnonzero(np.concatenate(([True], (known[1:] != known[:-1]) | (row[1:] != row[:-1])))) if len(known) else np.zeros(0, int)
                until = np.concatenate((edge[1:], [len(known)])) if len(edge) else edge
                for a, b in zip(edge, until):
                    if known[a] and b - a >= SHORTEST:
                        r = row[a]
                        scanner.read(symbols[a:b].tolist(), int(a - at[r]), base[r], matches[r])
                spans = [[s for s in scanner.chains(m) if s[3] >= COVERED] if m else [] for m in matches]
                starts = [[s for s, _ in b] for b in base]
                base_labels = [sorted({scanner.phrase_labels[p] for _, p in b}) for b in base]
                labels = [sorted({*own, *(s[0] for s in more)}) for own, more in zip(base_labels, spans)]
                own = [batch.column(c).slice(first, n) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [
                        *own,
                        pa.array(np.diff(at).astype(np.int64)),
                        pa.array([len(s) for s in starts], pa.int64()),
                        pa.array([min(s, default=None) for s in starts], pa.int64()),
                        pa.array([max(s, default=None) for s in starts], pa.int64()),
                        pa.array([",".join(x) for x in base_labels]),
                        pa.array([",".join(x) for x in labels]),
                        pa.array([1.0 if s else max((x[3] for x in more), default=0.0) for s, more in zip(starts, spans)]),
                        pa.array([[dict(zip(("label", "first_word", "end_word", "share"), s)) for s in more] for more in spans], span_type),
                    ],
                    names=[*names, *OUTPUT],
                )

    return run


def scan(docs: DataFrame, text_col: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Add licence findings to every row.

    Words are runs of digits, A-Z (as lower case), a-z and non-ASCII characters,
    counted from 0. ``n_base`` counts every place of a base phrase, ``first_word``
    and ``last_word`` are its smallest and largest start (null without one).
    ``base_labels`` and ``labels`` are sorted, distinct and joined by commas;
    ``labels`` adds those of spans that cover at least ``COVERED`` of a template.
    ``score`` is 1 with a base phrase, else the largest share covered by such a
    span, else 0. ``spans`` lists the spans. Null and empty texts have no words and
    score 0. Input columns named like a result are replaced; all others stay.
    """
    bounded_batches(docs.sparkSession)
    docs = without(docs, [*OUTPUT, "_text"])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    added = (
        "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        "spans array<struct<label:string,first_word:bigint,end_word:bigint,share:double>>"
    )
    run = _scan(docs.columns, BASE_PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    return docs.withColumn("_text", text_of(text_col)).mapInArrow(run, ", ".join([*fields, added]))
