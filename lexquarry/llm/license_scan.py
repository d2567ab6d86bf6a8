"""Licence scans by a generalised suffix automaton of licence words.

The automaton holds the words of all templates.  Streaming a text through it
gives the matching statistics: at each word, the longest run ending there that
stands in some template, and where.  Runs that can't be lengthened are chained,
template by template, if both their places in the text and in the template go
forward by small gaps; the chain's share of the template is its coverage.

A base phrase is a template whose label holds wherever all of it stands.  Any
other template gives its label from COVER of its words on.  `score` is the
largest coverage, 1 where a base phrase stands.  `spans` are all places of base
phrases and covered templates: the number of the phrase (base phrases, then
TEMPLATES), its label, its first and last word in the text, and the coverage.

Nulls and empty texts have no words and score 0.  A very long text takes memory in
proportion to its words.  A column with the name of a result is replaced.  Ties, repeated rows and
repeated phrases keep all their places; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexquarry.llm.arrow import append, chunks, gather

#: Phrases that give a label wherever they stand.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices and clauses whose labels hold where enough of them stands.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]
#: Share of a template that gives its label; words of a run that counts; words that a chain may skip.
COVER, RUN, GAP = 0.6, 3, 4

_SPANS = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())]))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton:
    """A suffix automaton of several word sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [set()]
        for k, words in enumerate(sequences):
            at = 0
            for i, w in enumerate(words):
                at = self._extend(at, w)
                self.places[at].add((k, i))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.places[self.link[s]] |= self.places[s]

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.places.append(set())
        return len(self.next) - 1

    def _split(self, parent: int, w: int, child: int) -> int:
        """A state for the strings of `child` that end a step from `parent`."""
        twin = self._new(self.length[parent] + 1)
        self.next[twin], self.link[twin] = dict(self.next[child]), self.link[child]
        self.link[child] = twin
        while parent >= 0 and self.next[parent].get(w) == child:
            self.next[parent][w] = twin
            parent = self.link[parent]
        return twin

    def _extend(self, last: int, w: int) -> int:
        child = self.next[last].get(w)
        if child is not None:  # another sequence has been here
            return child if self.length[child] == self.length[last] + 1 else self._split(last, w, child)
        new = self._new(self.length[last] + 1)
        while last >= 0 and w not in self.next[last]:
            self.next[last][w] = new
            last = self.link[last]
        if last >= 0:
            child = self.next[last][w]
            self.link[new] = child if self.length[child] == self.length[last] + 1 else self._split(last, w, child)
        return new

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """(state, length) of the longest run that ends at each word."""
        out, at, size = [], 0, 0
        for w in words:
            while at and w not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            if w in self.next[at]:
                at, size = self.next[at][w], size + 1
            out.append((at, size))
        return out


class Scanner:
    def __init__(self, base: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None):
        base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
        self.labels = [*base.values(), *(label for label, _ in templates)]
        texts = [[w.encode() for w in t.split()] for t in [*base, *(t for _, t in templates)]]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        sequences = [[self.vocabulary[w] for w in t] for t in texts]
        self.sizes, self.n_base = [len(s) for s in sequences], len(base)
        self.automaton = Automaton(sequences)
        a = self.automaton
        self.ends: list[list[int]] = [[] for _ in a.next]  # phrases that are a suffix of a state's longest string
        for s in sorted(range(1, len(a.next)), key=a.length.__getitem__):
            own = {k for k in range(self.n_base) if (k, self.sizes[k] - 1) in a.places[s] and self.sizes[k] <= a.length[s]}
            self.ends[s] = sorted(own | set(self.ends[a.link[s]]))

    def run(self, words: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Base phrases as (start, phrase), and long runs as (template, template start, start, size), of known words."""
        stats, base, runs = self.automaton.statistics(words), [], []
        for i, (state, size) in enumerate(stats):
            base += [(i + 1 - self.sizes[k], k) for k in self.ends[state] if self.sizes[k] <= size]
            if size >= RUN and (i + 1 == len(stats) or stats[i + 1][1] <= size):
                runs += [(k, end + 1 - size, i + 1 - size, size) for k, end in self.automaton.places[state] if k >= self.n_base]
        return base, runs

    def coverage(self, runs: list[tuple[int, int, int, int]]) -> tuple[dict[int, float], list[tuple[int, int, int, float]]]:
        """The best chain's share of each template, and covered spans as (start, last, template, share); runs are in text order."""
        best: dict[int, float] = {}
        open_: dict[int, list[tuple[int, int, int, int]]] = {}
        covered: dict[int, list[tuple[int, int, int]]] = {}
        for k, of, at, size in sorted(runs, key=lambda r: (r[2] + r[3], r[0], r[1])):
            chains = [c for c in open_.get(k, []) if c[1] + GAP >= at]  # (template end, text end, words, text start)
            fits = [(c[2] - max(0, c[0] - of, c[1] - at), c[3]) for c in chains if c[0] < of + size and c[1] < at + size and of - c[0] <= GAP]
            more, start = max([(0, at), *fits])
            words = size + more
            open_[k] = [*chains, (of + size, at + size, words, start)]
            best[k] = max(best.get(k, 0.0), words / self.sizes[k])
            if words / self.sizes[k] >= COVER:
                covered.setdefault(k, []).append((-words, start, at + size - 1))
        spans: list[tuple[int, int, int, float]] = []
        for k, found in covered.items():  # of chains that overlap, the longest
            taken: list[tuple[int, int]] = []
            for less, start, last in sorted(found):
                at = bisect(taken, (start, last))
                if (at == 0 or taken[at - 1][1] < start) and (at == len(taken) or last < taken[at][0]):
                    taken.insert(at, (start, last))
                    spans.append((start, last, k, min(1.0, -less / self.sizes[k])))
        return {k: min(1.0, x) for k, x in best.items()}, spans

    def scan(self, column: pa.Array) -> list[pa.Array]:
        c = chunks(column, lower="all", blank=True)
        parts = [_WORD.findall(w) for w in c.words]
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        get = self.vocabulary.get
        flat = np.fromiter((get(w, -1) for p in parts for w in p), np.int64, int(count.sum()))
        words, n_words = flat[gather(np.cumsum(count) - count, count, c.codes)], c.per_text(count)
        ends = np.cumsum(n_words)
        known = words >= 0
        first = known.copy()
        first[1:] &= ~known[:-1]
        starts = ends - n_words
        opens = starts[(n_words > 0)]
        first[opens] |= known[opens]
        begin = np.flatnonzero(first)
        stop = np.searchsorted(np.flatnonzero(~known), begin)
        gaps = np.append(np.flatnonzero(~known), len(words))
        stop = np.minimum(gaps[stop], np.append(begin[1:], len(words)))
        least = min([RUN, *self.sizes[: self.n_base]])
        long = stop - begin >= least
        owner = np.searchsorted(ends, begin[long], side="right")
        base: dict[int, list[tuple[int, int]]] = {}
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        for a, b, t in zip(begin[long].tolist(), stop[long].tolist(), owner.tolist()):
            found, matched = self.run(words[a:b].tolist())
            off = a - int(starts[t])
            if found:
                base.setdefault(t, []).extend((off + i, k) for i, k in found)
            if matched:
                runs.setdefault(t, []).extend((k, of, off + at, size) for k, of, at, size in matched)
        out = []
        for t in range(len(n_words)):
            places = base.get(t, [])
            own = {self.labels[k] for _, k in places}
            cover, spans = self.coverage(runs[t]) if t in runs else ({}, [])
            more = own | {self.labels[k] for k, x in cover.items() if x >= COVER}
            at = [i for i, _ in places]
            out.append((len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(more)), 1.0 if own else max(cover.values(), default=0.0)))
            spans = sorted(spans + [(i, i + self.sizes[k] - 1, k, 1.0) for i, k in places])
            out[-1] += ([{"template": k, "label": self.labels[k], "first": i, "last": j, "coverage": x} for i, j, k, x in spans],)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS]
        return [pa.array(n_words, pa.int64()), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds))]


FIELDS = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType())]
FIELDS.append(("spans", T.ArrayType(T.StructType([T.StructField("template", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("coverage", T.DoubleType())]))))


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, n_base, first_word, last_word, base_labels, labels, score and spans of the column `text`."""

    def make():
        scanner = Scanner()
        return lambda batch: scanner.scan(batch.column(text))

    return append(df, text, FIELDS, make)
