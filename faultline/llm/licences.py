"""Licence scans by a generalised suffix automaton of licence tokens.

The automaton holds the words of all licence templates and of the base phrases. A text's words pass
through it once and give matching statistics: for every place the longest run of words ending there
that some template holds. Base phrases are read off the same walk, since a phrase ends where its
state is reached through suffix links. Long matches are then chained per template into covered spans.

Only runs of words that the automaton knows are walked; all other words reset it, which arrays decide.

Defined results: null and empty texts have no words and no labels; rows are independent of each
other, so ties and repeated rows have equal results; further columns are ignored; an empty table
gives an empty result. Very long texts are read whole; memory follows the longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.llm import words

# Base phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Opening words of public licences, and the short notices that name them.
TEMPLATES = {
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files to deal in the software without restriction including without "
        "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
        "of the software",
        "the software is provided as is without warranty of any kind express or implied including but not "
        "limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "apache": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the "
        "license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license "
        "is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation",
        "this program is distributed in the hope that it will be useful but without any warranty without "
        "even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and "
        "the following disclaimer",
    ),
    "cc-by-nc": (
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ),
}

#: Words a match needs to count, words that may lie between two matches of one span, and the least
#: part of a template that its spans cover.
LEAST_MATCH, MOST_GAP, LEAST_COVER = 4, 8, 0.8

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def tokens(text: str) -> list[str]:
    """The words of a text after lower-casing A-Z."""
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


class Automaton:
    """A suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, source: int, token: int, target: int) -> int:
        """A state for the part of ``target`` that is one word longer than ``source``."""
        new = self._state(self.length[source] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = new
        while source >= 0 and self.next[source].get(token) == target:
            self.next[source][token] = new
            source = self.link[source]
        return new

    def add(self, sequence: list[int]) -> list[int]:
        """Add a sequence; the states after each of its words."""
        last, path = 0, []
        for token in sequence:
            target = self.next[last].get(token)
            if target is not None:
                if self.length[target] != self.length[last] + 1:
                    target = self._split(last, token, target)
                last = target
            else:
                new, source = self._state(self.length[last] + 1, {}, 0), last
                while source >= 0 and token not in self.next[source]:
                    self.next[source][token] = new
                    source = self.link[source]
                if source >= 0:
                    target = self.next[source][token]
                    if self.length[target] != self.length[source] + 1:
                        target = self._split(source, token, target)
                    self.link[new] = target
                last = new
            path.append(last)
        return path

    def find(self, sequence: list[int]) -> int:
        state = 0
        for token in sequence:
            state = self.next[state][token]
        return state


@dataclass(frozen=True)
class Span:
    """Words ``first`` to ``last`` of a text that cover a part of a template."""
    template: int
    first: int
    last: int
    cover: float


class Scanner:
    """The automaton of templates and phrases, with what each state says."""

    def __init__(self, templates: dict[str, tuple[str, ...]], phrases: dict[str, str]):
        self.names = [name for name, texts in templates.items() for _ in texts]
        lists = [tokens(text) for texts in templates.values() for text in texts]
        self.sizes = [len(x) for x in lists]
        phrase_lists = [tokens(p) for p in phrases]
        vocabulary = sorted({w for x in [*lists, *phrase_lists] for w in x})
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.word_bytes = [w.encode() for w in vocabulary]
        hashes = words.Words(*words.text_bytes(pa.array(vocabulary))).hashes
        order = np.argsort(hashes)
        self.hashes, self.order = hashes[order], order
        sequences = [[self.ids[w] for w in x] for x in lists]
        self.automaton = automaton = Automaton()
        for sequence in [*sequences, *([self.ids[w] for w in x] for x in phrase_lists)]:
            automaton.add(sequence)
        # Where the strings of a state end in the templates: handed up along the suffix links.
        ends: list[set[tuple[int, int]]] = [set() for _ in automaton.link]
        for number, sequence in enumerate(sequences):
            state = 0
            for place, token in enumerate(sequence):
                state = automaton.next[state][token]
                ends[state].add((number, place))
        by_length = sorted(range(1, len(automaton.link)), key=automaton.length.__getitem__, reverse=True)
        for state in by_length:
            if automaton.link[state] > 0:
                ends[automaton.link[state]] |= ends[state]
        self.ends = [sorted(e) for e in ends]
        # Phrases that are a suffix of the state's strings: handed down.
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in automaton.link]
        for x, label in zip(phrase_lists, phrases.values(), strict=True):
            self.phrases[automaton.find([self.ids[w] for w in x])].append((len(x), label))
        for state in reversed(by_length):
            self.phrases[state] = self.phrases[state] + self.phrases[automaton.link[state]]

    def known(self, found: words.Words) -> np.ndarray:
        """The token number of every word, -1 for words that no template holds."""
        at = np.searchsorted(self.hashes, found.hashes)
        at[at == len(self.hashes)] = 0
        out = np.where(self.hashes[at] == found.hashes, self.order[at], -1)
        for i in np.flatnonzero(out >= 0).tolist():  # compare the words themselves
            if found.data[found.starts[i]:found.ends[i]].tobytes() != self.word_bytes[out[i]]:
                out[i] = -1
        return out

    def walk(self, ids: list[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, str]]]:
        """Maximal matches ``(last place, length, state)`` of one run of known words, and the phrases.

        A match is maximal if the next word does not lengthen it.
        """
        following, link, lengths, phrases = self.automaton.next, self.automaton.link, self.automaton.length, self.phrases
        state, length, matches, found = 0, 0, [], []
        for place, token in enumerate(ids):
            if token not in following[state]:
                matches.append((place - 1, length, state))
                while state > 0 and token not in following[state]:
                    state = link[state]
                    length = lengths[state]
            if token in following[state]:
                state = following[state][token]
                length += 1
            for size, label in phrases[state]:
                if size <= length:
                    found.append((place - size + 1, label))
        matches.append((len(ids) - 1, length, state))
        return matches, found

    def spans(self, matches: list[tuple[int, int, int]]) -> list[Span]:
        """Chains of long matches, in order in text and template, that cover enough of a template."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for last, length, state in matches:
            if length >= LEAST_MATCH:
                for template, place in self.ends[state]:
                    by_template.setdefault(template, []).append((last - length + 1, place - length + 1, length))
        out = []
        for template, found in by_template.items():
            found.sort()
            chains: list[list[int]] = []  # first word, next word, next place in the template, words covered
            for start, place, length in found:
                for chain in reversed(chains):
                    if 0 <= start - chain[1] <= MOST_GAP and place >= chain[2]:
                        chain[1:] = [start + length, place + length, chain[3] + length]
                        break
                else:
                    chains.append([start, start + length, place + length, length])
            out += [Span(template, a, b - 1, n / self.sizes[template])
                    for a, b, _, n in chains if n >= LEAST_COVER * self.sizes[template]]
        return sorted(out, key=lambda s: (s.first, s.template))


@lru_cache(maxsize=4)
def _scanner(templates: tuple, phrases: tuple) -> Scanner:
    return Scanner(dict(templates), dict(phrases))


def _scan(batches: Iterator[pa.RecordBatch], templates: tuple, phrases: tuple, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    scanner = _scanner(templates, phrases)
    for batch in batches:
        for first, last, data, offsets in words.blocks(batch["text"]):
            found = words.Words(data, offsets)
            ids = scanner.known(found)
            # A lone known word can be neither a phrase nor a long match: only runs are walked.
            starts, ends = words.runs(ids >= 0, found.offsets[:-1][np.diff(found.offsets) > 0]) if len(ids) else (ids, ids)
            long = ends - starts >= 2
            starts, ends = starts[long], ends[long]
            texts = np.searchsorted(found.offsets, starts, "right") - 1
            matches: dict[int, list] = {}
            base: dict[int, list] = {}
            for text, a, b in zip(texts.tolist(), starts.tolist(), ends.tolist(), strict=True):
                at = a - int(found.offsets[text])
                some, places = scanner.walk(ids[a:b].tolist())
                matches.setdefault(text, []).extend((p + at, n, s) for p, n, s in some if n >= LEAST_MATCH)
                if places:
                    base.setdefault(text, []).extend((p + at, label) for p, label in places)
            rows = []
            for i, n_words in enumerate(np.diff(found.offsets).tolist()):
                spans, places = scanner.spans(matches.get(i, [])), base.get(i, [])
                labels = {label for _, label in places}
                more = labels | {scanner.names[s.template] for s in spans}
                score = max([s.cover for s in spans] + [1.0 if labels else 0.0])
                rows.append({
                    "n_words": n_words, "n_base": len(places),
                    "first_word": min((p for p, _ in places), default=None),
                    "last_word": max((p for p, _ in places), default=None),
                    "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(more)),
                    "score": min(1.0, score),
                    "spans": [{"label": scanner.names[s.template], "first": s.first, "last": s.last, "cover": s.cover} for s in spans],
                })
            out = pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(first, last - first), *out.columns], ["doc_id", *schema.names]
            )


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` per row.

    ``spans`` are the covered template spans with their first and last word and the covered part of
    the template; ``score`` is the largest part, 1 where a base phrase stands.
    """
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())])
    schema = pa.schema([
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span)),
    ])
    return docs.select("doc_id", "text").mapInArrow(
        partial(_scan, templates=tuple(templates.items()), phrases=tuple(phrases.items()), schema=schema),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, "
        "last_word bigint, base_labels string, labels string, score double, "
        "spans array<struct<label: string, first: bigint, last: bigint, cover: double>>",
    )
