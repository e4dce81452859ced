"""License scan: licence phrases and spans of licence templates, by a suffix automaton.

The words of all templates and phrases form one generalised suffix automaton. The words of a file run
through it and give matching statistics: at each word the longest run of words ending there that
stands in some template, and the automaton's state. Phrases are read off the states. Runs of at least
``MIN_MATCH`` words that can't be longer are chained per template, in order of file and template, over
gaps of at most ``MAX_GAP`` words in the file and any in the template; a chain that covers at least
``MIN_COVER`` of its template is a span, which adds the template's label.

The automaton has a few thousand states, given by the templates and not by the corpus. Files are read
in chunks of ``CHUNK`` bytes, cut between words. Only words of the templates' vocabulary are kept, and only
runs of them in which each pair of neighbours stands in a template enter the automaton: elsewhere no
match is longer than a word, which is neither a phrase nor a part of a chain. Nothing is shuffled.

Defined results: a null text is empty; without words there are no places and the score is 0; each row
is scanned by itself, so repeated rows repeat their result; places may overlap; a word of the file
belongs to one match of a chain (of two that overlap the later one gives up its front); where a
template repeats a match, the first place behind the chain counts; score is the largest covered share
of any template or phrase; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickertide.llm.common import in_batches

MIN_MATCH = 4  # words
MAX_GAP = 12  # words of the file
MIN_COVER = 0.75
CHUNK = 4 << 20  # bytes

# Phrases that name a licence.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices as licences word them, and the lines by which files refer to them.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0"),
]

# Bytes of words in lower case; 0 for all others. Bytes of other alphabets belong to words.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 0 for b in range(256)], np.uint8)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_KEYED = 24  # bytes of a word that are compared as integers


def _word_bounds(low: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in lowered bytes; ``texts`` are the first bytes of the texts."""
    word = low != 0
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = texts[(texts > 0) & (texts < len(low))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


class Vocabulary:
    """Numbers the words of the templates and finds them in bytes."""

    def __init__(self, words: Sequence[bytes]):
        self.words = sorted(set(words))
        self.number = {w: i for i, w in enumerate(self.words)}
        flat = np.frombuffer(b"".join(self.words), np.uint8)
        sizes = np.array([len(w) for w in self.words], np.int64)
        begins = np.cumsum(sizes) - sizes
        codes, self.parts = self._codes(flat, begins, sizes)
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]
        if len(self.codes) > 1 and (self.codes[1:] == self.codes[:-1]).any():
            raise ValueError("two words of the templates agree in length and beginning")
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self._brief(self.parts[0], sizes)] = True

    @staticmethod
    def _brief(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return ((first ^ sizes.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)

    @staticmethod
    def _part(low: np.ndarray, begins: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of each word as an integer; ``low`` has spare bytes at its end."""
        eight = np.ndarray((len(low) - 7,), "<u8", low.data, strides=(1,))
        return eight[np.minimum(begins + 8 * k, len(eight) - 1)] & _MASKS[np.clip(sizes - 8 * k, 0, 8)]

    def _codes(self, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        low = np.append(flat, np.zeros(_KEYED + 8, np.uint8))
        parts = [self._part(low, begins, sizes, k) for k in range(_KEYED // 8)] + [sizes.astype(np.uint64)]
        code = np.zeros(len(begins), np.uint64)
        for part in parts:
            code = (code ^ (code >> np.uint64(29)) ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        return code, parts

    def find(self, flat: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are in the vocabulary, and their numbers. Equality is checked byte by byte."""
        if not len(begins) or not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = ends - begins
        padded = np.append(flat, np.zeros(8, np.uint8))
        maybe = np.flatnonzero(self.seen[self._brief(self._part(padded, begins, sizes, 0), sizes)])
        codes, parts = self._codes(flat, begins[maybe], sizes[maybe])
        at = self.order[np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)]
        same = np.ones(len(maybe), bool)
        for mine, theirs in zip(self.parts, parts):
            same &= mine[at] == theirs
        for i in np.flatnonzero(same & (sizes[maybe] > _KEYED)):
            same[i] = flat[begins[maybe[i]] : ends[maybe[i]]].tobytes() == self.words[at[i]]
        return maybe[same], at[same]


def words_of(text: str) -> list[bytes]:
    flat = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    return [flat[b:e].tobytes() for b, e in zip(*_word_bounds(flat, np.zeros(1, np.int64)))]


class Automaton:
    """Generalised suffix automaton over numbered words: states 0 (empty run) and up."""

    def __init__(self, texts: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = []  # of each text: the state of every prefix
        for t, words in enumerate(texts):
            state = 0
            for at, word in enumerate(words):
                state = self._extended(state, word)
                ends.append((state, t, at + 1))
        # A run ends wherever the longer runs of its class's descendants end: pass places up, longest first.
        self.places: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for state, t, end in ends:
            self.places[state].add((t, end))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.places[self.link[state]] |= self.places[state]

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, word: int) -> int:
        """The state of the run of ``state`` and ``word``, which stands in the texts already."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extended(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def statistics(self, words: Sequence[int]) -> Iterator[tuple[int, int]]:
        """At each word: the state and length of the longest run ending there that stands in a text."""
        state, length = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


@dataclass
class _Chain:
    template: int
    first: int  # words of the file
    end: int
    reached: int  # words of the template
    covered: int


class Scanner:
    """What the tasks need: vocabulary, automaton, phrases of each state."""

    def __init__(
        self,
        templates: Sequence[tuple[str, str]],
        phrases: Mapping[str, str],
        min_match: int = MIN_MATCH,
        max_gap: int = MAX_GAP,
        min_cover: float = MIN_COVER,
    ):
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.labels = [label for label, _ in templates]
        texts = [words_of(text) for _, text in templates]
        named = [(words_of(p), label) for p, label in phrases.items()]
        if min([min_match, *(len(t) for t in texts), *(len(p) for p, _ in named)]) < 2:
            raise ValueError("templates, phrases and matches have at least two words")
        self.sizes = [len(t) for t in texts]
        self.vocabulary = Vocabulary([w for t in texts for w in t] + [w for p, _ in named for w in p])
        number = self.vocabulary.number
        coded = [[number[w] for w in t] for t in texts]
        spoken = [[number[w] for w in p] for p, _ in named]
        self.automaton = Automaton(coded + spoken)
        pairs = {(a, b) for t in coded + spoken for a, b in zip(t, t[1:])}
        n = max(1, len(number))
        self.pair = np.zeros(n * n, bool)
        self.pair[[a * n + b for a, b in pairs]] = True
        self.opening = np.zeros(n * n, bool)
        self.opening[[p[0] * n + p[1] for p in spoken]] = True
        # Phrases that end where a state's runs end: those of the state and of its suffixes.
        own: dict[int, list[tuple[int, str]]] = {}
        for words, (_, label) in zip(spoken, named):
            state = 0
            for word in words:
                state = self.automaton.next[state][word]
            own.setdefault(state, []).append((len(words), label))
        self.phrases: dict[int, list[tuple[int, str]]] = {}
        for state in range(1, len(self.automaton.next)):
            up, found = state, []
            while up > 0:
                found += own.get(up, [])
                up = self.automaton.link[up]
            if found:
                self.phrases[state] = found

    # ---- words of files

    def hits(self, flat: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words per text; text, place in the text and number of every word in the vocabulary."""
        texts = texts.astype(np.int64)
        counts = np.zeros(len(texts), np.int64)
        found: list[list[np.ndarray]] = [[], [], []]
        at = 0
        while at < len(flat):
            end = self._cut(flat, at + CHUNK)
            low = _LOWER[flat[at:end]]
            first, last = np.searchsorted(texts, at, "right") - 1, np.searchsorted(texts, end, "left")
            inside = np.maximum(texts[first:last] - at, 0)
            begins, ends = _word_bounds(low, inside)
            cuts = np.searchsorted(begins, np.append(inside, len(low)))
            here = np.diff(cuts)
            words, numbers = self.vocabulary.find(low, begins, ends)
            text = np.repeat(np.arange(first, last), here)[words]
            found[0].append(text)
            found[1].append(words - cuts[text - first] + counts[text])
            found[2].append(numbers)
            counts[first:last] += here
            at = end
        return counts, *(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)

    @staticmethod
    def _cut(flat: np.ndarray, at: int) -> int:
        """The next place from ``at`` on that is not inside a word."""
        while at < len(flat):
            other = np.flatnonzero(_LOWER[flat[at : at + 65536]] == 0)
            if len(other):
                return at + int(other[0])
            at += 65536
        return len(flat)

    def runs(self, text: np.ndarray, place: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """Runs of words whose neighbours are neighbours in a template: text, first place, words."""
        if len(word) < 2:
            return
        n = max(1, len(self.vocabulary.words))
        joined = (text[1:] == text[:-1]) & (place[1:] == place[:-1] + 1)
        pair = word[:-1] * n + word[1:]
        joined &= self.pair[pair]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], joined.view(np.int8), [0]])))
        first, last = edges[::2], edges[1::2]  # words first to last
        opens = np.concatenate([[0], np.cumsum(joined & self.opening[pair])])
        useful = (last - first + 1 >= self.min_match) | (opens[last] > opens[first])
        for a, b in zip(first[useful].tolist(), last[useful].tolist()):
            yield int(text[a]), int(place[a]), word[a : b + 1].tolist()

    # ---- matches and chains

    def matches(self, words: list[int]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
        """Phrases (first word, label) and longest matches (first word, length, state) of a run."""
        places, longest, held = [], [], (0, 0)
        for end, (state, length) in enumerate(self.automaton.statistics(words), 1):
            for size, label in self.phrases.get(state, ()):
                if size <= length:
                    places.append((end - size, label))
            if held[1] >= self.min_match and length != held[1] + 1:
                longest.append((end - 1 - held[1], held[1], held[0]))
            held = (state, length)
        if held[1] >= self.min_match:
            longest.append((len(words) - held[1], held[1], held[0]))
        return places, longest

    def chained(self, matches: list[tuple[int, int, int]]) -> list[_Chain]:
        """Chains per template of the matches of one text, which come in order."""
        open_ones: dict[int, _Chain] = {}
        done = []
        for first, length, state in matches:
            ends: dict[int, list[int]] = {}
            for t, end in self.automaton.places[state]:
                if t < len(self.sizes):  # the others are phrases
                    ends.setdefault(t, []).append(end)
            for t, places in ends.items():
                chain = open_ones.get(t)
                if chain:
                    front = max(0, chain.end - first)  # words the chain holds already
                    later = [e for e in places if e - length + front >= chain.reached]
                    if later and front < length and first - chain.end <= self.max_gap:
                        chain.end, chain.reached, chain.covered = first + length, min(later), chain.covered + length - front
                        continue
                    if first + length <= chain.end:
                        continue
                    done.append(chain)
                open_ones[t] = _Chain(t, first, first + length, min(places), length)
        return done + list(open_ones.values())

    def scan(self, flat: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, dict[int, list], dict[int, list[_Chain]]]:
        """Words per text, and phrases and chains of the texts that have any."""
        counts, text, place, word = self.hits(flat, texts)
        phrases: dict[int, list] = {}
        found: dict[int, list] = {}
        for t, first, words in self.runs(text, place, word):
            places, longest = self.matches(words)
            if places:
                phrases.setdefault(t, []).extend((first + p, label) for p, label in places)
            if longest:
                found.setdefault(t, []).extend((first + p, n, state) for p, n, state in longest)
        return counts, phrases, {t: self.chained(m) for t, m in found.items()}


FIELDS = [
    ("n_words", "bigint"),
    ("places", "array<struct<first_word: bigint, label: string>>"),
    ("spans", "array<struct<first_word: bigint, n_words: bigint, label: string, covered: bigint, share: double>>"),
    ("score", "double"),
]


def _texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the first byte of each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    flat = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and body.size else np.zeros(0, np.uint8)
    return flat, offsets[:-1] - offsets[0]


def scan_licenses(
    docs: DataFrame,
    columns: Sequence[str] | None = None,
    text: str = "text",
    templates: Sequence[tuple[str, str]] = tuple(TEMPLATES),
    phrases: Mapping[str, str] = PHRASES,
    min_match: int = MIN_MATCH,
    max_gap: int = MAX_GAP,
    min_cover: float = MIN_COVER,
) -> DataFrame:
    """Every row with n_words, its phrases (``places``), its template ``spans`` and its ``score``."""

    def step():
        scanner = Scanner(templates, phrases, min_match, max_gap, min_cover)

        def run(texts: pa.Array) -> list[pa.Array]:
            counts, named, chains = scanner.scan(*_texts(texts))
            places, spans, scores = [], [], []
            for t in range(len(counts)):
                places.append([{"first_word": p, "label": label} for p, label in sorted(named.get(t, ()))])
                shares = [(c, c.covered / scanner.sizes[c.template]) for c in chains.get(t, ())]
                scores.append(max([share for _, share in shares] + [1.0] * (t in named), default=0.0))
                kept = sorted((c.first, c.end, scanner.labels[c.template], c.covered, s) for c, s in shares if s >= min_cover)
                spans.append([{"first_word": a, "n_words": b - a, "label": k, "covered": n, "share": s} for a, b, k, n, s in kept])
            place = pa.struct([("first_word", pa.int64()), ("label", pa.string())])
            span = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("covered", pa.int64()), ("share", pa.float64())])
            return [pa.array(counts), pa.array(places, pa.list_(place)), pa.array(spans, pa.list_(span)), pa.array(scores, pa.float64())]

        return run

    return in_batches(docs, step, FIELDS, columns, text)
