"""License scans: MinHash over overlapping text windows, then exact shingle containment.

Texts and templates are five-word shingles.  A template of m shingles is looked for in windows of
the largest power of two W <= m shingles, a quarter of W apart; it is indexed by the minima of all
its own windows of that size, so a window anywhere inside an occurrence has a counterpart.  Each of
``BANDS`` bands is one minimum: two windows of Jaccard similarity J meet in one with probability
1 - (1 - J) ** BANDS, which is over 0.9999 at the 0.45 that remains in the worst case of a 0.8
containment between two window places.  Templates of up to four shingles must occur whole, so
their first shingle retrieves them with certainty.  A candidate counts only if the words around it
hold at least ``CONTAINMENT`` of the template's shingles.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waterloom.llm.common import bound_batches, groups

SHINGLE = 5
BANDS = 16
CONTAINMENT = 0.8
#: Bound of the templates every task holds, in characters; more are scanned in several passes.
TEMPLATE_CHARS = 4_000_000
KNOWN_WORDS = 500_000
#: Characters of texts searched together, and words of a search slice; bounds of memory only.
GROUP_CHARS, SLICE_WORDS = 1 << 18, 1 << 16
#: Short notices and the standard headers of public licenses.
TEMPLATES = (
    ("mit-notice", "Released under the MIT License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
            "and to permit persons to whom the Software is furnished to do so"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
                   "use this file except in compliance with the License. You may obtain a copy of "
                   "the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under "
                "the terms of the GNU General Public License as published by the Free Software "
                "Foundation, either version 3 of the License, or (at your option) any later "
                "version."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without "
                     "modification, are permitted provided that the following conditions are met"),
)
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MATCH = "array<struct<template:string, start:bigint, end:bigint, containment:double>>"


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, A-Z lower-cased, as UTF-8."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j:j + n]
    return out ^ (out >> np.uint64(31))


def _permutation(band: int, shingles: np.ndarray) -> np.ndarray:
    mixed = (shingles + np.uint64(2 * band + 1)) * np.uint64(
        (0xD6E8FEB86659FD93 * (2 * band + 1)) % (1 << 64) | 1)
    return mixed ^ (mixed >> np.uint64(32))


def _widen(minima: np.ndarray, size: int) -> np.ndarray:
    """Minima of windows of ``2 * size`` from those of ``size``."""
    return np.minimum(minima[:-size], minima[size:]) if len(minima) > size else minima[:0]


class Keys:
    """Sorted keys with the templates they stand for; a bit per key's low half sieves first."""

    def __init__(self, pairs: list[tuple[int, int]]):
        rows = sorted(set(pairs))
        self.keys = np.array([k for k, _ in rows], np.uint64)
        self.owners = np.array([o for _, o in rows], np.int64)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, values: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int]]:
        near = np.flatnonzero(self.sieve[(values & np.uint64(0xFFFF)).astype(np.int64)])
        lo = np.searchsorted(self.keys, values[near], "left")
        hi = np.searchsorted(self.keys, values[near], "right")
        for i in np.flatnonzero(hi > lo):
            for o in self.owners[lo[i]:hi[i]]:
                yield int(o), int(places[near[i]])


class Scanner:
    """Index of a bounded list of templates."""

    def __init__(self, templates: list[tuple[str, str]], bands: int = BANDS):
        self.bands, self.hashes = bands, _Hashes()
        self.names, self.words, self.sets, self.width = [], [], [], []
        for name, text in templates:
            words = words_of(text)
            if words:
                k = min(SHINGLE, len(words))
                self.names.append(name)
                self.words.append(words)
                self.width.append(k)
                self.sets.append({tuple(words[i:i + k]) for i in range(len(words) - k + 1)})
        self.first, self.windows = {}, {}
        firsts, wide = {}, {}
        for o, (words, k) in enumerate(zip(self.words, self.width)):
            h = shingle_hashes(self._numbers(words), k)
            if len(h) <= 4:
                firsts.setdefault(k, []).append((int(h[0]), o))
                continue
            size = 1 << (len(h).bit_length() - 1)
            for band in range(bands):
                m, s = _permutation(band, h), 1
                while s < size:
                    m, s = _widen(m, s), 2 * s
                wide.setdefault((size, band), []).extend((int(x), o) for x in m)
        self.first = {k: Keys(v) for k, v in firsts.items()}
        self.windows = {k: Keys(v) for k, v in wide.items()}
        self.sizes = sorted({size for size, _ in self.windows})
        self.reach = max(self.sizes, default=0)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))

    def candidates(self, numbers: np.ndarray) -> set[tuple[int, int]]:
        """(template, place of a shingle) pairs that a minimum retrieves, slice by slice."""
        found, reach = set(), self.reach + SHINGLE
        for at in range(0, len(numbers), SLICE_WORDS):
            part = numbers[at:at + SLICE_WORDS + reach]
            found.update((o, at + i) for o, i in self._candidates(part))
        return found

    def _candidates(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        for k, keys in self.first.items():
            h = shingle_hashes(numbers, k)
            yield from keys.find(h, np.arange(len(h)))
        if not self.sizes:
            return
        h = shingle_hashes(numbers, SHINGLE)
        for band in range(self.bands):
            m, s = _permutation(band, h), 1
            for size in self.sizes:
                while s < size:
                    m, s = _widen(m, s), 2 * s
                hop = max(1, size // 4)
                yield from self.windows[size, band].find(m[::hop], np.arange(0, len(m), hop))

    def verify(self, words: list[bytes], found: set[tuple[int, int]]) -> list[tuple]:
        """(template, first word, end word, containment) of every stretch, at most a quarter
        longer than the template, that holds enough of its shingles."""
        out, upto = [], {}
        for o, at in sorted(found):
            if at < upto.get(o, 0):
                continue
            k, wanted = self.width[o], self.sets[o]
            m = len(self.words[o]) - k + 1
            lo, hi = max(0, at - m, upto.get(o, 0)), min(len(words) - k + 1, at + 2 * m)
            places = [(i, t) for i in range(lo, hi) if (t := tuple(words[i:i + k])) in wanted]
            i = 0
            while i < len(places):
                seen, last = set(), i  # up to the last shingle that adds something
                for j in range(i, len(places)):
                    if places[j][0] >= places[i][0] + m + m // 4:
                        break
                    if places[j][1] not in seen:
                        seen.add(places[j][1])
                        last = j
                if len(seen) >= CONTAINMENT * len(wanted):
                    upto[o] = places[last][0] + 1
                    out.append((self.names[o], places[i][0], places[last][0] + k,
                                len(seen) / len(wanted)))
                    i = last + 1
                else:
                    i += 1
        return sorted(out)

    def scan(self, texts: list[str | None]) -> list[list[tuple]]:
        """Occurrences in each text.  Texts are searched together, one after the other with a gap
        between them, so a window may begin before or end behind a short text; what is verified
        lies in one text."""
        out = []
        for a, b in groups(texts, GROUP_CHARS):
            listed = [words_of(t) for t in texts[a:b]]
            if len(self.hashes) > KNOWN_WORDS:
                self.hashes.clear()
            gap, parts, starts, at = np.zeros(SHINGLE, np.uint64), [], [], 0
            for words in listed:
                starts.append(at)
                parts += [self._numbers(words), gap]
                at += len(words) + SHINGLE
            # a window that begins before the first text, and one that ends behind the last
            edge = np.zeros(self.reach, np.uint64)
            found = [set() for _ in listed]
            for o, place in self.candidates(np.concatenate([edge, *parts, edge])):
                place -= self.reach
                first = max(bisect_right(starts, place) - 1, 0)
                for d in range(first, bisect_right(starts, place + self.reach)):
                    found[d].add((o, max(0, place - starts[d])))
            out += [self.verify(w, f) for w, f in zip(listed, found)]
        return out


@lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(list(templates))


def scan(docs: DataFrame, templates=TEMPLATES, *, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """doc_id and ``matches``: template, first word, end word and containment of every
    occurrence, sorted; one row per document.

    Null and empty texts match nothing; templates without words are never found; repeated rows
    and null ids stay.  Templates are an argument of the caller, taken in runs of at most
    ``TEMPLATE_CHARS`` characters, one column each.
    """
    bound_batches(docs.sparkSession)
    listed = [(str(n), str(t)) for n, t in templates]
    runs = [tuple(listed[a:b]) for a, b in groups([t for _, t in listed], TEMPLATE_CHARS)]

    def matches(run):
        @F.pandas_udf(MATCH)
        def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            with_templates = scanner(run)
            names = ("template", "start", "end", "containment")
            for part in parts:
                yield pd.Series([[dict(zip(names, m)) for m in found]
                                 for found in with_templates.scan(part.tolist())], dtype=object)
        return of(text)

    found = [matches(run) for run in runs] or [F.array().cast(MATCH)]
    return docs.select(F.col(doc_id).alias("doc_id"), F.array_sort(F.concat(*found))
                       .alias("matches"))
