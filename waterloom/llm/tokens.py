"""Token ids and token counts of whole texts for a word-level BPE vocabulary file.

Words between white space are encoded on their own: no rule of the vocabulary's splitter matches
white space, so a text's ids are those of its words in order, and each different word needs its
merges only once per task.  Texts for which that is not certain (control characters, characters
outside Latin script and common punctuation, strings of special tokens) take the library's own
normaliser and splitter as a whole.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from waterloom.llm.common import bound_batches, groups

#: Different words remembered by one task; the memory is emptied beyond that, results do not change.
KNOWN_WORDS = 600_000
#: Characters for which lower case and normal form are certain to agree between Python and the
#: library; special-token strings begin with "<|" in every vocabulary file read here.
UNSURE = re.compile(
    "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in (
        (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x9F), (0x130, 0x130), (0x250, 0x200F),
        (0x2028, 0x10FFFF))) + "]|<[|]"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def words_of(text: str) -> list[str] | None:
    """Lower-case words between white space, or None where the whole text must be normalised."""
    if UNSURE.search(text) or not unicodedata.is_normalized("NFC", text):
        return None
    return text.lower().split()


def splitter(spec: dict):
    """The vocabulary's own split of a word into pieces, or None where it has another form.

    Holds for a chain of one pattern split that keeps the matches and a byte-level map.
    """
    chain = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if [x["type"] for x in chain] != ["Split", "ByteLevel"]:
        return None
    cut, mapped = chain
    if (not cut["invert"] or cut["behavior"] != "Removed" or "Regex" not in cut["pattern"]
            or mapped["use_regex"] or mapped["add_prefix_space"]):
        return None
    import regex

    return regex.compile(cut["pattern"]["Regex"]).findall


def byte_symbols() -> dict[int, int]:
    """Character a byte-level vocabulary writes for each byte: printable ones stand for themselves,
    the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


class WordIds:
    """Token ids of texts as little-endian unsigned integers of ``width`` (2 or 4) bytes.

    With the splitter of a byte-level vocabulary, a piece that words share is merged once, by the
    library's model; other vocabularies encode each different word.
    """

    def __init__(self, vocabulary: str, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.cell = f"<u{width}"
        with open(vocabulary, encoding="utf-8") as f:
            self.split = splitter(json.load(f))
        self.model, self.symbols = self.tokenizer.model, byte_symbols()
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _ids(self, ids: list[int]) -> bytes:
        return np.array(ids, self.cell).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(
                self.symbols)
            self.pieces[piece] = found = self._ids([t.id for t in self.model.tokenize(text)])
        return found

    def _learn(self, words: set[str]) -> None:
        if len(self.pieces) > KNOWN_WORDS:
            self.pieces.clear()
        for word in words:
            if self.split is None:
                self.known[word] = self._ids(
                    self.tokenizer.encode(word, add_special_tokens=False).ids)
            else:
                self.known[word] = b"".join(map(self._piece, self.split(word)))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for a, b in groups(texts):
            split = [words_of(t) if t else [] for t in texts[a:b]]
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            new = set().union(*(w for w in split if w)).difference(self.known)
            if new:
                self._learn(new)
            for text, words in zip(texts[a:b], split):
                if words is None:
                    yield self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
                else:
                    yield b"".join(map(self.known.__getitem__, words))


class MergeCounts:
    """Number of tokens by heap merging, without ids: initial symbols minus merges."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        self.normalise = tokenizer.normalizer.normalize_str
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(a, b): r for r, (a, b) in enumerate(merges)}
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special) or "(?!)")
        self.known: dict[str, int] = {}

    def piece(self, symbols: str) -> int:
        """Tokens of one splitter piece.

        Symbols stand in a linked list; a heap gives the adjacent pair of lowest rank, leftmost
        first.  A pair whose symbols have changed since it was pushed is passed over.
        """
        units = list(symbols)
        units[-1] += self.suffix
        n = len(units)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, heap = self.rank, []
        for i in range(n - 1):
            r = rank.get((units[i], units[i + 1]))
            if r is not None:
                heap.append((r, i, units[i], units[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if units[i] != left or j >= n or units[j] != right:
                continue
            units[i], units[j] = left + right, None
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                r = rank.get((units[i], units[k]))
                if r is not None:
                    heapq.heappush(heap, (r, i, units[i], units[k]))
            h = before[i]
            if h >= 0:
                r = rank.get((units[h], units[i]))
                if r is not None:
                    heapq.heappush(heap, (r, h, units[h], units[i]))
        return n - merges

    def word(self, word: str) -> int:
        return sum(self.piece(p) for p, _ in self.split(word))

    def whole(self, text: str) -> int:
        """Any text: special strings count one, what lies between is normalised and split."""
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self.word(self.normalise(text[at:m.start()])) + 1
            at = m.end()
        return total + self.word(self.normalise(text[at:]))

    def count(self, texts: list[str | None]) -> Iterator[int]:
        known = self.known
        for text in texts:
            words = words_of(text) if text else []
            if words is None:
                yield self.whole(text)
                continue
            if len(known) > KNOWN_WORDS:
                known.clear()
            for w in set(words).difference(known):
                known[w] = self.word(w)
            yield sum(map(known.__getitem__, words))


@functools.lru_cache(maxsize=2)
def word_ids(vocabulary: str, width: int = 4) -> WordIds:
    """One per worker process and vocabulary; tasks that follow find its words."""
    return WordIds(vocabulary, width)


@functools.lru_cache(maxsize=2)
def merge_counts(vocabulary: str) -> MergeCounts:
    return MergeCounts(vocabulary)


def token_count(text: Column | str, vocabulary: str | None = None) -> Column:
    """Column of token counts (bigint).

    Null and empty texts and texts of white space count 0.  A word of any length is merged whole.
    Equal texts give equal counts; no other column is read, so clashing names cannot matter.
    """
    path = vocabulary or default_vocabulary()
    bound_batches()

    @F.pandas_udf("bigint")
    def counts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = merge_counts(path)
        for part in parts:
            yield pd.Series(list(counter.count(part.tolist())), dtype="int64")

    return counts(text)
