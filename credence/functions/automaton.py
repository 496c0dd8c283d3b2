"""All keywords of many dictionaries in one pass over the text.

The keywords of all dictionaries become one automaton (a trie with fail links), built once in every
worker.  It reads a batch of texts as one string, and the hits are counted by text and dictionary.
The work depends on the length of the texts and their hits, not on the number of keywords, and the
plan holds one Arrow step in place of an expression for every keyword.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Texts are read together up to this many characters.
CHUNK = 1 << 22
#: Stands between two texts.  No keyword holds it, so no hit reaches over it.
BREAK = "\0"


def self_overlapping(word: str) -> bool:
    """Whether two occurrences of the word can overlap."""
    return any(word.endswith(word[:n]) for n in range(1, len(word)))


def _chunks(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Cuts of a row of texts into runs of at most `most` characters, one text at least."""
    first, held, at = 0, 0, -1
    for at, size in enumerate(sizes):
        if held and held + size > most:
            yield first, at
            first, held = at, 0
        held += size
    if at >= 0:
        yield first, at + 1


@dataclass(frozen=True)
class KeywordAutomaton:
    """Dictionaries of keywords, matched as substrings or, if asked for, as whole words."""
    groups: Mapping[str, tuple[str, ...]]
    whole_words: bool = False

    @cached_property
    def words(self) -> list[str]:
        words = sorted({w for g in self.groups.values() for w in g})
        if any(not w or BREAK in w for w in words):
            raise ValueError("a keyword is empty or holds a null character")
        return words

    @cached_property
    def _membership(self) -> np.ndarray:
        """How often a word is listed in each dictionary (once at most)."""
        return np.array([[w in set(g) for g in self.groups.values()] for w in self.words],
                        np.int64).reshape(len(self.words), len(self.groups))

    @cached_property
    def _automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for number, word in enumerate(self.words):
            found.add_word(word, number)
        found.make_automaton()
        return found

    def __getstate__(self) -> dict:
        # Workers build the automaton themselves.
        return {"groups": {k: tuple(v) for k, v in self.groups.items()},
                "whole_words": self.whole_words}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def count_all(self, texts: list[str | None]) -> np.ndarray:
        """One row per text, one column per dictionary: occurrences of its keywords, each keyword
        counted on its own and without overlaps with itself.  A null text has none."""
        counts = [self._chunk(["" if t is None else t for t in texts[a:b]])
                  for a, b in _chunks((len(t or "") + 1 for t in texts), CHUNK)]
        return np.concatenate(counts) if counts else np.zeros((0, len(self.groups)), np.int64)

    def _chunk(self, texts: list[str]) -> np.ndarray:
        if not self.words:
            return np.zeros((len(texts), len(self.groups)), np.int64)
        joined = BREAK.join(texts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        hits = np.fromiter(chain.from_iterable(self._automaton.iter(joined)), np.int64).reshape(
            -1, 2)
        hits = hits[self._kept(joined, hits)]
        place = np.searchsorted(ends, hits[:, 0], side="right") * len(self.words) + hits[:, 1]
        text, word = np.divmod(place, len(self.words))
        member = self._membership
        return np.stack([np.bincount(text[held], minlength=len(texts)) for held in (
            member[word, g] > 0 for g in range(len(self.groups)))], axis=1) \
            if len(self.groups) else np.zeros((len(texts), 0), np.int64)

    def _kept(self, joined: str, hits: np.ndarray) -> np.ndarray:
        """Without hits that overlap the same word's last, or inside words if those must be whole."""
        sizes = np.array([len(w) for w in self.words])
        keep = np.ones(len(hits), bool)
        if self.whole_words:
            plain = np.frombuffer(f" {joined} ".encode("utf-32-le"), "<u4")
            inside = ((plain >= 48) & (plain <= 57) | (plain >= 65) & (plain <= 90)
                      | (plain >= 97) & (plain <= 122) | (plain == 95))
            keep = ~inside[hits[:, 0] + 2] & ~inside[hits[:, 0] + 1 - sizes[hits[:, 1]]]
        again = np.array([self_overlapping(w) for w in self.words])
        last: dict[int, int] = {}
        for i in np.flatnonzero(keep & again[hits[:, 1]]).tolist():
            end, word = hits[i].tolist()
            if end - sizes[word] < last.get(word, -1):
                keep[i] = False
            else:
                last[word] = end
        return keep

    def counts(self, text: Column) -> Column:
        """struct<dictionary: int> of `count_all` of a text column.  Zeros for null."""
        names = list(self.groups)
        schema = ", ".join(f"`{n}` int" for n in names)

        @F.arrow_udf(f"struct<{schema}>")
        def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                found = self.count_all(batch.to_pylist()).astype(np.int32)
                yield pa.StructArray.from_arrays(
                    [pa.array(found[:, i]) for i in range(len(names))], names)

        return counted(text)
