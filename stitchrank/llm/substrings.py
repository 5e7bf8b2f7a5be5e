"""Operator 7: substring dedup of words by suffix automata of reference shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from stitchrank.llm import repeats
from stitchrank.llm.common import table

LENGTH = 20
ANCHOR = 8
# Bytes of contents in one automaton.
SHARD_BYTES = 300_000


class SuffixAutomaton:
    """Of a list of word sequences: the smallest automaton that reads all their parts.

    Every state knows the place (sequence, end) where its strings end first; sequences are added
    in the order in which "first" is meant.
    """

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.place = [-1], [0], [-1]

    def _state(self, size: int, place: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.place.append(place)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state for the strings of ``q`` that are as short as an extension of ``p``."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, self.place[q], self.next[q].copy(), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, index: int, words: list[bytes]) -> None:
        edges, link = self.next, self.link
        last, place = 0, index << 32
        for end, word in enumerate(words):
            q = edges[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
                continue
            state = self._state(self.size[last] + 1, place | end, {}, 0)
            p = last
            while p >= 0 and word not in edges[p]:
                edges[p][word] = state
                p = link[p]
            if p >= 0:
                link[state] = self._split(p, word, edges[p][word])
            last = state

    def statistics(self, words: list[bytes], length: int):
        """(end, first place) wherever at least ``length`` words up to ``end`` occur in the automaton.

        The matching statistic is kept along the words: a step that fails follows suffix links. It
        is held at the shortest state of ``length`` words or more, whose place is that of the window.
        """
        edges, link, size, place = self.next, self.link, self.size, self.place
        state, match = 0, 0
        for end, word in enumerate(words):
            while state and word not in edges[state]:
                state = link[state]
                match = size[state]
            following = edges[state].get(word)
            if following is None:
                continue
            state, match = following, match + 1
            if match >= length:
                while size[link[state]] >= length:
                    state = link[state]
                match = min(match, size[state])
                yield end, place[state]


def first_windows(contents: list[bytes], names: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Resolver: the first occurrence of every window, by matching statistics against a shard's automaton."""
    words = [c.split() for c in contents]
    automaton = SuffixAutomaton()
    for i, w in enumerate(words):
        automaton.add(i, w)
    count = np.array([len(w) - length + 1 for w in words])
    places = np.array([place for w in words for _, place in automaton.statistics(w, length)], np.int64)
    return count, places >> 32, (places & 0xFFFFFFFF) - length + 1


def substring_dedup(docs: DataFrame, length: int = LENGTH, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans and kept_sha256 of every row; with ``text``, the words left.

    A word goes if a window of ``length`` words over it also starts earlier, in a smaller doc_id or
    before in the same text. Null ids come after all others and count as one id; rows of one id are one document
    to each other only by place. Null, empty and shorter texts lose nothing. No window spans two texts.

    Reference shards are the runs of windows that may repeat, routed by anchor; their automata grow
    with the corpus, so each is built where its documents are streamed and none is sent to all tasks.
    """
    windows = repeats.Windows(length, min(ANCHOR, length), words=True, within=True)
    rows = repeats.keyed(docs)
    spans = repeats.repeated_spans(rows, windows, first_windows, SHARD_BYTES)
    return repeats.finished(rows, spans, words=True, text=text).withColumnRenamed("n", "n_words")


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents")).drop("n_spans")
