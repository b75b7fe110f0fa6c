"""Operator 2, token counts: greedy longest-match word pieces counted by a linear automaton.

The vocabulary is a trie. A node's failure link leads to the node that stands
for what remains once the longest pieces have been popped from its string, and
the number of pieces popped on the way is kept beside it. A word's count is
the sum of those numbers along one pass; no piece is built.

Defined results: a null or empty text has 0 words and 0 tokens. A word in
which some position starts no piece counts as one unknown token. Texts and words of
any length are counted whole, in linear time. Repeated rows are counted one by
one; further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import default_tokenizer, slices

_FAIL = -1


class Automaton:
    """``count(word)``: pieces that greedy longest match takes for ``word``, from left to right."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                to = self.next[node].get(byte)
                if to is None:
                    to = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = to
            if node:
                ends[node] = True
        self.link, self.popped = [_FAIL] * len(self.next), [0] * len(self.next)
        queue = deque((node, 0, byte) for byte, node in self.next[0].items())
        while queue:
            node, parent, byte = queue.popleft()
            if ends[node]:
                self.link[node], self.popped[node] = 0, 1
            else:
                # Pop what the parent would pop until the byte can follow.
                at, popped = self.link[parent], self.popped[parent]
                while at != _FAIL and byte not in self.next[at]:
                    popped += self.popped[at]
                    at = self.link[at]
                if at != _FAIL:
                    self.link[node], self.popped[node] = self.next[at][byte], popped
            queue.extend((to, node, b) for b, to in self.next[node].items())

    def count(self, word: bytes) -> int:
        node = total = 0
        to_next, link, popped = self.next, self.link, self.popped
        for byte in word:
            while (to := to_next[node].get(byte)) is None:
                total += popped[node]
                node = link[node]
                if node == _FAIL:
                    return 1
            node = to
        while node:
            total += popped[node]
            node = link[node]
            if node == _FAIL:
                return 1
        return total


def byte_pieces(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file as byte strings."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return [bytes(of[c] for c in piece) for piece in vocabulary if all(c in of for c in piece)]


@functools.cache
def _automaton(path: str) -> tuple[Automaton, dict[bytes, int]]:
    return Automaton(byte_pieces(path)), {}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, max_words: int = 1_000_000) -> DataFrame:
    """``doc_id, n_words, n_tokens``; each worker counts a distinct word once, in a cache of ``max_words`` words."""
    path = vocabulary or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(path)
        for whole in batches:
            for batch in slices(whole):
                words, tokens = [], []
                for text in batch.column(1).cast(pa.binary()).to_pylist():
                    own = text.split() if text else []  # splits at space and bytes 9 to 13
                    for word in set(own):
                        if word not in known:
                            known[word] = automaton.count(word)
                    words.append(len(own))
                    tokens.append(sum(map(known.__getitem__, own)))
                    if len(known) > max_words:
                        known.clear()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
