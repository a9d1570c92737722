"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces that begin a word and one for those that go on. Each node has a failure
link, the node to go on from once the longest pieces of its string have been cut off, and the number of pieces cut off on the
way. So a word is read once, character by character, whatever its length, and the pieces themselves are never built.

Defined results: a null or empty text has no words and no pieces; a word that cannot be cut is one unknown piece; repeated rows
are counted separately; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenfile import byte_letters, vocabulary_path

CACHE, BEGIN = 400_000, "Ġ"


class LongestMatch:
    """Automaton over (begin pieces, inner pieces); count(word): (pieces, 1 if unknown)."""

    def __init__(self, begin, inner):
        self.next: list[dict] = [{}, {}]
        ends = set()
        for root, pieces in ((0, begin), (1, inner)):
            for piece in pieces:
                if not piece:
                    continue
                v = root
                for c in piece:
                    if c not in self.next[v]:
                        self.next[v][c] = len(self.next)
                        self.next.append({})
                    v = self.next[v][c]
                ends.add(v)
        self.fail: list[int | None] = [None] * len(self.next)
        self.pops = [0] * len(self.next)
        queue = [0, 1]
        for u in queue:  # by depth: a node's link goes to a node of less depth
            for c, v in self.next[u].items():
                queue.append(v)
                if v in ends:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                z, cut = self.fail[u], self.pops[u]
                while z is not None and c not in self.next[z]:
                    cut += self.pops[z]
                    z = self.fail[z]
                if z is not None:
                    self.fail[v], self.pops[v] = self.next[z][c], cut

    def count(self, word: str) -> tuple[int, int]:
        u, n = 0, 0
        for c in word:
            while c not in self.next[u]:
                n += self.pops[u]
                if (u := self.fail[u]) is None:
                    return 1, 1
            u = self.next[u][c]
        while u != 1:
            n += self.pops[u]
            if (u := self.fail[u]) is None:
                return 1, 1
        return n, 0


@lru_cache(maxsize=1)
def load(path: str) -> LongestMatch:
    """One automaton a worker process, from a byte-level vocabulary: pieces that start with the letter of the space begin words, others go on."""
    pieces = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    return LongestMatch([p for p in pieces if p.startswith(BEGIN)], [p for p in pieces if not p.startswith(BEGIN)])


def _counted(path: str):
    def run(batches):
        match, table, known = load(path), dict(enumerate(byte_letters())), {}

        def missing(word: bytes) -> tuple[int, int]:
            if len(known) > CACHE:
                known.clear()
            found = known[word] = match.count(BEGIN + word.decode("latin-1").translate(table))
            return found

        for b in batches:
            rows = []
            for text in b.column("t").to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()
                found = [known.get(w) or missing(w) for w in words]
                rows.append((len(words), sum(x[0] for x in found), sum(x[1] for x in found)))
            counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every whole text; keys of any type pass through as Arrow."""
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_counted(vocabulary or vocabulary_path()), f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
