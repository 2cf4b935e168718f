"""Operator 3: word-piece counts by a linear longest-match automaton.

Words are runs of bytes that are not ASCII white space; a word's pieces are found greedily, longest first, in
one space and the word's bytes. The vocabulary's trie gets failure links: where no child goes on, the node's
popped tokens are counted and matching goes on at its link, so that each byte is read once and no piece is
built. Pieces are the entries of a byte-level vocabulary, which holds every single byte; so no word is unknown.

Null and empty texts have no words and no pieces. Repeated rows each give a row; words have no length limit."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession

from .bpe import default_vocabulary, vocabulary
from .common import map_texts, read_table

#: Counts that a worker remembers at most, and the longest word that it remembers.
MEMORY_WORDS, LONGEST_KEPT = 500_000, 64


class Automaton:
    """child[node * 256 + byte]: the node after a byte; link and pops: where matching goes on, and after how
    many more tokens, if there is no child."""

    def __init__(self, pieces: list[bytes]):
        self.child: dict[int, int] = {}
        token, depth, edges = [False], [0], [[]]
        for piece in pieces:
            node = 0
            for b in piece:
                nxt = self.child.get(node * 256 + b)
                if nxt is None:
                    nxt = self.child[node * 256 + b] = len(token)
                    edges[node].append((b, nxt))
                    token.append(False)
                    depth.append(depth[node] + 1)
                    edges.append([])
                node = nxt
            token[node] |= bool(piece)
        if missing := [b for b in range(256) if not (n := self.child.get(b)) or not token[n]]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.link, self.pops = [0] * len(token), [0] * len(token)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for b, nxt in edges[node]:
                queue.append(nxt)
                if token[nxt]:
                    self.link[nxt], self.pops[nxt] = 0, 1
                    continue
                # The node's own text is no token: pop as its parent does, then try to go on with the byte.
                at, popped = self.link[node], self.pops[node]
                while (go := self.child.get(at * 256 + b)) is None:
                    popped += self.pops[at]
                    at = self.link[at]
                self.link[nxt], self.pops[nxt] = go, popped

    def count(self, data: bytes) -> int:
        """Pieces of one word."""
        child, link, pops = self.child, self.link, self.pops
        node = total = 0
        for b in data:
            while (nxt := child.get(node * 256 + b)) is None:
                total += pops[node]
                node = link[node]
            node = nxt
        while node:
            total += pops[node]
            node = link[node]
        return total


class Lengths(dict):
    """Word to number of pieces, found when first asked for."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= LONGEST_KEPT:
            self[word] = n
        return n


def token_counts(df: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, n_words, n_pieces and the longest word's pieces of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(Automaton(vocabulary(path)[1]))

    def make():
        lengths = Lengths(shared.value)

        def f(texts, _):
            if len(lengths) > MEMORY_WORDS:
                lengths.clear()
            words = [t.split() for t in texts]
            each = [list(map(lengths.__getitem__, w)) for w in words]
            return {"n_words": [len(w) for w in words], "n_pieces": [sum(x) for x in each], "max_word_pieces": [max(x, default=0) for x in each]}

        return f

    return map_texts(df, make, "n_words long, n_pieces long, max_word_pieces long", text, keys)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), default_vocabulary())
