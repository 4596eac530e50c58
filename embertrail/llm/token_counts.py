"""Operator 9: greedy word-piece token counts by a linear longest-match automaton.

The vocabulary becomes a trie with failure links. Following a failure link pops whole pieces off the front of what has
been matched, and the link carries how many, so a word's greedy longest-match length comes from one walk over its
characters: no position is read twice and no piece is built. A piece that may start a word and one that may continue it
differ by a marker; the walk starts in the start root and fails into the continuation root.

Counting rule: a word's pieces are the longest match at its start, then the longest continuation, and so on. A word that
cannot be matched to its end is one unknown token.

Defined cases: a null or empty text has no words. Every row is counted by itself. An empty vocabulary makes every word
unknown. Other columns are passed through; result names replace equal ones.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embertrail.llm.common import Remembered, by_slices, utf8

# Fixed: the marker that the pieces of the vocabulary file carry at the start of a word.
MARKER = "▁"
START, CONTINUE = 0, 1


class PieceAutomaton:
    """Trie nodes with, for each, the failure link and how many pieces it pops (-1: none leads on)."""

    def __init__(self, starting: Iterable[str], continuing: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((START, starting), (CONTINUE, continuing)):
            for piece in pieces:
                node = root
                for char in piece:
                    step = self.next[node].get(char)
                    if step is None:
                        step = self.next[node][char] = len(self.next)
                        self.next.append({})
                        final.append(False)
                    node = step
                final[node] = final[node] or bool(piece)
        self.link, self.popped = [-1] * len(self.next), [0] * len(self.next)
        waiting = deque([START, CONTINUE])
        while waiting:  # nearest to a root first, so links of shorter strings are known
            node = waiting.popleft()
            for char, child in self.next[node].items():
                if final[child]:
                    self.link[child], self.popped[child] = CONTINUE, 1
                else:  # pop what the parent pops, then go on until the character fits
                    back, count = self.link[node], self.popped[node]
                    while back >= 0 and char not in self.next[back]:
                        back, count = self.link[back], count + self.popped[back]
                    if back >= 0:
                        self.link[child], self.popped[child] = self.next[back][char], count
                waiting.append(child)

    def pieces(self, word: str) -> int:
        """How many pieces the word has; 0 if it cannot be matched to its end."""
        node, count, following, link, popped = START, 0, self.next, self.link, self.popped
        for char in word:
            while (step := following[node].get(char)) is None:
                count += popped[node]
                node = link[node]
                if node < 0:
                    return 0
            node = step
        while node > CONTINUE:  # the word has ended: pop what is still matched
            count += popped[node]
            node = link[node]
        return count if node == CONTINUE else 0


def read_pieces(path: str) -> tuple[list[str], list[str]]:
    """Starting and continuing pieces of a sentencepiece model, without its control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[1:] for p in ordinary if p.startswith(MARKER) and len(p) > 1], [p for p in ordinary if not p.startswith(MARKER)]


def count_tokens(df: DataFrame, pieces: tuple[list[str], list[str]], column: str = "text") -> DataFrame:
    """Adds n_words, n_tokens and n_unknown. The vocabulary is broadcast; its size does not depend on the data."""
    shared = df.sparkSession.sparkContext.broadcast(pieces)
    names = ["n_words", "n_tokens", "n_unknown"]
    kept = [c for c in df.columns if c not in names]
    at = kept.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = PieceAutomaton(*shared.value)
        known = Remembered(lambda word: automaton.pieces(word.decode("utf-8", "replace")), 300_000)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = [[known[word] for word in text.split()] for text in utf8(batch.column(at))]
            unknown = [c.count(0) for c in counts]
            arrays = [pa.array([len(c) for c in counts], pa.int64()), pa.array([sum(c) + u for c, u in zip(counts, unknown)], pa.int64()), pa.array(unknown, pa.int64())]
            return pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*kept, *names])

        yield from by_slices(work)(batches)

    shown = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema.fields), *(f"{n} bigint" for n in names)])
    return shown.mapInArrow(run, schema)
