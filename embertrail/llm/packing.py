"""Operator 12: packing tokenized documents into windows by the online sum-of-squares rule.

A document's ids are those of the tokenizers library with an end id behind them. Every partition packs its own documents as
they come. Of a document longer than a window, whole windows are cut off; what is left is placed as one piece where the sum
of squares of the level counts grows least, the level counts being how many partly filled windows hold so many tokens. Among
equally good levels the fullest is taken, and a new window is opened only where that is better. Windows on many different
levels cost little, many windows on one level cost much, so that levels to which nothing fits stay rare.

A partition holds at most MOST_OPEN partly filled windows. Beyond that, and at its end, they are poured into full windows one
after another, cutting pieces at the border. The last tokens of a partition become sequences of falling powers of two, which
are not padded. So every sequence is full or a power of two long.

The tokenizer drops white space and no token of it reaches across ASCII white space, so ids are looked up per word of a text,
and a worker remembers those of short words.

Defined cases: null and empty texts and texts of white space have the end id alone. Rows without an id and repeated rows are
packed row by row. An empty table gives no piece. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from embertrail.llm.common import utf8

WINDOW, END_ID = 4096, 2
# Partly filled windows that a task keeps, with their ids.
MOST_OPEN = 1024
# Words whose ids a worker remembers, and the longest that is remembered, in bytes.
WORDS, WORD_BYTES = 1_000_000, 48
# Words that are encoded as one text.
TOGETHER = 256
# Marks that are a token of their own behind a letter, and how words of letters are split.
MARKS = ".,;:!?"
# Fixed: the first character beyond Latin letters whose composed form and lower case are one character each, and the one
# letter before it whose lower case is two.
LATIN_END, DOTTED = "\u0250", "\u0130"
LEAN_STEPS = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
# Bytes of a text that are split into words at a time, and rows that are looked up together.
PIECE_BYTES, ROWS = 1 << 20, 128
BLANK = re.compile(rb"[ \t-\r]")
COLUMNS = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class WordIds:
    """The ids of texts as little-endian 32-bit numbers; made once per process from the broadcast tokenizer."""

    _made: dict[str, "WordIds"] = {}

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        self.tokenizer = Tokenizer.from_str(text)
        plan = json.loads(text)
        plan["normalizer"], plan["pre_tokenizer"] = None, {"type": "Sequence", "pretokenizers": LEAN_STEPS}
        self.lean = Tokenizer.from_str(json.dumps(plan))
        closing = plan["model"]["end_of_word_suffix"]
        self.closing = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        self.closing[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(closing)]] = True
        self.marks = {"": b"", **{m: self._encoded_each([m.encode()])[0] for m in MARKS}}
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def get(cls, text: str) -> "WordIds":
        key = hashlib.sha256(text.encode()).hexdigest()
        if key not in cls._made:
            cls._made[key] = cls(text)
        return cls._made[key]

    def _encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each word. A word of Latin letters, with at most one mark behind, needs neither normalizing beyond lower
        case nor a pattern to be split by, so many of them go through the lean tokenizer as one text."""
        plain, rest, out = [], [], {}
        for word in words:
            text = word.decode()
            stem, mark = (text, "") if text.isalpha() else (text[:-1], text[-1])
            if mark in self.marks and stem.isalpha() and (stem.isascii() or (max(stem) < LATIN_END and DOTTED not in stem)):
                plain.append((word, stem.lower(), mark))
            else:
                rest.append(word)
        groups = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        encoded = self.lean.encode_batch_fast([" ".join(stem for _, stem, _ in group) for group in groups], add_special_tokens=False)
        for group, e in zip(groups, encoded):
            ids = np.array(e.ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.closing[ids]) + 1)).tolist()  # every word has one closing token, its last
            held = ids.tobytes()
            out.update((word, held[low:high] + self.marks[mark]) for (word, _, mark), low, high in zip(group, [0, *ends], ends))
        out.update(zip(rest, self._encoded_each(rest)))
        return out

    def _encoded_each(self, words: list[bytes]) -> list[bytes]:
        """The ids of any words, many in one text and told apart by where their tokens begin, which is sure as long as
        normalizing leaves the characters in place."""
        out = []
        for at in range(0, len(words), TOGETHER):
            part = [w.decode() for w in words[at : at + TOGETHER]]
            text = " ".join(part)
            if not unicodedata.is_normalized("NFC", text):
                encoded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
                out += [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]
                continue
            encoded = self.tokenizer.encode(text, add_special_tokens=False)
            ids = np.array(encoded.ids, dtype="<u4").tobytes()
            begins = np.cumsum([0, *(len(w) + 1 for w in part)])
            cuts = (4 * np.searchsorted([first for first, _ in encoded.offsets], begins)).tolist()
            out += [ids[low:high] for low, high in zip(cuts, cuts[1:])]
        return out

    def _ids(self, groups: list[list[bytes]]) -> list[bytes]:
        """The ids of each group of words; what is not remembered is encoded once, all together."""
        new = list(set().union(*groups).difference(self.known))
        self.known.update(self._encoded(new))
        out = [b"".join(map(self.known.__getitem__, words)) for words in groups]
        if len(self.known) > WORDS:
            self.known.clear()
        else:
            for word in new:
                if len(word) > WORD_BYTES:
                    del self.known[word]
        return out

    def ids(self, texts: list[bytes]) -> list[bytes]:
        short = [t for t in texts if len(t) <= PIECE_BYTES]
        found = iter(self._ids([t.split() for t in short]))
        return [next(found) if len(t) <= PIECE_BYTES else self._long(t) for t in texts]

    def _long(self, text: bytes) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = BLANK.search(text, at + PIECE_BYTES)
            end = cut.start() if cut else len(text)
            out += self._ids([text[at:end].split()])
            at = end
        return b"".join(out)


class Packer:
    """Packs documents one after another; finished sequences are lists of (document, start, ids)."""

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.most_open = window, most_open
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list[tuple]]] = defaultdict(list)
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The level of the window that a piece of `size` goes to; 0 opens one."""
        held = np.flatnonzero(self.levels[: self.window - size + 1])
        if not len(held):
            return 0
        raised = held + size
        growth = np.where(raised == self.window, 0, 2 * self.levels[raised] + 1) - 2 * self.levels[held] + 1
        best = len(held) - 1 - int(growth[::-1].argmin())
        return int(held[best]) if growth[best] <= 2 * self.levels[size] + 1 else 0

    def add(self, document, ids: bytes) -> Iterator[list[tuple]]:
        """Packs a document given by its ids (4 bytes each); yields the sequences that this fills."""
        tokens, whole = len(ids) // 4, len(ids) // 4 // self.window * self.window
        for start in range(0, whole, self.window):
            yield [(document, start, ids[4 * start : 4 * (start + self.window)])]
        size = tokens - whole
        if not size:
            return
        level = self.level_for(size)
        window = []
        if level:
            window = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        window.append((document, whole, ids[4 * whole :]))
        if level + size == self.window:
            yield window
            return
        self._keep(level + size, window)
        if self.n_open > self.most_open:
            yield from self._pour()

    def _keep(self, level: int, window: list[tuple]) -> None:
        self.open[level].append(window)
        self.levels[level] += 1
        self.n_open += 1

    def _taken(self) -> list[tuple]:
        """All pieces of partly filled windows, the fullest windows first; none is open then."""
        pieces = [piece for level in sorted(self.open, reverse=True) for window in self.open[level] for piece in window]
        self.open.clear()
        self.levels[:] = 0
        self.n_open = 0
        return pieces

    def _cut(self, pieces: list[tuple], sizes: Iterator[int]) -> Iterator[tuple[int, list[tuple]]]:
        """The pieces, in order, in sequences of these sizes, and each sequence's tokens."""
        size, room, held = (first := next(sizes)), first, []
        for document, start, ids in pieces:
            while ids:
                part = ids[: 4 * room]
                held.append((document, start, part))
                ids, start, room = ids[len(part) :], start + len(part) // 4, room - len(part) // 4
                if not room:
                    yield size, held
                    size, held = (room := next(sizes, self.window)), []
        if held:
            yield size - room, held

    def _pour(self) -> Iterator[list[tuple]]:
        def full():
            while True:
                yield self.window

        for tokens, sequence in self._cut(self._taken(), full()):
            if tokens == self.window:
                yield sequence
            else:
                self._keep(tokens, sequence)

    def finish(self) -> Iterator[list[tuple]]:
        """The last sequences: full ones, then one for each binary digit of what is left, the largest first."""
        yield from self._pour()
        rest = self._taken()
        tokens = sum(len(ids) // 4 for *_, ids in rest)
        powers = (1 << k for k in range(tokens.bit_length() - 1, -1, -1) if tokens >> k & 1)
        if rest:
            yield from (sequence for _, sequence in self._cut(rest, powers))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, window: int = WINDOW, ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, its ids."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    end = np.array([end_id], dtype="<u4").tobytes()

    def rows(sequences: list[list[tuple]], first: int) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(8)]
        for number, sequence in enumerate(sequences, first):
            offset = 0
            for (doc_id, tokens), start, held in sequence:
                length = len(held) // 4
                row = (doc_id, start, length, zlib.crc32(held), tokens, number, offset, np.frombuffer(held, dtype="<i4") if ids else None)
                for column, value in zip(columns, row):
                    column.append(value)
                offset += length
        names = [part.split()[0] for part in COLUMNS.split(", ")]
        arrays = [pa.array(column, pa.int64()) for column in columns[:7]]
        if ids:
            arrays.append(pa.array(columns[7], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, [*names, "ids"] if ids else names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, packer = WordIds.get(shared.value), Packer(window)
        number = TaskContext.get().partitionId() << 33  # sequences are numbered from here on in this partition
        done: list[list[tuple]] = []
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for doc_id, found in zip(part.column(0).to_pylist(), codec.ids(utf8(part.column(1)))):
                    found += end
                    done += packer.add((doc_id, len(found) // 4), found)
                    if len(done) >= ROWS:
                        yield rows(done, number)
                        number, done = number + len(done), []
        done += packer.finish()
        if done:
            yield rows(done, number)

    schema = COLUMNS + (", ids array<int>" if ids else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def packed_sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids of every sequence of `pieces`, padded to the window unless a power of two long."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a window's pieces at most
    joined = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"), F.sum("length").alias("n_tokens"))
    short = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(window - F.col("n_tokens")).cast("int")
    return joined.select("sequence_id", "n_tokens", F.concat("ids", F.array_repeat(F.lit(pad_id), short)).alias("ids"))
