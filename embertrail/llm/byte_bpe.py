"""Operator 6: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Ranks of byte strings become a vocabulary of printable characters (each byte stands for one character) and a merge for
every way in which two ranked parts make up a ranked whole, in order of rank, which gives the ids that a merge by rank
gives. Decoding maps every id back to its bytes; characters that a token boundary splits come together again when the
bytes are joined, and bytes that are no whole character decode to U+FFFD in the text form.

Texts are looked up by parts, and a worker remembers the ids of short ones. With the pattern SPACED a part is what lies between
two spaces or line ends: no match of that pattern goes on behind a lone space or line end, so a part has the same matches in
every text. Texts with other white space, and other patterns, are looked up match by match. What is not remembered is encoded
many matches at a time, written in the characters of their bytes and told apart by the bytes of their tokens.

Defined cases: a null text is encoded as an empty one, which has no ids. Null ids decode to no bytes. Other columns are
passed through untouched by `encode_texts` and `decode_ids`; a column of theirs that has the name of a result is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embertrail.llm.common import by_slices

# Texts that are held as encodings at a time.
ENCODED_ROWS = 64
# Parts of texts whose ids a worker remembers, and the longest that is remembered.
PIECES, PIECE_CHARS = 1_000_000, 48
# Matches that are encoded as one text.
TOGETHER = 256
# Fixed: the pattern whose matches end before every lone space and around every lone line end.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    prints = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """The tokenizer of these ranks, as text that every executor can load."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    shown = byte_characters()
    word = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = [
        (word[token[:at]], word[token[at:]])
        for token in sorted(ranks, key=ranks.get) for at in range(len(token) - 1, 0, -1)
        if token[:at] in ranks and token[at:] in ranks
    ]
    made = Tokenizer(models.BPE(vocab={word[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    made.decoder = decoders.ByteLevel()
    return made.to_str()


class Codec:
    """Encodes and decodes on one worker; made once per process from the broadcast tokenizer."""

    _made: dict[str, "Codec"] = {}

    def __init__(self, text: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        self.tokenizer = Tokenizer.from_str(text)
        pattern = json.loads(text)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split, self.spaced = regex.compile(pattern), pattern == SPACED
        self.words = Tokenizer.from_str(text)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        shown = byte_characters()
        self.shown = {b: c for b, c in enumerate(shown) if chr(b) != c} | {0xFF: " "}  # no UTF-8 text holds this byte
        self.known: dict[str, bytes] = {}
        back = {c: b for b, c in enumerate(shown)}
        self.bytes = {i: bytes(back[c] for c in token) for token, i in self.tokenizer.get_vocab().items()}
        self.by_id = np.full((2, max(self.bytes) + 1), None, dtype=object)  # the bytes and the decimal form of every id
        for i, own in self.bytes.items():
            self.by_id[:, i] = own, str(i)
        self.sizes = np.array([len(x or b"") for x in self.by_id[0]])
        self.line_end = len(self._encoded(["\n"])[0])

    @classmethod
    def get(cls, shared) -> "Codec":
        text = shared.value
        key = hashlib.sha256(text.encode()).hexdigest()
        if key not in cls._made:
            cls._made[key] = cls(text)
        return cls._made[key]

    def _encoded(self, matches: list[str]) -> list[bytes]:
        """The ids of each match of the pattern, as little-endian 32-bit numbers."""
        groups = [matches[at : at + TOGETHER] for at in range(0, len(matches), TOGETHER)]
        groups = [[m.encode() for m in group] for group in groups]
        texts = [b"\xff".join(group).decode("latin-1").translate(self.shown) for group in groups]
        out = []
        for group, e in zip(groups, self.words.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            reached = np.cumsum(self.sizes[ids])  # a match ends with the token that reaches its last byte
            ends = (4 * (np.searchsorted(reached, np.cumsum([*map(len, group)])) + 1)).tolist()
            held = ids.tobytes()
            out += [held[low:high] for low, high in zip([0, *ends], ends)]
        return out

    @staticmethod
    def _key(match: str) -> str:
        """A match as a part: with the space before it left out, or with one put before it if it has none."""
        return match[1:] if match[0] == " " and not match.isspace() else " " + match

    def _parts(self, text: str) -> list[str]:
        """A part begins with a line end, or stands for itself with a space before it; the first one gets a line end."""
        return ("\n" + text).replace("\n", " \n").split(" ")[1:]

    @staticmethod
    def _is_part(part: str) -> bool:
        """Whether no other white space is in a part; else the pattern may go on behind it."""
        own = part[1:] if part[:1] == "\n" else part
        return own.split() == [own]

    def _learned(self, parts: set[str]) -> dict[str, bytes]:
        """The ids of parts that are not remembered; each match in them is encoded once."""
        single, several = set(), {}
        for part in parts:
            if part[0] == " " or not self.spaced or (part.isascii() and part.isalpha()):
                single.add(part)
                continue
            matches = self.split.findall(part if part[0] == "\n" else " " + part)
            if len(matches) == 1:
                single.add(part)
            else:
                several[part] = keys = [*map(self._key, matches)]
                single.update([key for key in keys if key not in self.known])
        new = [*single]
        fresh = dict(zip(new, self._encoded([key[1:] if key[0] == " " else " " + key for key in new])))
        for part, keys in several.items():
            fresh[part] = b"".join([fresh[key] if key in fresh else self.known[key] for key in keys])
        self.known.update(fresh if max(map(len, fresh), default=0) <= PIECE_CHARS else {key: ids for key, ids in fresh.items() if len(key) <= PIECE_CHARS})
        return fresh

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers; every distinct part is encoded once and remembered."""
        if len(self.known) > PIECES:
            self.known.clear()
        parts, found, new = [], [], set()
        for text in texts:
            own = self._parts(text) if self.spaced else []
            ids = [*map(self.known.get, own)]
            missing = {part for part, held in zip(own, ids) if held is None} if None in ids else set()
            if not (own and all(map(self._is_part, missing))):
                own = [*map(self._key, self.split.findall(text))]
                ids = [b"", *map(self.known.get, own)]
                missing = {part for part, held in zip(own, ids[1:]) if held is None}
                own = ["", *own]
            parts.append(own)
            found.append(ids)
            new |= missing
        fresh = self._learned(new)
        out = []
        for own, ids in zip(parts, found):
            if None in ids:
                ids = [fresh[part] if held is None else held for part, held in zip(own, ids)]
            ids[0] = ids[0][self.line_end :]  # nothing, or the line end that was put before the text
            out.append(b"".join(ids))
        return out

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(ids, dtype="<u4").tolist() for ids in self.packed(texts)]

    def ids_and_offsets(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids with the (start, end) code points that each token touches."""
        return [(e.ids, e.offsets) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decoded(self, packed: bytes) -> bytes:
        return b"".join(self.by_id[0, np.frombuffer(packed, dtype="<u4")].tolist())

    def listed(self, packed: bytes) -> str:
        """Decimal ids joined by commas."""
        return ",".join(self.by_id[1, np.frombuffer(packed, dtype="<u4")].tolist())


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _added(df: DataFrame, read: str, work, added: str, names: list[str]) -> DataFrame:
    """`df` with the columns that `work` makes from column `read`, in small slices."""
    kept = [c for c in df.columns if c not in names]
    at = kept.index(read)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [work(batch.column(at).slice(i, ENCODED_ROWS)) for i in range(0, batch.num_rows, ENCODED_ROWS)] or [work(batch.column(at))]
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.concat_arrays(list(x)) for x in zip(*parts))], [*kept, *names])

    shown = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema.fields), added])
    return shown.mapInArrow(by_slices(run), schema)


def encode_texts(df: DataFrame, tokenizer: str, column: str = "text") -> DataFrame:
    """Adds `ids`, and `starts` and `ends`, the code points of `column` that each token touches."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def work(texts: pa.Array) -> tuple[pa.Array, ...]:
        found = Codec.get(shared).ids_and_offsets(_texts(texts))
        lists = ([x[0] for x in found], [[a for a, _ in x[1]] for x in found], [[b for _, b in x[1]] for x in found])
        return tuple(pa.array(x, pa.list_(pa.int32())) for x in lists)

    return _added(df, column, work, "ids array<int>, starts array<int>, ends array<int>", ["ids", "starts", "ends"])


def decode_ids(df: DataFrame, tokenizer: str, column: str = "ids") -> DataFrame:
    """Adds `decoded`, the bytes of the ids, and `decoded_text`, in which bytes of no whole character are U+FFFD."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def work(ids: pa.Array) -> tuple[pa.Array, ...]:
        found = [Codec.get(shared).decode(x or []) for x in ids.to_pylist()]
        return pa.array(found, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in found], pa.string())

    return _added(df, column, work, "decoded binary, decoded_text string", ["decoded", "decoded_text"])


def round_trip_digests(df: DataFrame, tokenizer: str, column: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256, without handing on the ids."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]

    def work(texts: pa.Array) -> tuple[pa.Array, ...]:
        codec = Codec.get(shared)
        found = codec.packed(_texts(texts))
        return (
            pa.array([len(x) // 4 for x in found], pa.int64()),
            pa.array([hashlib.sha256(codec.listed(x).encode()).hexdigest() for x in found]),
            pa.array([hashlib.sha256(codec.decoded(x)).hexdigest() for x in found]),
        )

    return _added(df, column, work, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", names)


def tokenized(df: DataFrame, tokenizer: str, column: str = "text") -> DataFrame:
    """Adds n_tokens, ids and exact (whether the ids decode to the very bytes of the text)."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def work(texts: pa.Array) -> tuple[pa.Array, ...]:
        codec, own = Codec.get(shared), _texts(texts)
        found = codec.packed(own)
        exact = [codec.decoded(ids) == text.encode() for ids, text in zip(found, own)]
        sizes = np.array([len(x) // 4 for x in found], dtype=np.int64)
        lists = pa.ListArray.from_arrays(np.concatenate(([0], sizes.cumsum())).astype(np.int32), np.frombuffer(b"".join(found), dtype="<i4"))
        return pa.array(sizes), lists, pa.array(exact, pa.bool_())

    return _added(df, column, work, "n_tokens bigint, ids array<int>, exact boolean", ["n_tokens", "ids", "exact"])
