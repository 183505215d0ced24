"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

Merging by rank gives every byte string one token sequence, and dropping the last token of that sequence leaves the
sequence of the shorter prefix. So each prefix has exactly one valid last token, and storing it for every prefix
stores the encodings of all prefixes: a token ending at a place is the valid one if it may follow the last token of the
prefix before it, which is a question about two tokens only. ``Prefixes`` keeps these last tokens; appended bytes
continue the table, and after an edit only the places are computed anew whose last token can have changed.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable
from contextlib import suppress
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame

from claimweave.llm.common import HELD_BYTES, mapped, text_bytes

#: Pieces and token pairs whose encoding a task remembers; beyond it the memory starts anew.
REMEMBERED = 200_000
NONE = 1 << 60


class Lefts(dict):
    """Whether a token may come after another one, by the latter; asked once for each that turns up."""

    __slots__ = ("vocabulary", "right")

    def __init__(self, vocabulary: Vocabulary, right: int):
        self.vocabulary, self.right = vocabulary, right

    def __missing__(self, left: int) -> bool:
        found = self[left] = self.vocabulary.may_follow(left, self.right)
        return found


class Vocabulary:
    """Ranks of a vocabulary file: per line a token in base 64 and its rank, which is its id."""

    def __init__(self, lines: bytes):
        self.rank: dict[bytes, int] = {}
        for line in lines.splitlines():
            if line.strip():
                token, rank = line.split()
                self.rank[base64.b64decode(token)] = int(rank)
        self.token = {rank: token for token, rank in self.rank.items()}
        self.longest = max(map(len, self.rank), default=0)
        self.size = {rank: len(token) for rank, token in self.token.items()}
        # Both by rank; a taken column's values lie one after the other, which is the joined whole.
        ranks = range(max(self.token, default=-1) + 1)
        self.parts = pa.array([self.token.get(rank) for rank in ranks], pa.large_binary())
        self.decimals = pa.array([b"%d," % rank if rank in self.token else None for rank in ranks], pa.large_binary())
        self._held = 0
        self._after: list[Lefts] = []
        self._histories: dict[int, list[tuple[int, bytes, bytes]]] = {}
        # Finds all tokens that end at each place of a text. Tokens that merging never makes are not among them.
        self.ending = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            if len(self.merged(token)) == 1:
                self._after.append(Lefts(self, rank))
                self.ending.add_word(token.decode("latin-1"), (len(token), rank, self._after[-1]))
        self.ending.make_automaton()

    def merged(self, data: bytes, history: list | None = None) -> list[bytes]:
        """Parts of a short string after merging adjacent parts, lowest rank first, the leftmost on ties.

        ``history`` gets a triple per state: rank of the next merge, first part and last part.
        """
        rank = self.rank.get
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [rank(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while True:
            best = min(ranks, default=NONE)
            if history is not None:
                history.append((best, parts[0], parts[-1]))
            if best == NONE:
                return parts
            place = ranks.index(best)
            parts[place] += parts.pop(place + 1)
            del ranks[place]
            if place:
                ranks[place - 1] = rank(parts[place - 1] + parts[place], NONE)
            if place < len(ranks):
                ranks[place] = rank(parts[place] + parts[place + 1], NONE)

    def history(self, token: int) -> list[tuple[int, bytes, bytes]]:
        known = self._histories.get(token)
        if known is None:
            known = self._histories[token] = []
            self.merged(self.token[token], known)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these two tokens.

        Until a merge crosses the border, each side merges as it does alone; so both histories are followed, the lower
        rank first, and a merge across the border would have to come before the next one on the left and not
        after the next one on the right.
        """
        rank = self.rank.get
        lefts, rights = self.history(left), self.history(right)
        i = j = 0
        while True:
            (next_left, _, tail), (next_right, head, _) = lefts[i], rights[j]
            across = rank(tail + head, NONE)
            if across < next_left and across <= next_right and across < NONE:
                return False
            if next_left == NONE and next_right == NONE:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def may_follow(self, left: int, right: int) -> bool:
        if self._held >= REMEMBERED:
            self.forget()
        self._held += 1
        return self._stay_apart(left, right)

    def forget(self) -> None:
        for lefts in self._after:
            lefts.clear()
        self._held = 0

    def extend(self, last: list[int], data: bytes, offset: int = 0) -> None:
        """Continue ``last`` up to the end of ``data``, which holds the bytes from ``offset`` on."""
        place, add = len(last), last.append
        found = self.ending.iter(data.decode("latin-1"))
        if not offset:  # by far the most calls; the same without shifting
            for end, (size, token, lefts) in found:
                if end == place:
                    if size > end or lefts[last[end - size]]:
                        add(token)
                        place += 1
                elif end > place:
                    break  # no token ends at the place before
        else:
            for end, (size, token, lefts) in found:
                end += offset
                if end < place:
                    continue
                if end > place:
                    break
                if size > end or lefts[last[end - size]]:
                    add(token)
                    place += 1
        if place < offset + len(data):
            raise ValueError("the vocabulary lacks a single byte")

    def walk(self, last: list[int], end: int) -> list[int]:
        """The tokens of the prefix up to ``end``, from the last tokens of the prefixes."""
        out = []
        size = self.size
        while end:
            token = last[end - 1]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out


class Prefixes:
    """The unique valid last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Continue with more bytes; the entries so far stay."""
        self.data += data
        back = max(0, len(self.last) - self.vocabulary.longest)  # a token that ends in the new bytes may begin before them
        self.vocabulary.extend(self.last, bytes(self.data[back:]), back)

    def edit(self, start: int, end: int, data: bytes) -> int:
        """Replace the bytes from ``start`` to ``end``; returns how many entries were computed anew.

        Entries before the edit stay. Behind it an entry looks back at most one token length, so once a stretch as long
        as the longest token agrees with the old table, the rest does too.
        """
        rest_data, rest_last = bytes(self.data[end:]), self.last[end:]
        del self.data[start:], self.last[start:]
        self.append(data)
        agreeing, done, step = 0, 0, self.vocabulary.longest
        while done < len(rest_data) and agreeing < step:
            self.append(rest_data[done : done + step])
            for new, old in zip(self.last[len(self.last) - len(rest_data[done : done + step]) :], rest_last[done : done + step]):
                agreeing = agreeing + 1 if new == old else 0
            done += step
        self.data += rest_data[done:]
        self.last += rest_last[done:]
        return len(data) + min(done, len(rest_data))

    def tokens(self, end: int | None = None) -> list[int]:
        """Encoding of the prefix up to ``end``."""
        return self.vocabulary.walk(self.last, len(self.data) if end is None else end)


class Encoder:
    """Encodes whole texts: each match of the pattern by itself, a match that is a token at once."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.pieces = regex.compile(pattern).findall
        # Ids as bytes, four each: these join fast, and the garbage collector does not visit them.
        self._whole: dict[str, bytes] = {}
        for token, rank in vocabulary.rank.items():
            with suppress(UnicodeDecodeError):  # a part of a character matches nothing
                self._whole[token.decode()] = array("i", [rank]).tobytes()
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        """Encoding of one match that is no token. Two generations of such pieces: what is asked for again outlives the change."""
        known = self._older.get(piece)
        if known is None:
            data = piece.encode()
            last: list[int] = []
            self.vocabulary.extend(last, data)
            known = array("i", self.vocabulary.walk(last, len(data))).tobytes()
            if len(data) > 256:
                return known
        if len(self._known) >= REMEMBERED // 2:
            self._older = dict(self._known)
            self._known.clear()
        self._known[piece] = known
        return known

    def packed(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        whole, known, piece = self._whole.get, self._known.get, self.piece
        return b"".join([whole(match) or known(match) or piece(match) for match in self.pieces(text)])

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def forget(self) -> None:
        """Drop what was remembered of texts, so that an idle worker holds the vocabulary alone."""
        self._known.clear()
        self._older = {}
        self.vocabulary.forget()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(ranks: bytes, pattern: str) -> Encoder:
    made = Encoder(Vocabulary(ranks), pattern)
    gc.freeze()  # the vocabulary stays: no later collection need visit it
    return made


def read_ranks(path: str) -> bytes:
    """The vocabulary file, whose size is that of the vocabulary, not of the data; every task gets its bytes."""
    files, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    with files.open_input_file(name) as source:
        return source.read()


def joined(values: pa.Array, ids: pa.Array) -> memoryview:
    """The values at the places ``ids``, one after the other."""
    return memoryview(values.take(ids).buffers()[2] or b"")


def encoded(batch: pa.RecordBatch, own: Encoder, keep: tuple[str, ...], ids: bool, held: int = HELD_BYTES) -> Iterable[dict]:
    """Columns of ``encode_documents`` for a batch with the texts as ``_utf8``, in pieces that end where their ids pass ``held`` bytes."""
    parts, decimals = own.vocabulary.parts, own.vocabulary.decimals
    counts, hashes, decoded, packed = [], [], [], []
    start = size = 0

    def piece() -> dict:
        columns = {name: batch[name].slice(start, len(counts)) for name in keep}
        columns |= {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
        if ids:
            offsets = np.cumsum([0, *counts], dtype=np.int32)
            columns["ids"] = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(packed), np.int32))
        return columns

    for data in batch["_utf8"]:
        packed.append(own.packed(data.as_py().decode()))
        found = pa.Array.from_buffers(pa.int32(), len(packed[-1]) // 4, [None, pa.py_buffer(packed[-1])])
        counts.append(len(found))
        hashes.append(hashlib.sha256(joined(decimals, found)[:-1]).hexdigest())
        decoded.append(hashlib.sha256(joined(parts, found)).hexdigest())
        if ids:
            size += len(packed[-1])
        else:
            packed.clear()
        if size >= held:
            yield piece()
            start, size = start + len(counts), 0
            counts, hashes, decoded, packed = [], [], [], []
    if counts:
        yield piece()


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Encode every text and decode its ids again.

    Returns the columns in ``keep`` with ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas),
    ``decoded_sha256`` and, if asked for, ``ids``. A null or empty text has no tokens; repeated rows get equal results;
    other columns play no part. Texts are encoded whole, without special tokens.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((ranks, pattern))  # a vocabulary has a fixed size
    rows = docs.select(*keep, text_bytes().alias("_utf8"))

    def step(batch: pa.RecordBatch) -> Iterable[dict]:
        return encoded(batch, encoder(*shared.value), keep, ids)

    kept = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in keep)
    return mapped(rows, step, f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string{', ids array<int>' if ids else ''}", lambda: encoder(*shared.value).forget())
