"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton and compatible neighbours.

A sequence of tokens is what the merges give for its bytes exactly when every two neighbours are what the
merges give for the bytes of the two. So a pretoken is encoded left to right with longest matches, and
where two neighbours are not compatible the match before is shortened, or taken back; a place in the text
that failed once is never tried again, which keeps the work linear. Whether two tokens are compatible is
worked out once by the merges themselves and remembered. Bytes are mapped to Latin-1 characters for the
automaton.

Pretokens are cut with array operations over code points, and each distinct one of a chunk of texts is
encoded once; the ids are then laid out for all texts together and decoded from the ids alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiwave.functions.shipping import ship
from lexiwave.llm.bytewords import chunks, range_keys, ranges, text_buffers

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: pretokens whose encodings a Python worker remembers between chunks
REMEMBERED = 150_000
#: pairs of neighbours whose compatibility is remembered; beyond that all are forgotten and worked out again
PAIRS = 400_000

# Fixed value: the split pattern that ``pretokens`` implements.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Encodes single pretokens by the ranks in a file of base64 tokens and ids."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self._set_up()

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> "Encoder":
        new = cls.__new__(cls)
        new.ranks = dict(ranks)
        new._set_up()
        return new

    def _set_up(self) -> None:
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"no token for the single bytes {missing[:5]}")
        # a token that the merges never make from its own bytes can only stand for a whole pretoken
        self.parts = {t: i for t, i in self.ranks.items() if len(t) == 1 or self.merged(t) == [t]}
        self._size = {i: len(t) for t, i in self.parts.items()}
        self._bytes = {i: t for t, i in self.parts.items()}
        self._compatible: dict[int, bool] = {}
        self._shorter: dict[int, int | None] = {}
        self._longest: dict[bytes, int] = {}  # of the tokens that begin with three bytes
        for t in self.parts:
            self._longest[t[:3]] = max(len(t), self._longest.get(t[:3], 0))
        self._automaton = ahocorasick.Automaton()
        for t, i in self.parts.items():
            self._automaton.add_word(t.decode("latin-1"), i)
        self._automaton.make_automaton()

    def merged(self, piece: bytes) -> list[bytes]:
        """The merges themselves: join the lowest-ranked neighbours, the leftmost first, until none joins."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.ranks.get
        while len(parts) > 1:
            joins = [get(a + b) for a, b in zip(parts, parts[1:])]
            ranked = [r for r in joins if r is not None]
            if not ranked:
                break
            i = joins.index(min(ranked))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges keep the tokens with ids a and b apart when they stand side by side."""
        x, y = self._bytes[a], self._bytes[b]
        if len(self._compatible) >= PAIRS:
            self._compatible.clear()
        known = self._compatible[a << 32 | b] = self.merged(x + y) == [x, y]
        return known

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        # longest matches one behind the other; they are the answer if all neighbours are compatible
        found = [i for _, i in self._automaton.iter_long(piece.decode("latin-1"))]
        known, before = self._compatible.get, found[0]
        for n, i in enumerate(found):
            if n:
                fits = known(before << 32 | i)
                if fits is None:
                    fits = self.compatible(before, i)
                if not fits:
                    return self._backtrack(piece, found[:n], i)
            before = i
        return found

    def _match(self, piece: bytes, at: int) -> int:
        """The longest token at a place."""
        parts = self.parts.get
        for n in range(self._longest.get(piece[at : at + 3], 2), 0, -1):
            i = parts(piece[at : at + n])
            if i is not None:
                return i
        raise AssertionError("every byte is a token")

    def _shorten(self, i: int) -> int | None:
        """The longest token that begins token i and is shorter."""
        t = self._bytes[i]
        found = next((self.parts[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.parts), None)
        self._shorter[i] = found
        return found

    def _backtrack(self, piece: bytes, done: list[int], token: int) -> list[int]:
        """Go on from tokens that are compatible so far and a longest match that is not."""
        size, known, shorter, total = self._size, self._compatible.get, self._shorter, len(piece)
        at, failed = sum(map(size.__getitem__, done)), bytearray(total + 1)
        while True:
            end = at + size[token]
            if not failed[end]:
                if done:
                    key = done[-1] << 32 | token
                    fits = known(key)
                    if fits is None:
                        fits = self.compatible(done[-1], token)
                else:
                    fits = True
                if fits:
                    done.append(token)
                    if end == total:
                        return done
                    at, token = end, self._match(piece, end)
                    continue
            token = shorter[token] if token in shorter else self._shorten(token)
            while token is None:
                failed[at] = 1
                last = done.pop()
                at -= size[last]
                token = shorter[last] if last in shorter else self._shorten(last)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of every code point: 0 other, 1 letter, 2 number, 3 white space."""
    table = np.zeros(0x110000, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for value, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, everything):
            a, b = ord(everything[m.start()]), ord(everything[m.end() - 1])
            table[a : b + 1] = value
    table[0xD800:0xE000] = 0
    return table


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, first byte of each) of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    if len(at) == len(data):
        return lead, at
    points = lead.copy()
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    tail = [padded[at + i].astype(np.uint32) & 0x3F for i in (1, 2, 3)]
    for low, high, bits, n in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        here = (lead >= low) & (lead < high)
        value = lead[here] & bits
        for i in range(n):
            value = (value << np.uint32(6)) | tail[i][here]
        points[here] = value
    return points, at


# The endings that the pattern splits off behind an apostrophe.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each pretoken, first pretoken of each text), as the tokenizers' split pattern cuts.

    Runs of letters, numbers and other signs take one space before them along. White space before
    anything else leaves its last character out. Of an apostrophe alone before letters, an ending in
    ``ENDINGS`` is a pretoken with it.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    points, at = _code_points(data)
    kind = _classes()[points]
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    new_text = text_start[at]
    m = len(kind)
    begins = np.empty(m, bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= new_text
    blank = kind == 3
    # white space that something of the same text follows: its last character stands alone ...
    followed = np.zeros(m, bool)
    followed[:-1] = blank[:-1] & ~blank[1:] & ~new_text[1:]
    begins |= followed
    # ... unless it is a space, which the next run takes along
    taken = followed & (points == 32)
    begins[1:] &= ~taken[:-1]
    # apostrophes
    marks = np.flatnonzero((points[:-1] == 39) & begins[:-1] & (kind[1:] == 1) & ~new_text[1:]) if m > 1 else np.zeros(0, int)
    for i in marks:  # the mark begins a pretoken, so no space stands before it, and letters follow
        after = "".join(map(chr, points[i + 1 : i + 3]))
        one_text = i + 2 < m and not new_text[i + 2]
        size = 1 if after[:1] in ENDINGS else 2 if one_text and after in ENDINGS else 0
        if size:
            begins[i + 1] = False
            follow = i + 1 + size
            if follow < m and kind[follow] == 1 and not new_text[follow]:
                begins[follow] = True
    first = at[begins]
    return first, np.searchsorted(first, offsets)


def _told_apart(data: np.ndarray, first: np.ndarray, end: np.ndarray, some: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges grouped by hash (``some`` of each group, the group of each), with those that differ in bytes from their group's taken out."""
    size, like = end - first, some[which]
    other = size != size[like]
    sizes = np.where(other, 0, size)
    differ = data[ranges(first, sizes)] != data[ranges(first[like], sizes)]
    if differ.any():
        other[np.repeat(np.arange(len(sizes)), sizes)[differ]] = True
    alone = np.flatnonzero(other)
    which = which.copy()
    which[alone] = len(some) + np.arange(len(alone))
    return np.concatenate([some, alone]), which


class TextCoder:
    """Encodes and decodes columns of texts."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.encoder, self._limit = encoder(path), remembered
        self._memory: dict[bytes, tuple[int, ...]] = {}
        size = max(self.encoder.ranks.values()) + 1
        tokens = [b""] * size
        for t, i in self.encoder.ranks.items():
            tokens[i] = t
        self._sizes = np.array([len(t) for t in tokens], np.int64)
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text)."""
        return self.coded(data, offsets)[:2]

    def coded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        """The same and all texts decoded from the ids; pretokens that share a hash by chance are told apart if those differ."""
        raw = data.tobytes()
        for exact in (False, True):
            ids, first = self._encode(data, offsets, exact)
            decoded, ends = self.decode(ids), np.concatenate([[0], np.cumsum(self._sizes[ids])])
            if decoded == raw and (ends[first] == offsets).all():
                return ids, first, decoded
        raise ValueError("a text was not decoded to its own bytes")

    def _encode(self, data: np.ndarray, offsets: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        first, by_text = pretokens(data, offsets)
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        end = np.append(first[1:], len(data))
        keys = range_keys(data, first, end)
        _, some, which = np.unique(keys, return_index=True, return_inverse=True)
        if exact:
            some, which = _told_apart(data, first, end, some, which)
        raw, memory, code = data.tobytes(), self._memory, self.encoder.encode
        found = []
        for a, b in zip(first[some].tolist(), end[some].tolist()):
            piece = raw[a:b]
            ids = memory.get(piece)
            if ids is None:
                ids = tuple(code(piece))
                if len(piece) <= 64:
                    if len(memory) >= self._limit:
                        memory.clear()
                    memory[piece] = ids
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        each = sizes[which]
        ids = flat[ranges(starts[which], each)]
        return ids, np.concatenate([[0], np.cumsum(each)])[by_text]

    def decode(self, ids: np.ndarray) -> bytes:
        return self._bytes[ranges(self._starts[ids], self._sizes[ids])].tobytes()


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    ``path`` is a rank file that every executor has. Null and empty texts have no tokens and the digests
    of nothing. Rows are independent, so ties, repeated rows and extra columns need no care, and an empty
    table gives an empty result. A very long text is one row's work, in time in proportion to its length and
    whole: it is never cut. A decoded text that differs from its bytes is an error.
    """
    fields = [("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TextCoder(path)
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = text_buffers(part.column(1))
                ids, first, decoded = coder.coded(data, offsets)
                counts, little = np.diff(first), ids.astype("<u4").tobytes()
                by_ids = [hashlib.sha256(little[4 * a : 4 * b]).hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                by_text = [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(by_ids), pa.array(by_text)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ship(docs.sparkSession)
    kinds = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, kinds)


def _public_vocabulary() -> str:
    import public_tokenizers

    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("texts are cut by another pattern than the vocabulary's")
    return public_tokenizers.path(VOCABULARY)


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_texts(docs, _public_vocabulary()).withColumnRenamed("id", "doc_id")


def bpe_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents, one row each, repeated rows and null ids too.

    Null and empty texts have no tokens; very long ones are encoded whole; there are no ties; other columns are
    ignored; an empty table gives an empty result.
    """
    return encode_texts(docs, _public_vocabulary()).withColumnRenamed("id", "doc_id")
