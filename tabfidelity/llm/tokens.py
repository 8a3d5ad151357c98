"""Token ids inside tasks: a public tokenizer behind a memo of white-space separated chunks."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of these letters, with or without closing marks, need no normalising but lower-casing; the library cuts between them.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#*$%&]*)")
_MARKS = b".,;:!?#*$%&"
_CUT = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?#*$%&]*)$"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable, else the next free letter from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


def file_digest(path: str) -> str:
    """Tells tokenizer versions apart."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts between ASCII white space, how many each text has)."""
    split = pc.ascii_split_whitespace(texts)
    words, lengths = split.flatten(), pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(words, "").to_numpy(zero_copy_only=False)  # beside white space at an end
    if empty.any():
        lengths -= np.bincount(np.repeat(np.arange(len(lengths)), lengths)[empty], minlength=len(lengths))
        words = words.filter(pa.array(~empty))
    return words, lengths


def text_slices(batches: Iterator[pa.RecordBatch], most_bytes: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """Some rows at a time: about most_bytes of text at most, but for one long text."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // most_bytes
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else part
        for start, end in zip(at.tolist(), [*at[1:].tolist(), b.num_rows], strict=False):
            for begin in range(start, end, most_rows):
                yield b.slice(begin, min(end - begin, most_rows))


def _gathered(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the pieces of ids numbered by at, one after another; their sizes). sizes: of all pieces, which lie in order."""
    own = sizes[at]
    return ids[np.repeat((np.cumsum(sizes) - sizes)[at] - np.cumsum(own) + own, own) + np.arange(own.sum())], own


class ChunkEncoder(dict):
    """chunk (UTF-8) -> its ids as little-endian unsigned 32-bit numbers.

    For tokenizers whose tokens never span ASCII white space and which drop it: the ids of a text are those of its chunks, one
    after another. Plain words go to the BPE model itself, all else through the whole library. Bounded: past
    `most` chunks the memo starts anew.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = byte_letters()
        self.most = most
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        word = chunk.rstrip(_MARKS)
        if word.isalpha():  # of A-Z and a-z alone, which stand for themselves
            low = word.lower()
            if low == chunk:
                out = self[chunk] = _packed([t.id for t in self.model.tokenize(low.decode())])
            elif len(word) == len(chunk):
                out = self[chunk] = self[low]
            else:
                out = self[chunk] = self[low] + self[chunk[len(word) :]]
            return out
        text = chunk.decode()
        plain = _PLAIN.fullmatch(text)
        if plain is None:
            ids = self.library.encode(text, add_special_tokens=False).ids
        elif plain[2]:
            out = self[chunk] = self[plain[1].lower().encode()] + self[plain[2].encode()]
            return out
        else:
            low = text.lower().encode()
            if low != chunk:
                out = self[chunk] = self[low]
                return out
            ids = [t.id for t in self.model.tokenize(low.decode("latin-1").translate(self.letters))]
        out = self[chunk] = _packed(ids)
        return out

    def _piece(self, piece: str) -> bytes:
        """For what encode_all() cuts: letters are in lower case."""
        if piece.isascii() and piece.isalpha():
            return _packed([t.id for t in self.model.tokenize(piece)])
        return self[piece.encode()]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; how many each text has). Distinct chunks are looked up once, and plain words without their marks."""
        words, lengths = split_words(texts)
        coded = words.dictionary_encode()
        chunks = coded.dictionary
        cut = pc.extract_regex(chunks, _CUT)
        heads = pc.if_else(cut.is_valid(), pc.utf8_lower(pc.struct_field(cut, "word")), chunks).dictionary_encode()
        marks = pc.if_else(cut.is_valid(), pc.struct_field(cut, "marks"), "").dictionary_encode()
        if len(self.pieces) >= self.most:
            self.pieces.clear()
        names = [x for half in (heads, marks) for x in half.dictionary.to_numpy(zero_copy_only=False).tolist()]
        self.pieces.update((x, self._piece(x)) for x in names if x not in self.pieces)
        blobs = list(map(self.pieces.__getitem__, names))
        ids, sizes = np.frombuffer(b"".join(blobs), dtype="<u4"), np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 4
        both = np.stack([heads.indices.to_numpy(), marks.indices.to_numpy() + len(heads.dictionary)], axis=1)
        ids, sizes = _gathered(ids, sizes, both.ravel())
        ids, sizes = _gathered(ids, sizes.reshape(-1, 2).sum(axis=1), coded.indices.to_numpy())
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(lengths)]
        return ids, np.diff(ends, prepend=0)

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode().split()))


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One for each Python worker and file, kept over its tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
