"""Whole texts to token ids, a batch of texts at a time.

A byte-level BPE first splits a text into units by a fixed pattern and encodes each
unit alone.  Many borders of that pattern show in two neighbouring bytes: white
space after anything else starts a unit, as does its last character before a visible
one; what follows a line break starts one, and so does a change between Latin letters, digits and signs, but for apostrophes
before letters.  A batch is cut there by array operations, and only distinct pieces
not met before are encoded; their ids are then put back in place.  Texts for which
the bytes do not tell (white space beyond ASCII, special tokens) and vocabularies
of another kind are encoded text by text.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker process remembers, and bytes of a piece that is worth it.
MAX_PIECES, MAX_PIECE = 600_000, 64
#: Bytes of text that are cut at a time.
BATCH_BYTES = 1 << 23

#: White space beyond ASCII, by code point.
_WIDE_SPACE = "[" + "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
                                      0x3000])) + "]"
_SPACE, _LETTER, _SIGN, _DIGIT = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"\t\n\v\f\r ")] = _SPACE
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = _LETTER
_KIND[list(b"0123456789")] = _DIGIT
_KIND[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = _SIGN

_ENCODERS: dict[str, "Encoder"] = {}


def byte_symbols() -> dict[int, str]:
    """The visible character by which a byte-level vocabulary spells each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class Encoder:
    """One vocabulary file of the ``tokenizers`` library, with the pieces met so far."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        before, special = parts.get("pre_tokenizer") or {}, parts.get("added_tokens") or []
        self.cuts = (parts["model"]["type"] == "BPE" and before.get("type") == "ByteLevel"
                     and before.get("use_regex", True) and not before.get("add_prefix_space")
                     and not parts.get("normalizer") and not parts["model"].get("dropout"))
        self.apart = "|".join([_WIDE_SPACE, *(_escaped(t["content"]) for t in special)])
        self.symbols = byte_symbols()
        self.known: dict[bytes, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids of one text as batches give them, four bytes each."""
        return next(self.encoded(pa.array([text]))).tobytes()

    def whole(self, text: str) -> bytes:
        """Ids of one text by the library alone, four bytes each."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece_ids(self, piece: bytes) -> bytes:
        word = piece[1:] if piece[:1] == b" " else piece
        spelt = word.decode()
        if spelt.isalpha() and max(spelt) < "\u0240":
            tokens = self.tokenizer.model.tokenize(piece.decode("latin-1").translate(self.symbols))
            return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return self.whole(piece.decode())

    def pieces(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the pieces of the joined texts begin; ``starts`` are the texts' own."""
        kind = _KIND[data]
        # U+00C0 to U+023F: two bytes, all letters but two
        lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8))
        lead = lead[(data[lead] > 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]
        kind[lead] = kind[lead + 1] = _LETTER
        before, after = kind[:-1], kind[1:]
        cut = (before != after) & (before > 0) & (after > 0)
        cut &= (before != _SPACE) | (data[:-1] != 0x20)
        cut &= (after != _LETTER) | (data[:-1] != 0x27)
        cut |= (after == _SPACE) & (before == 0)
        cut |= (before == _SPACE) & (data[:-1] != 0x20) & (after == 0)
        first = np.zeros(len(data) + 1, bool)
        first[1:-1] = cut
        # of white space before a visible character the last one stands apart
        last = (before == _SPACE) & (after != _SPACE)
        last[starts[(starts > 0) & (starts < len(data))] - 1] = False
        first[:-2] |= last
        first[starts] = True
        first[len(data)] = True
        return np.flatnonzero(first)

    def joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each begins) for texts without odd spaces or special tokens."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_pylist()), np.uint8)
        if not len(data):
            return np.empty(0, "<u4"), np.zeros(len(sizes) + 1, np.int64)
        starts = self.pieces(data, at[:-1])
        cut = pa.Array.from_buffers(pa.binary(), len(starts) - 1,
                                    [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)])
        words = cut.dictionary_encode()
        if len(self.known) > MAX_PIECES:
            self.known.clear()
        known, ids = self.known, []
        for piece in words.dictionary.to_pylist():
            found = known.get(piece)
            if found is None:
                found = self.piece_ids(piece)
                if len(piece) <= MAX_PIECE:
                    known[piece] = found
            ids.append(found)
        placed = pa.array(ids, pa.large_binary()).take(words.indices)
        ends = np.frombuffer(placed.buffers()[1], np.int64, len(placed) + 1, placed.offset * 8)
        out = np.frombuffer(placed.buffers()[2], "<u4", ends[-1] // 4) if ends[-1] else np.empty(0, "<u4")
        return out, ends[np.searchsorted(starts, at)] // 4

    def encoded(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null texts have none.

        Texts are taken in groups of about ``BATCH_BYTES``, a longer one by itself.
        """
        texts = texts.fill_null("")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        odd = (pc.match_substring_regex(texts, self.apart).to_numpy(zero_copy_only=False) if self.cuts
               else np.ones(len(texts), bool))
        first, upto = 0, np.cumsum(sizes)
        while first < len(texts):
            begin = upto[first] - sizes[first]
            last = max(first + 1, int(np.searchsorted(upto, begin + BATCH_BYTES, "right")))
            group, apart = texts.slice(first, last - first), odd[first:last]
            plain = group.filter(pa.array(~apart)) if apart.any() else group
            ids, at = self.joined(plain)
            k = 0
            for i in range(last - first):
                if apart[i]:
                    yield np.frombuffer(self.whole(group[i].as_py()), "<u4")
                else:
                    yield ids[at[k]:at[k + 1]]
                    k += 1
            first = last


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def encoder(path: str) -> Encoder:
    """One per worker process, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
