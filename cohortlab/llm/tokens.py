"""Token ids of whole texts by a public tokenizer, with the ids of repeated pieces remembered per Python worker.

A text is cut only where the tokenizer's own pre-tokenizer always parts it, so the pieces' ids, one after another, are
the ids of the text; a worker encodes a piece once for as long as it stays in the bounded memory.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  binds pa.compute

from .common import text_buffers, text_slices

#: pieces remembered per worker, if nothing else is asked for
MEMORY = 400_000
_loaded: dict[str, TextEncoder] = {}

#: the letters of Latin-1; in texts without other letters a run of them is one unit, with or without a blank before it
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
#: white space other than the blank; of a run of it, only the last character is parted from the rest, and only before a letter
_LAST_SPACE = f"[\\t-\\r\\x85\\xa0](?=[{_LETTERS}])"
#: texts where that can be otherwise (contractions, characters beyond Latin-1, names of special tokens; _plain()) are cut before blanks only
_BEFORE_BLANK = re.compile(r"(?<=\S)(?= )")
_SPACES = re.compile(r"[ \t\r\n]+")
#: byte-level BPE writes each byte as one printable character: printable Latin-1 as itself, the others from U+0100 on
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: characters of two bytes: 0xC3 leads letters but for the signs of multiplication and division, 0xC2 leads three letters
_NO_LETTER_C3, _LETTER_C2 = np.zeros(256, bool), np.zeros(256, bool)
_NO_LETTER_C3[[0x97, 0xB7]] = _LETTER_C2[[0xAA, 0xB5, 0xBA]] = True


def _plain_rows(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """_plain() of each row of UTF-8 bytes that isn't empty."""
    bad = (data == ord("'")) | (data > 0xC3)
    bad[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    out = np.diff(off) > 0
    out[np.searchsorted(off, np.flatnonzero(bad), side="right") - 1] = False
    return out


def _cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pieces of plain rows of UTF-8 bytes begin, as TextEncoder.words cuts them where a blank leads the word after it."""
    letter = _ASCII_LETTER[data]
    at = np.flatnonzero(data == 0xC3)
    letter[at] = letter[at + 1] = ~_NO_LETTER_C3[data[at + 1]]
    at = np.flatnonzero(data == 0xC2)
    letter[at] = letter[at + 1] = _LETTER_C2[data[at + 1]]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    cut = first.copy()
    cut[1:-1] |= letter[1:] != letter[:-1]
    # of the white space before a letter, in the same row
    begin = np.flatnonzero(cut[:-1] & letter & ~first[:-1])
    before = data[begin - 1]
    blank = begin[before == 32]
    cut[blank] = False
    cut[blank - 1] = True
    cut[begin[(before >= 9) & (before <= 13)] - 1] = True
    wide = begin[((before == 0x85) | (before == 0xA0)) & (data[begin - 2] == 0xC2)]
    cut[wide - 2] = True
    return np.flatnonzero(cut[:-1])


def _plain(text: str) -> bool:
    """Whether nothing in the text is cut otherwise."""
    try:
        text.encode("latin-1")  # quicker than a look at each character
    except UnicodeEncodeError:
        return False
    return "'" not in text and "<|" not in text


class _Memory(dict):
    """Ids of pieces, as bytes. Remembers in two generations: what was used since the last turn stays, the rest goes."""

    def __init__(self, tok, code: str, lower: bool, most: int):
        self.old: dict[str, bytes] = {"": b""}
        self.encode, self.tokenize, self.code, self.lower, self.most = tok.encode, tok.model.tokenize, code, lower, most

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            if piece.strip(" ").isalpha() and piece.isprintable() and max(piece) <= "ÿ" and piece.rfind(" ") <= 0:
                word = piece.lower() if self.lower else piece
                # letters A-Z are written as themselves
                ids = [t.id for t in self.tokenize(word if word.isascii() and word[0] != " " else word.encode().decode("latin-1").translate(_BYTES))]
            else:
                ids = self.encode(piece, add_special_tokens=False).ids
            out = array(self.code, ids).tobytes()
        if len(self) >= self.most // 2:
            self.old = {"": b""} | self
            self.clear()
        self[piece] = out
        return out


class TextEncoder:
    """Encodes texts with the tokenizer file at path, add_special_tokens=False; ids come as little-endian bytes."""

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path) as f:
            spec = json.load(f)
        kind = json.dumps(spec.get("pre_tokenizer") or {})
        if '"ByteLevel"' not in kind:
            raise ValueError("only byte-level tokenizers are known to be parted as this class cuts")
        # byte-level alone: a blank leads the word after it; after a Split, white space only parts words
        self.blank_leads = '"Split"' not in kind
        self.words = re.compile(f"( ?[{_LETTERS}]+|{_LAST_SPACE})" if self.blank_leads else f"[{_LETTERS}]+|[^{_LETTERS} \\t\\r\\n]+")
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.held = _Memory(self.tok, self.dtype.char, '"Lowercase"' in json.dumps(spec.get("normalizer") or {}), memory)

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text, as bytes of self.dtype; none for null or empty text."""
        if not text:
            return b""
        if _plain(text):
            pieces = filter(None, self.words.split(text)) if self.blank_leads else self.words.findall(text)
        else:
            pieces = _BEFORE_BLANK.split(text) if self.blank_leads else _SPACES.split(text)
        return b"".join(map(self.held.__getitem__, pieces))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """encode() of each text. Where a blank leads the word after it, a slice of plain texts is cut at once and each of its
        distinct pieces is looked up once."""
        if not self.blank_leads:
            return [self.encode(t) for t in texts.to_pylist()]
        out: list[bytes] = []
        for b in text_slices(pa.RecordBatch.from_arrays([texts], ["text"]), limit=12 << 20):
            col = b.column("text")
            plain = _plain_rows(*text_buffers(col))
            if plain.all():
                out += self._encode_plain(col)
            else:
                quick = iter(self._encode_plain(col.filter(pa.array(plain)))) if plain.any() else iter(())
                out += [next(quick) if p else self.encode(t.as_py()) for p, t in zip(plain.tolist(), col, strict=True)]
        return out

    def _encode_plain(self, texts: pa.Array) -> list[bytes]:
        data, off = text_buffers(texts)
        starts = _cuts(data, off)
        ends = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        found = [self.held[p] for p in pieces.dictionary.to_pylist()]
        pool = np.frombuffer(b"".join(found), self.dtype)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        code = np.asarray(pieces.indices)
        n = size[code]
        upto = np.concatenate([[0], np.cumsum(n)])
        # a piece's ids lie in the pool from its first one on
        raw = pool[np.repeat((np.cumsum(size) - size)[code] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        at = (upto[np.searchsorted(starts, off)] * self.dtype.itemsize).tolist()
        return [raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def encoder(path: str, memory: int = MEMORY) -> TextEncoder:
    """The worker's encoder for this tokenizer file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _loaded:
        _loaded[path] = TextEncoder(path, memory)
    _loaded[path].held.most = memory
    return _loaded[path]
