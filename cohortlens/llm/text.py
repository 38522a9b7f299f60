"""Array-at-a-time text segmentation for the tokenizer operators.

Texts of a batch lie in one UTF-8 buffer; character classes and run ends are
numpy arrays over that buffer, and the pieces become an Arrow string array
over the same bytes, so equal pieces are found by Arrow's dictionary encoding.
This covers texts made of code points below U+0180; others (``plain_rows`` is
false) are segmented by the tokenizer's own pre-tokenizer, row by row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
LIMIT = 0x180
_WHITE = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0}  # Unicode White_Space below LIMIT


def _class_of(cp: int) -> int:
    if cp in _WHITE:
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(cp))[0], OTHER)


CLASSES = np.array([_class_of(cp) for cp in range(LIMIT)], np.uint8)
LOWER = np.array([ord(chr(cp).lower()) if len(chr(cp).lower()) == 1 else cp for cp in range(LIMIT)], np.uint16)


@dataclass
class Pieces:
    """Pieces of some rows: ``values[codes[k]]`` for k in ``ends[r-1]:ends[r]`` of row r."""

    values: list[str] | pa.Array
    codes: np.ndarray
    ends: np.ndarray  # one longer than the rows, starts with 0

    def words(self) -> list[str]:
        return self.values.to_pylist() if isinstance(self.values, pa.Array) else self.values


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def plain_rows(texts: pa.Array, marker: str = "<|") -> np.ndarray:
    """Rows below LIMIT, without U+0130 (its lower case is two code points) or ``marker``."""
    offsets, data = buffers(texts)
    odd = data >= 0xC6
    odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)
    before = np.searchsorted(np.flatnonzero(odd), offsets)
    has_marker = pc.match_substring(texts, marker).to_numpy(zero_copy_only=False)
    return (before[1:] == before[:-1]) & ~has_marker


def _classified(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (lower-cased if asked) and the class of the character that each belongs to."""
    table = np.zeros(256, np.uint8)
    table[:128] = CLASSES[:128]
    kinds = table[data]
    lead = np.flatnonzero(data >= 0xC0)
    cps = ((data[lead] & 0x1F).astype(np.uint16) << 6) | (data[lead + 1] & 0x3F)
    kinds[lead] = kinds[lead + 1] = CLASSES[cps]
    if lower:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        small = LOWER[cps]
        data[lead] = 0xC0 | (small >> 6)
        data[lead + 1] = 0x80 | (small & 0x3F)
    return data, kinds


def _contractions(data: np.ndarray, kinds: np.ndarray, cut: np.ndarray, row_end: np.ndarray) -> None:
    """Cut behind 's 't 'm 'd 're 've 'll where the apostrophe starts a piece."""
    n = len(data)
    at = np.flatnonzero(cut & (data == 39))
    at = at[~row_end[at + 1]]
    at = at[cut[at + 1] & (kinds[at + 1] == LETTER)]
    if not len(at):
        return
    one = data[at + 1]
    two = np.where(at + 2 < n, data[np.minimum(at + 2, n - 1)], 0)
    same_word = (at + 2 < n) & ~cut[np.minimum(at + 2, n - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = same_word & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
    size = np.where(short, 2, np.where(long, 3, 0))
    at, size = at[size > 0], size[size > 0]
    cut[at + 1] = False
    ends = at + size
    cut[ends[ends < n]] = True


def _runs(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of one class start, and where rows end (one longer)."""
    row_end = np.zeros(len(kinds) + 1, bool)
    row_end[offsets] = True
    cut = row_end[:-1].copy()
    cut[1:] |= kinds[1:] != kinds[:-1]
    return cut, row_end


def _coded(data: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    where = np.append(at, len(data)).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(data)))
    return pieces.dictionary_encode(), np.searchsorted(at, offsets)


def spaced_pieces(texts: pa.Array) -> Pieces:
    """Pieces that cover the text, a word with the blank before it (byte-level BPE rules)."""
    offsets, data = buffers(texts)
    if not len(data):
        return Pieces([], np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64))
    _, kinds = _classified(data, lower=False)
    cut, row_end = _runs(kinds, offsets)
    # a white run keeps its last character apart, unless the text ends there
    white = kinds == SPACE
    last = np.zeros(len(data), bool)
    last[:-1] = white[:-1] & ~white[1:] & ~row_end[1:len(data)]
    wide = np.flatnonzero(last & (data >= 0x80))  # of two bytes
    cut |= last
    cut[wide - 1], cut[wide] = True, False
    cut[1:] &= ~(last[:-1] & (data[:-1] == 0x20))  # a blank joins what follows
    _contractions(data, kinds, cut, row_end)
    coded, ends = _coded(data, np.flatnonzero(cut), offsets)
    return Pieces(coded.dictionary, coded.indices.to_numpy(), ends)


def lower_words(texts: pa.Array) -> Pieces:
    """Lower-cased letter runs, single numbers, contractions and runs of the rest; white space dropped."""
    offsets, data = buffers(texts)
    if not len(data):
        return Pieces([], np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64))
    data, kinds = _classified(data, lower=True)
    cut, row_end = _runs(kinds, offsets)
    cut |= (kinds == NUMBER) & ((data < 0x80) | (data >= 0xC0))
    _contractions(data, kinds, cut, row_end)
    at = np.flatnonzero(cut)
    coded, ends = _coded(data, at, offsets)
    keep = kinds[at] != SPACE
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    return Pieces(coded.dictionary.to_pylist(), coded.indices.to_numpy()[keep], kept_before[ends])


def all_rows(texts: pa.Array, fast: Callable[[pa.Array], Pieces], slow: Callable[[str], list[str]]) -> Pieces:
    """``fast`` for the plain rows and ``slow`` for each other row, in row order."""
    texts = pc.fill_null(texts, "")
    plain = plain_rows(texts)
    if plain.all():
        return fast(texts)
    done = fast(texts.filter(pa.array(plain)))
    index = {v: i for i, v in enumerate(done.words())}
    parts, ends, taken = [], [0], 0
    for r, easy in enumerate(plain):
        if easy:
            codes = done.codes[done.ends[taken]:done.ends[taken + 1]]
            taken += 1
        else:
            codes = np.array([index.setdefault(p, len(index)) for p in slow(texts[r].as_py())], np.int32)
        parts.append(codes)
        ends.append(ends[-1] + len(codes))
    return Pieces(list(index), np.concatenate(parts) if parts else done.codes, np.array(ends, np.int64))


def ragged_take(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of the ``codes``-th lists of ``flat``, and the running end of each."""
    starts = np.cumsum(lengths) - lengths
    sizes = lengths[codes]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts[codes] - (ends - sizes), sizes) + np.arange(total)
    return flat[at], ends
