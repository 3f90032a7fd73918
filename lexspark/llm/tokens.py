"""Whole-text token ids from a public vocabulary file, looked up by pieces of the text.

Byte-level BPE never merges across a pre-token boundary. A single space between two visible characters always starts a
pre-token, and a single line break between two visible characters always is one. A text whose only white space is such
spaces and line breaks can so be cut there, and every piece encoded on its own; any other text is encoded as a whole.
Pieces repeat very often in a corpus: each Python worker keeps a bounded table of pieces and their ids, is asked for all
pieces of an Arrow batch at once, and calls the library only for pieces that it lacks. A piece of up to 16 bytes is its
own key, as two 64-bit integers, so that nothing is ever taken for another.
"""

from __future__ import annotations

import functools
import gc
import os
import sys
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker's table holds at most, about 60 bytes each. A full one forgets the half that came last: frequent
#: pieces come early.
TABLE_ENTRIES = 2_000_000
_SLOT_BITS = 22
#: Longer pieces, and whole texts, are encoded each time.
_KEY_BYTES = 16
#: Pieces that are looked up at a time.
_STEP = 1 << 18

_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte -> the character that stands for it in byte-level vocabularies: visible Latin-1 characters stand for
#: themselves, the others follow from U+0100 on.
BYTE_CHARS = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _VISIBLE)}
#: The first n bytes of a little-endian 64-bit integer.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: First bytes, in UTF-8, of white space beyond ASCII (and of some other characters).
_WIDE_SPACE = ((0xC2, 0x85, 0x85), (0xC2, 0xA0, 0xA0), (0xE1, 0x9A, 0x9A), (0xE2, 0x81, 0x81), (0xE3, 0x80, 0x80))


def vocabulary_path(name: str) -> str:
    """Place of a vocabulary file in the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pretoken_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def mapped(pretoken: str) -> str:
    """The pre-token's UTF-8 bytes as the characters that stand for them."""
    if pretoken.isascii() and pretoken.isprintable():
        return pretoken.replace(" ", BYTE_CHARS[32])
    return pretoken.encode("utf-8", "replace").decode("latin-1").translate(BYTE_CHARS)


def as_bytes(ids: Iterable[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


def _odd(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places in texts that cannot be cut: white space or control characters other than single spaces and line breaks."""
    space = (b == 32) | (b == 10)
    odd = (b < 32) & (b != 10) | (b == 127)
    odd[1:] |= space[1:] & space[:-1]
    odd[starts] |= b[starts] == 32
    odd[ends - 1] |= b[ends - 1] == 32
    wide = np.flatnonzero(b[:-1] > 0xC1)
    for first, low, high in _WIDE_SPACE:
        odd[wide[(b[wide] == first) & (b[wide + 1] >= low) & (b[wide + 1] <= high)]] = True
    quote = wide[(b[wide] == 0xE2) & (b[wide + 1] == 0x80)]  # U+2000 to U+203F: spaces, and common punctuation
    third = b[np.minimum(quote + 2, len(b) - 1)]
    odd[quote[(third <= 0x8A) | np.isin(third, (0xA8, 0xA9, 0xAF))]] = True
    return np.flatnonzero(odd)


class PieceTable:
    """make(pre-token) is its ids as bytes; encode(texts) gives those of whole texts."""

    def __init__(self, make: Callable[[str], bytes], whole: Callable[[str], bytes | None] = lambda text: None, special: Iterable[str] = ()):
        import regex

        self._find = regex.compile(pretoken_pattern()).findall
        self._make = make
        self._few = functools.lru_cache(4096)(make)
        self._own = whole  # encodes texts with special strings
        self._special = [s for s in special if s]
        self._slots = np.zeros(1 << _SLOT_BITS, np.int32)  # numbers of entries; 0: free
        self._keys = np.zeros((2, TABLE_ENTRIES), np.uint64)
        self._at, self._many = np.zeros(TABLE_ENTRIES, np.int32), np.zeros(TABLE_ENTRIES, np.int32)
        self._pool = np.zeros(1 << 16, np.uint32)  # the ids of all entries
        self._entries, self._used = 1, 0

    def one(self, text: str) -> bytes:
        """The ids of any text."""
        if any(s in text for s in self._special):
            return self._own(text)
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self._make(text)  # one run of letters is one pre-token
        return b"".join([self._few(x) if len(x) < 3 else self._make(x) for x in self._find(text)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text begin, and the last end; nulls count as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        raw = texts.buffers()[2]
        size = int(offsets[-1] - offsets[0])
        if not size:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        b = np.zeros(size + _KEY_BYTES, np.uint8)
        b[:size] = np.frombuffer(raw, np.uint8, size, int(offsets[0]))
        offsets = offsets - offsets[0]
        filled = np.flatnonzero(np.diff(offsets))
        first, end = offsets[filled], offsets[filled + 1]
        cut = (b == 32) | (b == 10)
        cut[1:] |= b[:-1] == 10
        cut[first] = True
        cut[size:] = False
        whole = {*np.searchsorted(end, _odd(b[:size], first, end), "right").tolist()}
        for s in self._special:
            whole |= {*np.searchsorted(filled, np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False))).tolist()}
        for i in whole:
            cut[first[i] + 1 : end[i]] = False
        at = np.flatnonzero(cut)
        length = np.diff(at, append=size)
        starts_whole = np.array([first[i] for i in whole], np.int64)
        found = [self._look_up(b, at[k : k + _STEP], length[k : k + _STEP], starts_whole) for k in range(0, len(at), _STEP)]
        to = np.concatenate([[0], *(many for _, many in found)]).cumsum()
        return np.concatenate([ids for ids, _ in found]), to[np.searchsorted(at, offsets)]

    def _look_up(self, b: np.ndarray, at: np.ndarray, length: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, and how many each has. whole: where texts begin that are one piece."""
        word = np.ndarray(len(b) - 7, "<u8", b, 0, (1,))
        keys = np.stack([word[at] & _FIRST.take(np.minimum(length, 8)), word[np.minimum(at + 8, len(b) - 8)] & _FIRST.take(np.clip(length - 8, 0, 8))])
        long = length > _KEY_BYTES
        if len(whole):
            long |= np.isin(at, whole)
        short = np.flatnonzero(~long)
        if self._entries + len(short) >= TABLE_ENTRIES:
            self._forget()
        entry = np.zeros(len(at), np.int64)
        left = short
        while len(left):
            entry[left] = self._entries_of(keys[:, left])
            left = left[entry[left] == 0]
            _, lacking = np.unique(_hash(keys[:, left]), return_index=True)  # pieces of one hash come one by one
            lacking = left[lacking]
            made = [self.one(b[s : s + n].tobytes().decode()) for s, n in zip(at[lacking].tolist(), length[lacking].tolist())]
            self._add(keys[:, lacking], made)
        place, many = self._at.take(entry), self._many.take(entry)
        if len(rest := np.flatnonzero(long)):  # behind the entries' ids, until the next piece comes
            made = [self.one(b[s : s + n].tobytes().decode()) for s, n in zip(at[rest].tolist(), length[rest].tolist())]
            many[rest] = n = self._into_pool(self._used, made)
            place[rest] = self._used + n.cumsum() - n
        to = many.cumsum()
        return self._pool.take(np.repeat(place - (to - many), many) + np.arange(to[-1])), many

    def _entries_of(self, keys: np.ndarray) -> np.ndarray:
        slot = (_hash(keys) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        found = self._slots.take(slot)
        going = np.flatnonzero((found > 0) & ~self._is(found, keys))
        while len(going):
            slot[going] = (slot[going] + 1) % len(self._slots)
            found[going] = self._slots.take(slot[going])
            going = going[(found[going] > 0) & ~self._is(found[going], keys[:, going])]
        return found

    def _is(self, entry: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return (self._keys[0].take(entry) == keys[0]) & (self._keys[1].take(entry) == keys[1])

    def _into_pool(self, at: int, made: list[bytes]) -> np.ndarray:
        """Numbers of ids, which now lie in the pool from `at` on."""
        ids = np.frombuffer(b"".join(made), "<u4")
        while len(self._pool) < at + len(ids):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        self._pool[at : at + len(ids)] = ids
        return np.array([len(x) // 4 for x in made], np.int64)

    def _add(self, keys: np.ndarray, made: list[bytes]) -> None:
        own = np.arange(self._entries, self._entries + len(made))
        self._keys[:, own] = keys
        self._many[own] = many = self._into_pool(self._used, made)
        self._at[own] = self._used + many.cumsum() - many
        self._used += int(many.sum())
        self._entries += len(made)
        self._fill(own)

    def _fill(self, own: np.ndarray) -> None:
        slot = (_hash(self._keys[:, own]) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        while len(own):
            free = self._slots[slot] == 0
            self._slots[slot[free]] = own[free]
            lost = self._slots[slot] != own
            own, slot = own[lost], (slot[lost] + 1) % len(self._slots)

    def _forget(self) -> None:
        self._entries = min(self._entries, TABLE_ENTRIES // 2)
        self._used = int(self._at[self._entries - 1] + self._many[self._entries - 1])
        self._slots[:] = 0
        self._fill(np.arange(1, self._entries))


def _hash(keys: np.ndarray) -> np.ndarray:
    h = keys[0] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += keys[1] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


@functools.cache
def library_table(path: str) -> PieceTable:
    """Ids by the `tokenizers` library and a JSON file of it.

    They are those of Tokenizer.encode(text, add_special_tokens=False): the string of a special token in a text is that
    token, and a text that has one is encoded by the library as a whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenize = tokenizer.model.tokenize
    return PieceTable(
        lambda pretoken: as_bytes([x.id for x in tokenize(mapped(pretoken))]),
        lambda text: as_bytes(tokenizer.encode(text, add_special_tokens=False).ids),
        [x.content for x in tokenizer.get_added_tokens_decoder().values()],
    )


def released() -> None:
    """Frees this worker's table, for operators without ids: Spark hands on its workers, and memory, from stage to stage."""
    library_table.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def ended_ids(table: PieceTable, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids with the end id after each text, and where those of each text begin, and the last end."""
    ids, bounds = table.encode(texts)
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))
