"""Token ids of texts by a public byte-pair tokenizer file that splits at white space.

Words are taken from the Arrow buffers and made distinct by dictionary encoding. Those that the worker
met before are looked up; of the others, words of lower-case Latin letters are merged together, those of
about one length as one matrix, and any other word is given to the tokenizer itself.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from .common import mix64

#: Longer words of letters are given to the tokenizer, whose work grows less with their length.
LONGEST = 40
#: Words of so few bytes are remembered: with their length they fill two numbers, so that what is found is the word itself.
SHORT = 15
#: Bits of the number of places for remembered words (two are open to each, and the last one stays), and their ids; beyond them a worker begins anew.
PLACES, REMEMBERED = 20, 1 << 22
#: Words of letters are merged as one matrix up to each of these lengths.
LENGTHS = (4, 7, 10, 14, 20, LONGEST)
_NEVER = np.int32(2**31 - 1)

#: Second bytes of the lower-case letters U+00DF to U+00FF, which no normalisation changes; the first is 0xC3.
_SECOND = np.zeros(256, bool)
_SECOND[0x9F:0xC0] = True
_SECOND[0xB7] = False


# Comparisons instead of tables of 256 places: they take many bytes at a time. Below the first one a byte wraps round.


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return data | ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def _space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | (data - np.uint8(9) < 5)


def _a_to_z(data: np.ndarray) -> np.ndarray:
    return data - np.uint8(97) < 26


def _other(data: np.ndarray) -> np.ndarray:
    """Which bytes of lower-cased text are ASCII marks or digits."""
    return (data - np.uint8(33) < 94) & ~_a_to_z(data)


def _where(flags: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Places of the flags that are set, counted among the bytes chosen by ``among``; all of them are chosen."""
    return np.flatnonzero(np.frombuffer((flags.view(np.uint8) + among.view(np.uint8)).tobytes().translate(None, b"\0"), np.uint8) == 2)


def _plain(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters a-z or U+00DF to U+00FF."""
    out = _a_to_z(data)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_SECOND[data[lead + 1]]]
    out[lead] = out[lead + 1] = True
    return out


def _byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merges:
    """The merges of a byte-pair model, looked up for many pairs at once."""

    def __init__(self, model: dict):
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = np.int64(max(vocabulary.values()) + 1)
        chars = _byte_chars()
        self.inner = np.array([vocabulary.get(c, -1) for c in chars], np.int32)
        self.final = np.array([vocabulary.get(c + suffix, -1) for c in chars], np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocabulary[a] * int(self.size) + vocabulary[b] for a, b in pairs], np.int64)
        self.bits = max(8, int(len(keys) - 1).bit_length() + 4)
        self._fill(keys)

    def _slot(self, keys: np.ndarray, turn: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray) -> None:
        # a few tables, each with the pairs that found no free slot in those before
        self.tables, left, rank = [], keys, np.arange(len(keys), dtype=np.int32)
        while len(left):
            slot = self._slot(left, len(self.tables))
            key, value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NEVER, np.int32)
            _, first = np.unique(slot, return_index=True)
            key[slot[first]], value[slot[first]] = left[first], rank[first]
            self.tables.append((key, value))
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, rank = left[rest], rank[rest]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * self.size + b
        found = np.full(keys.shape, _NEVER, np.int32)
        for turn, (key, value) in enumerate(self.tables):
            slot = self._slot(keys, turn)
            found = np.where(key[slot] == keys, value[slot], found)
        return found

    def merged(self, words: np.ndarray):
        """(rows, ids) of a matrix of words (a byte a column, zeros before a shorter one): the best pair of each word is merged until none is left.

        Columns before a word hold -1, which no pair has.
        """
        row = np.arange(len(words))
        ids = np.where(words > 0, self.inner[words], np.int32(-1))
        ids[:, -1] = self.final[words[:, -1]]
        rank = self.rank(ids[:, :-1], ids[:, 1:])
        while len(row):
            if ids.shape[1] == 1:
                yield row, ids
                return
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            ends = best == _NEVER
            if ends.any():
                yield row[ends], ids[ends]
                row, ids, rank, at, best = row[~ends], ids[~ends], rank[~ends], at[~ends], best[~ends]
                if not len(row):
                    return
            every, place = np.arange(len(row)), np.arange(ids.shape[1] - 1)
            ids[every, at] = self.made[best]
            ids = np.where(place > at[:, None], ids[:, 1:], ids[:, :-1])
            if ids.shape[1] > 1:
                place = place[:-1]
                rank = np.where(place >= at[:, None], rank[:, 1:], rank[:, :-1])
                left, right = np.flatnonzero(at > 0), np.flatnonzero(at < ids.shape[1] - 1)
                rank[left, at[left] - 1] = self.rank(ids[left, at[left] - 1], ids[left, at[left]])
                rank[right, at[right]] = self.rank(ids[right, at[right]], ids[right, at[right] + 1])


def names_of(letters: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Words letters[first:last] of ``SHORT`` bytes at most as two numbers each: their bytes, zeros and, in the last byte, their length."""
    size, every = last - first, np.arange(SHORT + 1)
    names = np.concatenate([letters, np.zeros(SHORT + 1, np.uint8)])[first[:, None] + every]
    names *= every < size[:, None]
    names[:, SHORT] = size
    return names.view(np.uint64)


class WordTokenizer:
    """Ids of texts by a tokenizers file, each distinct word encoded once, as long as it is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.tokenizer, self.merges = Tokenizer.from_file(path), Merges(model)
        self.kind = np.uint32 if len(ending(path)) > 1 << 16 else np.uint16
        self._forget()

    def _forget(self) -> None:
        """Remembered words, all ids that were made, and where those of each word are."""
        self.names, self.flat = np.zeros((1 << PLACES, 2), np.uint64), np.zeros(0, self.kind)
        self.start, self.size = np.zeros(1 << PLACES, np.int32), np.zeros(1 << PLACES, np.uint8)

    def _odd(self, words: list[bytes]):
        for a in range(0, len(words), 2000):
            for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words[a : a + 2000]], add_special_tokens=False):
                yield np.array(e.ids, self.kind)

    def _ids(self, letters: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct words letters[edges[i]:edges[i + 1]] as (flat, start, size)."""
        short = np.flatnonzero(np.diff(edges) <= SHORT)
        names = names_of(letters, edges[short], edges[short + 1])
        place = mix64(names[:, 0] * np.uint64(0x9E3779B97F4A7C15) + names[:, 1])
        place = np.stack([place >> np.uint64(64 - PLACES), place & np.uint64((1 << PLACES) - 1)]).astype(np.int64)
        second = (self.names[place[1]] == names).all(1)
        met = (self.names[place[0]] == names).all(1) | second
        own, place = np.where(second, place[1], place[0])[met], place[:, ~met]
        fresh = np.ones(len(edges) - 1, bool)
        fresh[short[met]] = False
        flat, start, size = self._encode(letters, edges, fresh)
        start += len(self.flat)
        self.flat = np.concatenate([self.flat, flat])
        start[short[met]], size[short[met]] = self.start[own], self.size[own]
        short, names = short[~met], names[~met]
        place, first = np.unique(np.where(self.size[place[0]] == 0, place[0], place[1]), return_index=True)
        self.names[place], self.start[place], self.size[place] = names[first], start[short[first]], size[short[first]]
        found = self.flat, start, size
        if len(self.flat) > REMEMBERED:
            self._forget()
        return found

    def _encode(self, letters: np.ndarray, edges: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the chosen words letters[edges[i]:edges[i + 1]] as (flat, start, size)."""
        n = len(edges) - 1
        start, size, parts, total = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
        wrong = np.concatenate([[0], np.cumsum(~_plain(letters))])
        length = np.diff(edges)
        fast = chosen & (wrong[edges[1:]] == wrong[edges[:-1]]) & (length <= LONGEST)
        for shorter, longest in zip((0, *LENGTHS), LENGTHS):
            own = np.flatnonzero(fast & (length > shorter) & (length <= longest))
            for a in range(0, len(own), 8192):
                part = own[a : a + 8192]
                at = edges[part + 1][:, None] + np.arange(-longest, 0)
                for row, ids in self.merges.merged(np.where(at >= edges[part][:, None], letters[np.maximum(at, 0)], np.uint8(0))):
                    there = ids >= 0
                    size[part[row]] = sizes = there.sum(1)
                    start[part[row]] = total + np.cumsum(sizes) - sizes
                    parts.append(ids[there].astype(self.kind))
                    total += len(parts[-1])
        rest = np.flatnonzero(chosen & ~fast)
        for i, ids in zip(rest.tolist(), self._odd([letters[edges[i] : edges[i + 1]].tobytes() for i in rest.tolist()])):
            start[i], size[i] = total, len(ids)
            parts.append(ids)
            total += len(ids)
        return np.concatenate([*parts, np.zeros(0, self.kind)]), start, size

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column one after the other, and the number of each text."""
        n = len(column)
        column = column.fill_null("") if column.null_count else column
        offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
        offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        # A-Z are lower-cased by the tokenizer anyway
        lowered, inside = _lower(raw), ~_space(raw)
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        # the tokenizer splits between a letter and an ASCII mark or digit, and back unless an apostrophe comes first
        plain, ascii_other = _plain(lowered), _other(lowered)
        cut = plain[:-1] & ascii_other[1:]
        cut |= ascii_other[:-1] & (lowered[:-1] != 39) & _a_to_z(lowered[1:])
        starts[1:] |= cut
        borders = offsets[:-1][np.diff(offsets) > 0]
        # special tokens are matched before anything else
        if b"<|" in raw.tobytes():
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if b"<|" in raw[a:b].tobytes():
                    lowered[a:b] = raw[a:b]
                    starts[a:b] = inside[a:b]
                    starts[a + 1 : b] &= ~inside[a : b - 1]
        starts[borders] = inside[borders]
        packed, at = np.frombuffer(lowered.tobytes().translate(None, b"\t\n\v\f\r "), np.uint8), _where(starts, inside)
        if not len(at):
            return np.zeros(0, self.kind), np.zeros(n, np.int64)
        words_upto = np.searchsorted(np.flatnonzero(starts), offsets)
        bounds = np.append(at, len(packed)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).dictionary_encode()
        _, edges, letters = words.dictionary.buffers()
        flat, start, size = self._ids(np.frombuffer(letters, np.uint8), np.frombuffer(edges, np.int32)[: len(words.dictionary) + 1].astype(np.int64))
        number = words.indices.to_numpy()
        size = size[number]
        return ragged(flat, start[number], size), np.diff(np.concatenate([[0], np.cumsum(size)])[words_upto])


def ending(path: str) -> np.ndarray:
    """By token id, whether it ends a word."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    vocabulary, suffix = whole["model"]["vocab"], whole["model"].get("end_of_word_suffix") or ""
    special = [t["id"] for t in whole.get("added_tokens") or []]
    ends = np.zeros(max([*vocabulary.values(), *special]) + 1, bool)
    ends[[*special, *(i for t, i in vocabulary.items() if t.endswith(suffix))]] = True
    return ends


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start .. start + size - 1 of all runs one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + size] one after the other."""
    return flat[runs(start, size)]


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for a worker process; what it remembers serves all tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]
