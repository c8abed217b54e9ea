"""Token ids of whole texts by a public tokenizer, with a memo of text units.

A text is cut at places that no token of the public vocabularies can reach
across: before a plain space, on both sides of a line feed, and between an ASCII
letter and ASCII punctuation, wherever the bytes beside the place decide that.
The file's added tokens, where a text holds one, stay whole. The ids of a text
are those of its units one after another. Units repeat, and the tokenizers
library sees each of them once for each worker while the memo has room; a full
memo keeps what it has, and other units, long ones too, are encoded where they
stand. Equal units are found by a hash, and their bytes compared, in a chunk and
with the memo.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from sparkloom.llm.common import kept_by_workers, span_hashes

#: Units that a worker remembers, and their most bytes.
MEMO_UNITS = 400_000
LONGEST_KEPT = 256
#: Bytes of text that are encoded together; with the end, a power of two of places.
ENCODE_BYTES = (1 << 20) - 1
END_ID = 1

#: Kinds of bytes: 1 surely no white space, 2 an ASCII letter, 3 ASCII punctuation but no apostrophe.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x27] = 1
_KIND[0x30:0x3A] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x61:0x7B] = 2
_KIND[0xC3:0xE1] = 1
_KIND[0xE4:0xF5] = 1


def _cuts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For each place between two bytes whether units end there.

    ``firsts`` are the places of bytes that begin a text: what ends before one
    ends as a text does. Of a run of white space the splitting rules take all but
    the last character together, if something follows, so the place before that
    last one is a cut whatever stands before it, and the place after a line feed
    is one only together with the place before it.
    """
    kind = _KIND[data]
    a, b = kind[:-1], kind[1:]
    cut = (a >= 2) & (b >= 2) & (a != b)
    cut |= (data[1:] == 0x0A) & (a > 0)
    ahead = kind > 0
    ahead[firsts] = False
    last = ahead[1:] & (data[:-1] == 0x0A)  # line feeds that end a run of white space
    cut |= last
    cut[:-1] |= last[1:] | (ahead[2:] & (data[1:-1] == 0x20))
    return cut


def _equal_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, like: np.ndarray) -> bool:
    """Whether each unit has the bytes of the unit whose number ``like`` holds."""
    lengths = end - start
    if not np.array_equal(lengths, lengths[like]):
        return False
    other = np.repeat((start[like] - start).astype(np.int32), lengths)  # units lie one after another
    other += np.arange(start[0], end[-1], dtype=np.int32)
    return np.array_equal(data[other], data[start[0] : end[-1]])


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


#: One run of letters below U+0100, perhaps after a space: its model form is known.
_plain = re.compile(" ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+").fullmatch


def _kept(words: list[str]) -> list[str]:
    """The model's forms of plain words: as they are."""
    return "\n".join(words).encode().decode("latin-1").translate(_LETTERS).split(_LETTERS[0x0A])


def _folded(words: list[str]) -> list[str]:
    """The model's forms of plain words: in lower case, without the space."""
    return "\n".join(words).replace(" ", "").lower().encode().decode("latin-1").translate(_LETTERS).split(_LETTERS[0x0A])


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each distinct hash, and for each hash its number among them."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(order), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def _room(held: np.ndarray, need: int) -> np.ndarray:
    """``held``, doubled until it has ``need`` places."""
    while len(held) < need:
        held = np.concatenate([held, np.zeros(len(held), held.dtype)])
    return held


class Units:
    """Encodes texts with the tokenizers library, remembering units."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = sorted(self.tokenizer.get_added_tokens_decoder().values(), key=lambda t: -len(t.content.encode()))
        #: Added tokens that a text may hold; the longest of those that begin at a place is meant.
        self.added = re.compile(b"|".join(re.escape(t.content.encode()) for t in added)) if added else None
        #: Texts are not cut if an added token takes what stands beside it or is sought in normalised text.
        self.cutting = not any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added)
        self.form = next((f for f in (_kept, _folded) if all(map(_plain, PROBES)) and list(map(self._whole, PROBES)) == self._words(f, PROBES)), None)
        #: Ids of the units at hand, one after another; the first ``kept`` units are the memo.
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int32)
        self.used = self.count = self.kept = 0
        #: The memo's bytes, and its hashes in order with the units that have them.
        self.bytes = np.zeros(1 << 16, np.uint8)
        self.begin = np.zeros(1, np.int64)
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _words(self, form, words: list[str]) -> list[list[int]]:
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(word)] for word in form(words)]

    def _encoded(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit. Plain words go to the library's model without its splitting rules."""
        out: list = [None] * len(units)
        plain = [i for i, unit in enumerate(units) if _plain(unit)] if self.form else []
        if plain:
            for i, ids in zip(plain, self._words(self.form, [units[i] for i in plain]), strict=True):
                out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    def _spans(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Starts and ends of the added tokens written in the texts."""
        found, at = [], 0
        while self.added and (m := self.added.search(raw, at)):
            end = int(offsets[np.searchsorted(offsets, m.start(), "right")])  # of its text
            m = self.added.search(raw, m.start(), end)
            if m:
                found.append(m.span())
            at = m.end() if m else end
        return np.array(found, np.int64).reshape(-1, 2)

    def _edges(self, data: np.ndarray, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Places where units begin, and the end. An added token is a unit, and a text ends before and begins after it."""
        n = len(data)
        edge = np.zeros(n + 1, bool)
        if self.cutting:
            spans = self._spans(raw, offsets)
            firsts = np.concatenate([offsets, spans.ravel()])
            edge[1:n] = _cuts(data, firsts[firsts < n])
            for a, b in spans.tolist():
                edge[a : b + 1] = False
            edge[spans.ravel()] = True
        edge[offsets] = True
        return np.flatnonzero(edge)

    def _append(self, many: list[list[int]]) -> None:
        n, have = sum(map(len, many)), self.count
        self.ids = _room(self.ids, self.used + n)
        self.first, self.length = _room(self.first, have + len(many)), _room(self.length, have + len(many))
        lengths = np.fromiter(map(len, many), np.int32, len(many))
        self.ids[self.used : self.used + n] = np.fromiter(chain.from_iterable(many), np.uint32, n)
        self.length[have : have + len(many)] = lengths
        self.first[have : have + len(many)] = self.used + np.cumsum(lengths) - lengths
        self.used += n
        self.count += len(many)

    def _remembered(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, bool]:
        """The memo's number of each unit, or -1, and whether a unit has the hash of another one there."""
        if not self.kept:
            return np.full(len(start), -1, np.int64), False
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.kept - 1)
        number = np.where(self.hashes[at] == hashes, self.numbers[at], -1)
        met = np.flatnonzero(number >= 0)
        have, size = number[met], size[met]
        like = size == self.begin[have + 1] - self.begin[have]
        if like.all():
            ends = np.cumsum(size)
            place = np.arange(ends[-1] if len(ends) else 0)
            same = data[place + np.repeat(start[met] - ends + size, size)] == self.bytes[place + np.repeat(self.begin[have] - ends + size, size)]
            like[np.searchsorted(ends, np.flatnonzero(~same), "right")] = False
        else:  # hashes that meet are rare enough to compare unit by unit
            for i in np.flatnonzero(like).tolist():
                a, b, n = start[met[i]], self.begin[have[i]], size[i]
                like[i] = np.array_equal(data[a : a + n], self.bytes[b : b + n])
        number[met[~like]] = -1
        return number, not like.all()

    def _remember(self, units: list[bytes], hashes: np.ndarray) -> None:
        """Keep the units that were appended first after the kept ones."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        a, b = int(self.begin[self.kept]), int(self.begin[-1])
        self.bytes = _room(self.bytes, b)
        self.bytes[a:b] = np.frombuffer(b"".join(units), np.uint8)
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes, self.numbers = every[order], np.concatenate([self.numbers, np.arange(self.kept, self.kept + len(units))])[order]
        self.kept += len(units)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and the n + 1 offsets of rows in them.

        ``end_id`` closes each row. An empty row has that id alone.
        """
        rows, n = len(offsets) - 1, len(data)
        if n:
            raw = data.tobytes()
            edges = self._edges(data, raw, offsets)
            start, end = edges[:-1], edges[1:]
            every = span_hashes(data, start, end)
            pick, back = _distinct(every)
            clash = not _equal_bytes(data, start, end, pick[back])
            if clash:  # two units have one hash: tell all apart by their bytes
                numbers: dict[bytes, int] = {}
                back = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
                pick = np.unique(back, return_index=True)[1]
            begin, size, hashes = start[pick], (end - start)[pick], every[pick]
            number, other = self._remembered(data, begin, size, hashes)
            if len(new := np.flatnonzero(number < 0)):
                long = size[new] > LONGEST_KEPT
                new, short = new[np.argsort(long, kind="stable")], len(new) - int(long.sum())
                fresh = [raw[a : a + n] for a, n in zip(begin[new].tolist(), size[new].tolist(), strict=True)]
                number[new] = np.arange(self.count, self.count + len(fresh))
                self._append(self._encoded([k.decode("utf-8", "replace") for k in fresh]))
                if short and not clash and not other and self.kept + short <= MEMO_UNITS:
                    self._remember(fresh[:short], hashes[new[:short]])
            unit = number[back]
            lengths = self.length[unit].astype(np.int64)
            unit_row = np.searchsorted(start, offsets)  # first unit of each row
        else:
            unit, lengths, unit_row = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
        reach = np.zeros(len(unit) + 1, np.int64)
        np.cumsum(lengths, out=reach[1:])
        extra = 0 if end_id is None else 1
        row_at = reach[unit_row] + extra * np.arange(rows + 1)
        out = np.empty(int(row_at[-1]), np.uint32)
        if extra:
            out[row_at[1:] - 1] = end_id
        if reach[-1]:
            source = np.repeat(self.first[unit] - reach[:-1], lengths) + np.arange(reach[-1])
            target = np.arange(reach[-1]) + (np.repeat(np.arange(rows), np.diff(reach[unit_row])) if extra else 0)
            out[target] = self.ids[source]
        if self.count > self.kept:  # what the memo does not keep
            self.count = self.kept
            self.used = int(self.first[self.kept - 1] + self.length[self.kept - 1]) if self.kept else 0
        return out, row_at


#: Words that show how a vocabulary's model wants plain words.
PROBES = (" the", "the", " Thstinnt", "Onhalyti", " été", "Großmut", " QUEUE", "ñandú", " a", "zzyzx", " Ärger")

_loaded: dict[str, Units] = {}
kept_by_workers.append(_loaded)


def units(path: str) -> Units:
    """The encoder of a vocabulary file, once per worker."""
    if path not in _loaded:
        _loaded[path] = Units(path)
    return _loaded[path]


def public_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
