"""Byte-level pre-tokens of whole texts, with the work done once per distinct word.

A match of the byte-level pattern never spans a space that is followed by a non-space character: the space opens the
next match. So a text may be cut at such spaces into units, a unit into words (the pattern's matches), and every
distinct word need be encoded once. Units and words are kept in caches bounded by their bytes; a full cache is emptied,
which costs time and never changes a result. `Flat` also cuts at other places where matches end, so that most of its
units are single words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space that opens no match of the pattern.
_ODD = re.compile(r" (?=\s|$)")
_CUT = re.compile(r"(?= \S)")
#: Closing marks that form one match of their own when they follow letters.
_MARKS = "!#$%&*.,;:?|)"
#: White space in UTF-8, by length, as big-endian numbers.
_WHITE = {n: np.array([int.from_bytes(c.encode()) for c in map(chr, range(0xD800)) if c.isspace() and len(c.encode()) == n]) for n in (1, 2, 3)}
#: Bytes of letters, of all else in ASCII, and of what is no white space.
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_OTHER = np.array([not chr(b).isalpha() and b < 128 for b in range(256)])
_SOLID = np.array([32 < b < 127 for b in range(256)])
#: What an entry of a dictionary takes beside the letters of its key and the bytes of its value.
_ENTRY = 180


class Units:
    """Values of the units of texts; `encode` gives the values of distinct words, `join` that of a unit from its words.

    `limit` is in bytes, for words and units together; one call may go beyond it by what its own texts need.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], list], join: Callable[[list], bytes], limit: int = 64 << 20):
        import regex

        self.findall = regex.compile(pattern).findall
        self.encode, self.join, self.limit = encode, join, limit
        self.kept = 0  # bytes, by estimate
        self.words: dict[str, object] = {}
        self.after: dict[str, object] = {}  # units that follow a space, without it
        self.whole: dict[str, object] = {}  # other units

    def __call__(self, texts: Iterable[str]) -> list[list]:
        """For each text the values of its units, in order."""
        if self.kept > self.limit:
            self.forget()
        cut, tails, heads = [], set(), set()
        for t in texts:
            if _ODD.search(t):
                head, tail = [u for u in _CUT.split(t) if u], ()
            else:
                first, *tail = t.split(" ")
                head = [first] if first else []
            cut.append((head, tail))
            heads.update(head)
            tails.update(tail)
        tails -= self.after.keys()
        heads -= self.whole.keys()
        self._learn(tails, heads)
        after, whole = self.after.__getitem__, self.whole.__getitem__
        return [[*map(whole, h), *map(after, t)] for h, t in cut]

    def forget(self) -> None:
        for kept in (self.words, self.after, self.whole):
            kept.clear()
        self.kept = 0

    def _learn(self, tails: set[str], heads: set[str]) -> None:
        # most units are one word, and are kept as units alone
        single = [u for u in tails if u.isalpha()]
        values = self.encode([f" {u}" for u in single]) if single else []
        self.after.update(zip(single, values, strict=True))
        several = [(self.after, u, _split(f" {u}", self.findall)) for u in tails if not u.isalpha()] + [(self.whole, u, _split(u, self.findall)) for u in heads]
        words, after = self.words, self.after
        fresh = [w for w in {w for _, _, ws in several for w in ws} if w not in words and not (w[0] == " " and w[1:] in after)]
        more = self.encode(fresh) if fresh else []
        words.update(zip(fresh, more, strict=True))
        joined = []
        for into, unit, ws in several:
            into[unit] = value = self.join([words[w] if w in words else after[w[1:]] for w in ws])
            joined.append(value)
        # letters beyond ASCII take two bytes or four
        self.kept += _ENTRY * (len(single) + len(fresh) + len(several)) + 2 * (sum(map(len, fresh)) + sum(map(len, tails)) + sum(map(len, heads)))
        self.kept += sum(map(len, values)) + sum(map(len, more)) + sum(map(len, joined))


class Flat:
    """As `Units`, for whole Arrow columns: equal units of a call are found by one dictionary of
    their bytes, and only those that are distinct are looked up. A space that opens a unit belongs to it.

    `limit` is in bytes, for words and units together; one call may go beyond it by what its own texts need.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]], limit: int = 64 << 20):
        import regex

        self.findall = regex.compile(pattern).findall
        self.encode, self.limit = encode, limit
        self.kept = 0  # bytes, by estimate
        self.known: dict[str, bytes] = {}  # words and units

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The values of the units of all texts, one after another, and where each text's begin, then where the last's end.

        Null is an empty text.
        """
        if self.kept > self.limit:
            self.forget()
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        _, places, letters = texts.buffers()
        ends = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(letters or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        begins = _unit_begins(data, ends)
        units = pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        names = units.dictionary.cast(pa.string()).to_numpy(zero_copy_only=False).tolist()
        values = list(map(self.known.get, names))
        if fresh := [i for i, v in enumerate(values) if v is None]:
            self._learn([names[i] for i in fresh])
            for i in fresh:
                values[i] = self.known[names[i]]
        return pa.array(values, pa.large_binary()).take(units.indices), np.searchsorted(begins, ends)

    def forget(self) -> None:
        self.known.clear()
        self.kept = 0

    def _learn(self, units: list[str]) -> None:
        known = self.known
        # most units are one word
        single = [u for u in units if u.removeprefix(" ").isalpha()]
        split = [(u, _split(u, self.findall)) for u in units if not u.removeprefix(" ").isalpha()]
        fresh = [w for w in dict.fromkeys(chain(single, *(found for _, found in split))) if w not in known]
        values = self.encode(fresh)
        known.update(zip(fresh, values, strict=True))
        several = [u for u, found in split if len(found) > 1]
        joined = [b"".join([known[w] for w in found]) for _, found in split if len(found) > 1]
        known.update(zip(several, joined, strict=True))
        # letters beyond ASCII take two bytes or four
        self.kept += _ENTRY * (len(fresh) + len(several)) + 2 * (sum(map(len, fresh)) + sum(map(len, several)))
        self.kept += sum(map(len, values)) + sum(map(len, joined))


def _split(unit: str, findall: Callable[[str], list[str]]) -> list[str]:
    """The words of a unit."""
    base = unit[1:] if unit[:1] == " " else unit
    if base.isalpha():
        return [unit]
    stem = base.rstrip(_MARKS)
    if stem.isalpha():
        n = len(unit) - len(base) + len(stem)
        return [unit[:n], unit[n:]]
    return findall(unit)


def _unit_begins(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where units begin in texts' bytes, and the end.

    A unit begins with each text and at each space before what is no white space. It also begins where a match always
    does and none before it looks ahead: after a run of letters, before a line break that follows no white space, and
    after one that stands alone. Of these, places are taken only at characters up to U+00FF.
    """
    mark = np.zeros(len(data) + 1, bool)
    mark[ends] = True
    at = np.flatnonzero(data == 32)
    at = at[~mark[at + 1]]  # a text's last letter opens nothing
    first = data[at + 1]
    white = np.isin(first, _WHITE[1])
    for n, leads in ((2, (0xC2,)), (3, (0xE1, 0xE2, 0xE3))):
        some = np.flatnonzero(np.isin(first, leads))
        code = sum(data[at[some] + 1 + i].astype(np.int64) << 8 * (n - 1 - i) for i in range(n))
        white[some] = np.isin(code, _WHITE[n])
    mark[at[~white]] = True
    letter, solid = _LETTER[data], _SOLID[data]
    latin = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF: letters but for two signs
    letter[latin + 1] = (data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)
    opens = solid.copy()
    opens[latin] = solid[latin + 1] = True
    mark[1:-1] |= letter[:-1] & _OTHER[data[1:]]
    line = np.flatnonzero(data[1:] == 10) + 1
    line = line[solid[line - 1]]
    mark[line] = True
    line = line[line + 1 < len(data)]
    mark[line[opens[line + 1]] + 1] = True
    return np.flatnonzero(mark)
