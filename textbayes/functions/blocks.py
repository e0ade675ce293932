"""Numpy side of the text functions: columns of texts in blocks of bounded size, normalization of a block, and n-grams as numbers.

A step here takes nanoseconds a character where an expression or a row for each gram takes a hundred times that.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textbayes.config import HAN

# Punctuation that is kept, placeholders, patterns and the marks that ASCII punctuation becomes.
PUNCTUATION = "，。！？；：、"
NUMBER, URL, EMAIL = "数字", "网址", "邮箱"
ASCII_MARKS, KEPT_MARKS = ",.!?;:", "，。！？；："
EDGE = "，。；：、"
TAG = re.compile("<[^>]*>")
URL_PATTERN = re.compile(r"https?://\S+|www\.\S+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[a-z0-9.\-]+\.[a-z]{2,}")

#: UTF-8 bytes of texts that are taken at once; bounds a worker's memory (one longer text is taken alone).
BLOCK_BYTES = 1 << 19
#: Ends a text in a block: beyond all code points.
END = 0x110000


def cut(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[slice]:
    """Slices of a string column with about `limit` bytes of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield slice(start, stop)
        start = stop


def mapped(column: pa.Array, change: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """A string column of what becomes of a column's blocks."""
    parts = [change(column[part]) for part in cut(column)]
    return pa.concat_arrays(parts) if parts else column.slice(0, 0)


def strings(column: pa.Array) -> list[str | None]:
    """A column's texts; bytes that aren't UTF-8 are replaced, as the JVM does."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        return [None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()]


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts, one after another, and where each text begins."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def column_of(codes: np.ndarray, at: np.ndarray) -> pa.Array:
    """The string column that points() takes apart."""
    wide = (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    ends = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(wide + 1, out=ends[1:])
    data = codes.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    if len(data) < 1 << 31:
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(ends[at].astype(np.int32)), pa.py_buffer(data))
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(ends[at]), pa.py_buffer(data))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point and END whether it is a decimal digit, and what becomes of it: itself, a mark, 0 (white space goes) or 1 (another sign)."""
    to = np.ones(END + 1, np.uint32)
    kept = [*map(ord, "abcdefghijklmnopqrstuvwxyz0123456789" + PUNCTUATION), END]
    to[kept] = kept
    for low, high in re.findall("(.)-(.)", HAN):
        to[ord(low) : ord(high) + 1] = np.arange(ord(low), ord(high) + 1)
    to[list(map(ord, ASCII_MARKS))] = list(map(ord, KEPT_MARKS))
    digits = np.zeros(END + 1, bool)
    for c in map(chr, range(END)):
        if c.isdecimal():
            digits[ord(c)] = True
        elif c.isspace():
            to[ord(c)] = 0
    return digits, to


def _mails(text: str) -> str:
    """Mail addresses replaced: leftmost matches of [a-z0-9._%+-]+@ and a domain, found from each @, in time that grows with the text only."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out += [text[done:begin], EMAIL]
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return "".join(out) + text[done:]


def _lowered(text: str | None) -> str:
    """NFKC, lower case, and placeholders for what has patterns over more than one kind of sign."""
    if not text:
        return ""
    x = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    if "<" in x:
        last = x.rfind(">") + 1  # no tag ends after it
        x = TAG.sub("", x[:last]) + x[last:]
    if "://" in x or "www." in x:
        x = URL_PATTERN.sub(URL, x)
    return _mails(x) if "@" in x else x


def normalized(texts: list[str | None]) -> pa.Array:
    """The texts that models read; see functions.text.normalize. All but what _lowered() does is done for all texts at once."""
    digits, to = _tables()
    codes, at = points([_lowered(t) + "\0" for t in texts])  # the last sign of each text gives way to END, which breaks all runs
    codes = codes.copy()
    codes[at[1:] - 1] = END
    # numbers: digits, and single points or commas between two of them
    number = digits[codes]
    number[1:-1] |= ((codes[1:-1] == ord(".")) | (codes[1:-1] == ord(","))) & number[:-2] & number[2:]
    begin = number.copy()
    begin[1:] &= ~number[:-1]
    x = to[codes]
    x[begin] = ord(NUMBER[0])
    kept = ~number | begin
    x, begin = x[kept], begin[kept]
    first = np.flatnonzero(begin)
    x = np.repeat(x, 1 + begin)
    x[first + np.arange(len(first)) + 1] = ord(NUMBER[1])
    # of equal marks side by side one stays; then white space goes; then other signs become commas, of which one stays
    again = np.zeros(len(x), bool)
    again[1:] = (x[1:] == x[:-1]) & np.isin(x[1:], list(map(ord, KEPT_MARKS)))
    x = x[~again]
    x = x[x != 0]
    x[x == 1] = ord("，")
    again = np.zeros(len(x), bool)
    again[1:] = (x[1:] == x[:-1]) & (x[1:] == ord("，"))
    x = x[~again]
    # each text from its first to its last sign that may stand at an edge
    end = np.flatnonzero(x == END)
    start = np.concatenate([[0], end[:-1] + 1]).astype(np.int64)
    inner = np.flatnonzero(~np.isin(x, [*map(ord, EDGE), END]))
    low, high = np.searchsorted(inner, start), np.searchsorted(inner, end)
    some = low < high
    a, b = np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
    a[some], b[some] = inner[low[some]], inner[high[some] - 1] + 1
    step = np.zeros(len(x) + 1, np.int64)
    np.add.at(step, a, 1)
    np.add.at(step, b, -1)
    out = np.zeros(len(end) + 1, np.int64)
    np.cumsum(b - a, out=out[1:])
    return column_of(x[np.cumsum(step[:-1]) > 0], out)


def rows_of(at: np.ndarray) -> np.ndarray:
    """For each sign of a block the number of its text."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def windows(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every n-gram that ends in the text where it begins."""
    row = rows_of(at)
    place = np.flatnonzero(row[n - 1 :] == row[: max(0, len(row) - n + 1)])
    return row[place], place


def tally(row: np.ndarray, key: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (row, key), in order, with how often they occur. Keys are less than `space`."""
    both = np.sort(row.astype(np.int64) * space + key)
    begin = np.ones(len(both), bool)
    begin[1:] = both[1:] != both[:-1]
    begin = np.flatnonzero(begin)
    row, key = np.divmod(both[begin], space)
    return row, key, np.diff(np.append(begin, len(both)))


def ranks(row: np.ndarray, rows: int) -> np.ndarray:
    """The place of each entry among those of its row; entries are in the order of rows."""
    return np.arange(len(row)) - np.searchsorted(row, np.arange(rows))[row]


class Packed:
    """The n-grams of a block as numbers below `space`, at the place where each begins."""

    def __init__(self, codes: np.ndarray, n: int):
        self.letters = np.flatnonzero(np.bincount(codes)) if len(codes) else np.zeros(0, np.int64)
        short = np.zeros(int(self.letters[-1]) + 1 if len(codes) else 0, np.int64)
        short[self.letters] = np.arange(len(self.letters))
        a, size = short[codes], max(1, len(self.letters))
        count = max(0, len(codes) - n + 1)
        self.n, self.space, self.keys, self.numbers = n, size, [], a[:count]
        for k in range(1, n):
            keys = None
            if self.space * size > 1 << 40:  # numbers of the prefixes that occur, so that the product fits
                keys, self.numbers = np.unique(self.numbers, return_inverse=True)
                self.space = len(keys)
            self.keys.append(keys)
            self.numbers = self.numbers * size + a[k : k + count]
            self.space *= size

    def strings(self, numbers: np.ndarray) -> pa.Array:
        out = np.empty((len(numbers), self.n), np.uint32)
        for k in range(self.n - 1, 0, -1):
            numbers, last = np.divmod(numbers, len(self.letters))
            out[:, k] = self.letters[last]
            if self.keys[k - 1] is not None:
                numbers = self.keys[k - 1][numbers]
        out[:, 0] = self.letters[numbers]
        return column_of(out.ravel(), np.arange(len(out) + 1) * self.n)


def grams(codes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, gram, times, strings): the distinct n-grams of each text, as places in an array of those of the block. Grams of nothing but PUNCTUATION are left out."""
    packed, (row, place) = Packed(codes, n), windows(at, n)
    mark = np.isin(codes, list(map(ord, PUNCTUATION)))
    only = np.ones(len(place), bool)
    for k in range(n):
        only &= mark[place + k]
    row, key, times = tally(row[~only], packed.numbers[place[~only]], packed.space)
    keys, gram = np.unique(key, return_inverse=True)
    return row, gram, times, packed.strings(keys)


class Lookup:
    """Finds given grams, all of one length, in texts: letter by letter, through numbers of the prefixes that are known."""

    def __init__(self, grams: list[str]):
        signs = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(len(grams), -1)
        letters = np.unique(signs)
        self.letter, self.size = np.zeros(END + 1, np.int32), len(letters) + 1
        self.letter[letters] = np.arange(1, self.size)
        node, last, self.levels = self.letter[signs[:, 0]].astype(np.int64), self.size - 1, []
        for k in range(1, signs.shape[1]):
            key = node * self.size + self.letter[signs[:, k]]
            keys = np.unique(key)
            node, last = np.searchsorted(keys, key) + 1, len(keys)
            table = None
            if keys[-1] < 1 << 22:
                table = np.zeros(keys[-1] + 2, np.int32)  # the last stands for all beyond
                table[keys] = np.arange(1, last + 1)
            self.levels.append((keys, table))
        self.number = np.full(last + 1, -1, np.int64)
        self.number[node] = np.arange(len(grams))

    def __call__(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each sign the number of the gram that begins there, or -1."""
        letter = self.letter[codes].astype(np.int64)
        out = np.full(len(codes), -1, np.int64)
        node = letter
        for k, (keys, table) in enumerate(self.levels, 1):
            key = node[: max(0, len(codes) - k)] * self.size + letter[k:]
            if table is not None:
                node = table[np.minimum(key, len(table) - 1)].astype(np.int64)
            else:
                there = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                node = np.where(keys[there] == key, there + 1, 0)
        found = self.number[node]
        _, place = windows(at, len(self.levels) + 1)
        out[place] = found[place]
        return out
