"""Token counts: exact counts at every prefix that ends with a token, so that truncation and budgets need no second encoding.

The count at a prefix is the number of the text's tokens that end within it: what is left when its tokens are cut there. The dynamic program over a
text is count[end of a token] = count[end of the token before] + 1; it is stored as the array of these ends, in bytes. White space never lies inside a
token and separates the tokenizer's normalization, so the tokens of words stand side by side; those of distinct words come from the tokenizer
once and are kept in a bounded table, and a block's ends are put together from it by arrays. At the end of a word the count is also that of the prefix
encoded alone; inside one that may differ, since a tokenizer may mark the ends of words.
"""

from __future__ import annotations

import json
import os
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks

#: Pieces whose tokens a worker keeps in each of two generations.
KEPT = 250_000
#: Marks that form a token run of their own at a word's end, so what stands before them is counted alone.
ENDINGS = b".,;:!?"
#: Bytes that separate words; each is white space to the tokenizer.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


_END = np.isin(np.arange(256), list(ENDINGS))
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_UPPER = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)


class Table:
    """Pieces of text and their token ends, all ends in one array."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ends, self.first = array("i"), array("q", [0])

    def add(self, piece: bytes, ends) -> None:
        self.ends.extend(ends)
        self.number[piece] = len(self.first) - 1
        self.first.append(len(self.ends))

    def of(self, piece: bytes) -> array:
        k = self.number[piece]
        return self.ends[self.first[k] : self.first[k + 1]]


class Counter_:
    """Tokens of pieces of text for one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        normalizers = json.loads(self.tokenizer.to_str())["normalizer"] or {}
        self.lower = "Lowercase" in {n["type"] for n in [normalizers, *normalizers.get("normalizers", [])] if n}
        self.kept, self.before = Table(), Table()

    def encode(self, pieces: list[bytes]):
        """The end of each token, in bytes; tokens that share a character end with it."""
        for piece, e in zip(pieces, self.tokenizer.encode_batch([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False), strict=True):
            if len(e) == 1 and e.offsets[0][1] == len(piece):
                yield (len(piece),)
            elif piece.isascii():
                yield [b for _, b in e.offsets]
            else:
                at = [0, *accumulate(len(c.encode()) for c in piece.decode("utf-8", "replace"))]
                yield accumulate((at[b] for _, b in e.offsets), max)

    def learn(self, pieces: set[bytes]) -> None:
        """Encodes pieces that aren't kept; when a generation is full, the one before it goes, so that frequent pieces stay."""
        if len(self.kept.number) + len(pieces) > KEPT:
            self.before, self.kept = self.kept, Table()
        kept, before, new = self.kept, self.before, []
        for p in pieces - kept.number.keys():
            if p in before.number:
                kept.add(p, before.of(p))
            else:
                new.append(p)
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            for piece, ends in zip(part, self.encode(part), strict=True):
                kept.add(piece, ends)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Where the pieces of a block of texts begin and end, and the bytes to encode.

        Pieces are words. If the tokenizer lowers, the last marks of a word are a piece of their own where a letter or digit stands before them (else they'd
        be part of a longer run of marks), and words of ASCII are lowered, so that fewer are distinct. Others aren't: the tokenizer composes before it
        lowers, and H with a macron below composes in small letters only. A word with < stays as it is, for special strings.
        """
        there = ~_SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[0] = cut[-1] = True
        cut[offsets] = True
        cut[1:-1] |= there[1:] != there[:-1]
        begin, stop = np.flatnonzero(there & cut[:-1]), np.flatnonzero(there & cut[1:]) + 1
        if not self.lower or not len(begin):
            return begin, stop, data.tobytes()
        # a word's bytes are together, and nothing but separators lies between words
        special, beyond = (np.bitwise_or.reduceat(x, begin) for x in ((data == 0x3C) & there, (data >= 0x80) & there))
        lowered = data.copy()
        small = _UPPER[data]
        small[: begin[0]] = False
        small[begin[0] :] &= np.repeat(~special & ~beyond, np.diff(np.append(begin, len(data))))
        lowered[small] += 32
        last = np.maximum.accumulate(np.where(_END[data], -1, np.arange(len(data))))[stop - 1]  # the last byte that is no such mark
        split = (last >= begin) & (last < stop - 1) & ~special
        split[split] = _ALNUM[data[last[split]]]
        at = last[split] + 1
        return np.sort(np.append(begin, at)), np.sort(np.append(stop, at)), lowered.tobytes()

    def ends(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a block of texts: the token ends, in bytes of their text, and how many each text has."""
        begin, stop, whole = self.pieces(data, offsets)
        found = [whole[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        self.learn(set(found))
        number = np.fromiter(map(self.kept.number.__getitem__, found), np.int64, len(found))
        first, kept = np.array(self.kept.first, np.int64), np.array(self.kept.ends, np.int32)
        n = first[number + 1] - first[number]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text = np.searchsorted(offsets, begin, "right") - 1
        ends = kept[np.repeat(first[number], n) + at] + np.repeat(begin - offsets[text], n)
        return ends.astype(np.int32), np.bincount(text, n, len(offsets) - 1).astype(np.int64)


def within(ends: np.ndarray, n_bytes: int, limit: int) -> int:
    """Bytes of the longest prefix that ends with a token and has at most `limit` of them; all bytes if the text has no more."""
    if len(ends) <= limit:
        return n_bytes
    k = int(np.searchsorted(ends, ends[limit], "left"))  # tokens that end where the first one too many does don't fit either
    return int(ends[k - 1]) if k else 0


def before(ends: np.ndarray, end: int) -> int:
    """Tokens that end within the first `end` bytes."""
    return int(np.searchsorted(ends, end, "right"))


def _counts(path: str):
    def run(batches):
        counter = Counter_(path)
        for rows, data, offsets in blocks(batches):
            ends, n = counter.ends(data, offsets)
            held = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(ends))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(offsets)), held], ["doc_id", "n_bytes", "token_ends"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_bytes, token_ends), one row for each row, repeats too.

    token_ends has the end, in bytes, of each token that the tokenizer gives without special tokens added, truncation or padding; special strings inside
    a text count as the tokenizer's default has it. So its size is the number of tokens, and the count at any prefix is the number of ends
    within it; tokens that share a character have the same end, and a tie is settled by counting all or none. Null and empty texts and texts of white space have
    none; a long text is encoded word by word, a long word at once. An empty table gives an empty result. Other columns are ignored. Tasks
    read the tokenizer's file by path.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _counts(tokenizer_path), "doc_id long, n_bytes long, token_ends array<int>"
    )


def cut_bytes(n_bytes: Column, ends: Column, limit: int) -> Column:
    """within() of stored counts: where to cut a text so that it keeps at most `limit` tokens."""
    stop = F.get(ends, F.lit(limit))
    fitting = F.coalesce(F.array_max(F.filter(F.slice(ends, 1, limit), lambda e: e < stop)), F.lit(0)).cast("long")
    return F.when(F.size(ends) <= limit, n_bytes).otherwise(fitting)
