"""SentencePiece encoding and decoding: a unigram Viterbi over a double-array trie of pieces, with byte fallback.

The pieces come from a model file; nothing is trained. A model that stores log probabilities is used with them; one that stores merge
ranks (BPE) gets scores from the ranks by Zipf's law, since sums of ranks would prefer many frequent pieces to one whole word.

No piece goes on from other text into a white-space marker or over a character that no piece has, so a text falls apart there into
chunks whose best segmentations are independent. Distinct new chunks of a block are segmented together, those of equal length as a
matrix: each step of the Viterbi walks the trie for all of them at once. Results are kept for later blocks in a bounded table.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, texts

MARK = "▁".encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: An unknown character scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Chunks whose ids a worker keeps in each of two generations.
KEPT = 200_000
#: Longer chunks are segmented one by one.
LONG = 64


def _fields(data: bytes):
    """(number, value) of a serialized message; value: int, or bytes for strings and 32-bit values."""
    i = 0

    def varint():
        nonlocal i
        x = shift = 0
        while True:
            b = data[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[i : i + n]
            i += n


def mapped(charmap: bytes) -> dict[bytes, bytes]:
    """The replacements of a compiled character map: a size, a double array of units, and the replacements, each ended by a zero byte.

    A unit has its label in the low 8 bits, bit 8 if a key ends below it, and the distance to its children from bit 10 on, times 256 with bit 9.
    """
    if not charmap:
        return {}
    (size,) = struct.unpack_from("<I", charmap)
    units, values = np.frombuffer(charmap, "<u4", size // 4, 4), charmap[4 + size :]
    out, stack, labels = {}, [(0, b"")], np.arange(1, 256)
    while stack:
        at, key = stack.pop()
        unit = int(units[at])
        below = at ^ ((unit >> 10) << ((unit & 512) >> 6))
        if unit >> 8 & 1:
            start = int(units[below]) & 0x7FFFFFFF
            out[key] = values[start : values.index(b"\0", start)]
        places = below ^ labels
        there = places < len(units)
        there[there] = (units[places[there]] & 0x800000FF) == labels[there]
        stack += [(int(p), key + bytes([c])) for p, c in zip(places[there], labels[there], strict=True)]
    return out


class Normalizer:
    """What a model does to texts first: the longest key of the character map at each place is replaced, user-defined pieces stay; runs of spaces
    become one, and those at the ends go, if the model says so."""

    def __init__(self, charmap: bytes, squeezed: bool, user: list[bytes]):
        self.to = {**mapped(charmap), **{p: p for p in user}} if charmap else {}
        self.user, self.squeezed = frozenset(user), squeezed
        self.longest = max(map(len, self.to), default=0)
        begins = sorted({k.decode("utf-8", "replace")[0] for k in self.to})
        self.place = re.compile("[" + re.escape("".join(begins)) + "]") if begins else None

    def __call__(self, text: bytes) -> bytes:
        if self.place is not None:
            whole, out, at = text.decode("utf-8", "replace"), [], 0
            while found := self.place.search(whole, at):
                start = found.start()
                ahead = whole[start : start + self.longest].encode()[: self.longest]
                keys = [k for n in range(len(ahead), 0, -1) if (k := ahead[:n]) in self.to]
                key = next((k for k in keys if k in self.user), keys[0] if keys else whole[start].encode())
                out += [whole[at:start].encode(), self.to.get(key, key)]
                at = start + len(key.decode())
            text = b"".join(out) + whole[at:].encode()
        return re.sub(b" +", b" ", text).strip(b" ") if self.squeezed else text


class Pieces:
    """The pieces of a model file: bytes, scores and kinds by id."""

    def __init__(self, path: str):
        self.piece, self.score, self.kind = [], [], []
        model_type, self.prefix, squeezed, charmap = 1, True, True, b""
        for number, value in _fields(open(path, "rb").read()):
            if number == 1:
                f = dict(_fields(value))
                self.piece.append(bytes(f.get(1, b"")))
                self.score.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kind.append(f.get(3, NORMAL))
            elif number == 2:
                model_type = dict(_fields(value)).get(3, 1)
            elif number == 3:
                f = dict(_fields(value))
                charmap, self.prefix, squeezed = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
        self.normalizer = Normalizer(charmap, squeezed, [p for p, k in zip(self.piece, self.kind, strict=True) if k == USER])
        if model_type != 1:
            normal = [i for i, k in enumerate(self.kind) if k == NORMAL]
            for rank, i in enumerate(sorted(normal, key=lambda i: (-self.score[i], i))):
                self.score[i] = float(np.float32(-np.log(rank + 2.7)))
        self.byte = np.full(256, -1, np.int32)
        for i, k in enumerate(self.kind):
            if k == BYTE:
                self.byte[int(self.piece[i][3:-1], 16)] = i
        self.unknown = self.kind.index(UNKNOWN)


class Trie:
    """A double-array trie over bytes: child c of node s is base[s] + c + 1 if check there is s; value: the piece that ends in a node."""

    SPAN = 4096

    def __init__(self, keys: dict[bytes, int]):
        words = sorted(keys)
        size = 4 * sum(map(len, words)) + 2 * self.SPAN + 1024
        used = bytearray(size)
        taken = np.frombuffer(used, np.uint8)
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used[0] = 1
        check[0] = 0
        free, stack = 1, [(0, 0, 0, len(words))]
        while stack:
            node, depth, a, b = stack.pop()
            if a < b and len(words[a]) == depth:
                value[node] = keys[words[a]]
                a += 1
            if a == b:
                continue
            codes, starts = [], []
            for i in range(a, b):
                c = words[i][depth] + 1
                if not codes or codes[-1] != c:
                    codes.append(c)
                    starts.append(i)
            starts.append(b)
            free = used.index(0, free)
            at = max(free - codes[0], 1)
            if len(codes) == 1:
                at = used.index(0, at + codes[0]) - codes[0]
            else:
                while True:  # the first place where all children are free, a span of places at a time
                    bad = np.zeros(self.SPAN, np.uint8)
                    for c in codes:
                        bad |= taken[at + c : at + c + self.SPAN]
                    first = int(bad.argmin())
                    if not bad[first]:
                        at += first
                        break
                    at += self.SPAN
            base[node] = at
            for c, x, y in zip(codes, starts, starts[1:], strict=False):
                used[at + c] = 1
                check[at + c] = node
                stack.append((at + c, depth + 1, x, y))
        end = len(used.rstrip(b"\0")) + 300
        self.base, self.check, self.value = base[:end].copy(), check[:end].copy(), value[:end].copy()


class Segmenter:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        known = {p: i for i, (p, k) in enumerate(zip(pieces.piece, pieces.kind, strict=True)) if k in (NORMAL, USER)}
        self.trie = Trie(known)
        self.score = np.array(pieces.score, np.float64)
        self.unknown_score = min(pieces.score[i] for i in known.values()) - UNKNOWN_PENALTY
        if any(b" " in p.replace(MARK, b" ").lstrip(b" ") for p in known):
            raise ValueError("a piece goes on into a white-space marker")
        self.breaks = not any(b"\n" in p for p in known)
        self.chunk = re.compile(rb"\n| *[^ \n]+| +" if self.breaks else rb" *[^ ]+| +")
        self.kept: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.text = [
            b"" if k in (CONTROL, UNKNOWN) else bytes([int(p[3:-1], 16)]) if k == BYTE else p.replace(MARK, b" ") for p,
            k in zip(pieces.piece, pieces.kind, strict=True)
        ]
        self.text[pieces.unknown] = " ⁇ ".encode()

    def chunks(self, text: bytes) -> list[bytes]:
        """Chunks with plain spaces for markers; a literal marker is the same as a space to the model."""
        text = self.pieces.normalizer(text).replace(MARK, b" ")
        return self.chunk.findall(b" " + text if self.pieces.prefix and text else text)

    def _ids(self, spans: list[tuple[int, int, int]], raw: bytes) -> bytes:
        out = []
        for a, b, piece in spans:
            if piece >= 0:
                out.append(piece)
            elif (self.pieces.byte >= 0).all():
                out += self.pieces.byte[list(raw[a:b])].tolist()
            elif not out or out[-1] != self.pieces.unknown:
                out.append(self.pieces.unknown)
        return np.array(out, np.int32).tobytes()

    def _alone(self, raw: bytes) -> bytes:
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        n = len(raw)
        best, back = [-np.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -np.inf:
                continue
            width = min(n - i, 1 + (raw[i] >= 0xC0) + (raw[i] >= 0xE0) + (raw[i] >= 0xF0))
            node, single = 0, False
            for j in range(i, n):
                nxt = int(base[node]) + raw[j] + 1
                if base[node] == 0 or check[nxt] != node:
                    break
                node = nxt
                piece = int(value[node])
                if piece >= 0:
                    single |= j + 1 - i == width
                    if best[i] + score[piece] > best[j + 1]:
                        best[j + 1], back[j + 1] = best[i] + score[piece], (i, piece)
            if not single and best[i] + self.unknown_score > best[i + width]:
                best[i + width], back[i + width] = best[i] + self.unknown_score, (i, -1)
        spans, at = [], n
        while at:
            i, piece = back[at]
            spans.append((i, at, piece))
            at = i
        return self._ids(spans[::-1], raw)

    def _together(self, raw: list[bytes]) -> list[bytes]:
        """Viterbi of texts with the same length; the same steps as for one, each over all rows."""
        n, m = len(raw[0]), len(raw)
        a = np.frombuffer(b"".join(raw), np.uint8).reshape(m, n)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best = np.full((n + 1, m), -np.inf)
        back_at, back_piece = np.zeros((n + 1, m), np.int32), np.full((n + 1, m), -1, np.int32)
        best[0] = 0
        widths = 1 + (a >= 0xC0) + (a >= 0xE0) + (a >= 0xF0)
        for i in range(n):
            rows = np.flatnonzero(best[i] > -np.inf)
            if not len(rows):
                continue
            width = np.minimum(widths[rows, i], n - i)
            single = np.zeros(m, bool)
            live, node = rows, np.zeros(len(rows), np.int32)
            for j in range(i, n):
                nxt = base[node] + a[live, j] + 1
                ok = (base[node] > 0) & (check[nxt] == node)
                live, node = live[ok], nxt[ok]
                if not len(live):
                    break
                piece = value[node]
                end = piece >= 0
                r, p = live[end], piece[end]
                score = best[i, r] + self.score[p]
                better = score > best[j + 1, r]
                r2 = r[better]
                best[j + 1, r2], back_at[j + 1, r2], back_piece[j + 1, r2] = score[better], i, p[better]
                single[r] |= widths[r, i] == j + 1 - i
            alone = ~single[rows]
            r, to = rows[alone], i + width[alone]
            better = best[i, r] + self.unknown_score > best[to, r]
            r, to = r[better], to[better]
            best[to, r], back_at[to, r], back_piece[to, r] = best[i, r] + self.unknown_score, i, -1
        out = []
        for k in range(m):
            spans, at = [], n
            while at:
                spans.append((int(back_at[at, k]), at, int(back_piece[at, k])))
                at = spans[-1][0]
            out.append(self._ids(spans[::-1], raw[k]))
        return out

    def learn(self, chunks: set[bytes]) -> None:
        """Segments chunks that aren't kept yet; when a generation is full, the one before it goes, so that frequent chunks stay."""
        if len(self.kept) + len(chunks) > KEPT:
            self.before, self.kept = self.kept, {}
        new = chunks - self.kept.keys()
        known = new & self.before.keys()
        self.kept.update((c, self.before[c]) for c in known)
        new -= known
        by_length: dict[int, list[tuple[bytes, bytes]]] = {}
        for c in sorted(new):
            marked = c.replace(b" ", MARK)
            if len(marked) > LONG:
                self.kept[c] = self._alone(marked)
            else:
                by_length.setdefault(len(marked), []).append((c, marked))
        for same in by_length.values():
            self.kept.update(zip((c for c, _ in same), self._together([m for _, m in same]), strict=True))

    def encode(self, many: list[bytes]) -> list[np.ndarray]:
        parts = [self.chunks(t) for t in many]
        self.learn(set().union(*parts))
        return [np.frombuffer(b"".join(map(self.kept.__getitem__, p)), np.int32) for p in parts]

    def decode(self, ids) -> bytes:
        """Text of ids: markers become spaces, the first of them goes if the model adds one, bytes are joined as they stand."""
        out = b"".join(map(self.text.__getitem__, ids))
        return out[1:] if self.pieces.prefix and out[:1] == b" " else out


def _encode(sent):
    def run(batches):
        segmenter = sent.value  # one for each worker, with what it has learned
        is_byte = np.array([k == BYTE for k in segmenter.pieces.kind])
        for rows, data, offsets in blocks(batches):
            whole = texts(data, offsets)
            ids = segmenter.encode(whole)
            flat = np.concatenate([np.zeros(0, np.int32), *ids])
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            fallback = np.concatenate(([0], np.cumsum(is_byte[flat])))
            same = [segmenter.decode(i.tolist()) == t for i, t in zip(ids, whole, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends).astype(np.int64)),
                    pa.array(fallback[ends[1:]] - fallback[ends[:-1]], pa.int64()), pa.array(same, pa.bool_())
                ],
                ["doc_id", "ids", "n_tokens", "n_bytes_fallback", "round_trip"],
            )

    return run


def sentencepiece_encode(docs: DataFrame, model_path: str) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, ids, n_tokens, n_bytes_fallback, round_trip), one row for each row.

    ids are the pieces of the best segmentation without begin and end pieces (the longest last piece wins ties); round_trip tells whether
    decoding gives the text's bytes again, which fails only for texts that hold the marker U+2581 itself or that the model normalizes. Null and empty texts
    have no ids; long texts are encoded whole; repeated rows come back as often as they stand there; an empty table gives an empty result. Other columns are ignored. The model file is read by the driver and sent to the tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Segmenter(Pieces(model_path)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _encode(sent), "doc_id long, ids array<int>, n_tokens long, n_bytes_fallback long, round_trip boolean"
    )


def sentencepiece_decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """encoded(doc_id, ids, ...) -> (doc_id, text); ids outside the model or null raise, null lists give empty texts; broken UTF-8 becomes U+FFFD."""
    sent = encoded.sparkSession.sparkContext.broadcast(Segmenter(Pieces(model_path)))

    def run(batches):
        segmenter = sent.value
        for rows in batches:
            text = [segmenter.decode(i or ()).decode("utf-8", "replace") for i in rows.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
