"""Suffix-array dedup: finds and removes every byte that a repeated long string covers.

An array with an entry for each suffix of the corpus would be larger than any budget of disk, so the arrays are sparse: of each window of `length` bytes
the position whose `GRAM`-byte gram has the least hash (the first, in a tie) is an anchor, and only suffixes that start at anchors are entries. The
choice depends on the window's bytes alone, so both occurrences of any repeated string of `length` bytes hold the same anchor at the same place;
nothing is lost by leaving out the other suffixes. An entry is (k1, k2, gram, context, n): the suffix's first 16 bytes as two numbers that sort
like the bytes, a hash of its first GRAM bytes, a hash of all bytes of the windows that chose this anchor, and how often that was seen.

`SuffixLevels` is the logarithmic family. An array is sharded by gram; each shard stands in suffix order. A new batch becomes an array; where a level of
its size exists, the two are merged by one scan of their common order into one twice as large, and so on (all at once, so only the largest is written),
and an entry is rewritten a logarithmic number of times. `matches` scans a new batch against the levels, `repeats` all levels together. Matches
follow from neighbours in the merged order:

* a context seen twice: all its windows repeat;
* a gram with several contexts: its windows are compared one by one, by hashes of their whole `length` bytes, inside the gram's group. Groups of more
  than `GROUP` contexts don't go to one task. A window has half of its room left or right of the gram, so contexts that share none of these two
  neighbourhoods with another share no window; the windows of those that do become rows, which are counted;
* anything else is unique.

Which grams repeat reaches the scan of the texts as a bitmap, sized by their number up to `BITMAP` bits; a false positive there only adds work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashes, blocks, discard, materialize, mixed, signed, small, texts

GRAM = 48
#: Text bytes whose anchors are found at once: a worker holds ten arrays of eight bytes for each, and these fit the processor's cache.
BLOCK_BYTES = 1 << 17
#: Bits of a bitmap of repeated grams: so many for each gram, and at most 64 MB.
BITS_EACH, BITMAP = 16, 1 << 29
#: Distinct contexts of one gram that a task compares.
GROUP = 1_000
#: Contexts that a worker remembers to have sent with their bytes; beyond it forgets them and sends some again.
SENT = 50_000
ENTRY = "k1 long, k2 long, gram long, context long, n long"
REPEAT = "gram long, context long, n long, several boolean"


def sliding_least(a: np.ndarray, width: int) -> np.ndarray:
    out, done = a, 1
    while done < width:
        step = min(done, width - done)
        out, done = np.minimum(out[:-step], out[step:]), done + step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of a block of texts: (row, first window, number of windows, anchor's place after the first window, gram, context); windows by place in the text."""
    pieces = []
    for lo in range(0, max(len(data) - length + 1, 0), 4 * BLOCK_BYTES):  # a longer text goes in pieces; an anchor at a cut gives two entries
        part = data[lo : lo + 4 * BLOCK_BYTES + length - 1]
        h = Hashes(part)
        gram = mixed(h.fixed(GRAM))
        low = np.uint64(0xFFFFFF)
        least = sliding_least((gram & ~low) | np.arange(len(gram), dtype=np.uint64), length - GRAM + 1)
        place = (least & low).astype(np.int64)  # of the anchor of each window
        start = np.arange(len(place))
        row = np.searchsorted(offsets, start + lo, "right") - 1
        inside = start + lo + length <= offsets[row + 1]
        start, place, row = start[inside], place[inside], row[inside]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        s1, s2, at = start[first], start[last], place[first]
        shape = ((at - s1) << 16 | (s2 - s1)).astype(np.uint64)
        context = mixed(h(s1, s2 + length) ^ mixed(shape))
        pieces.append((row[first], s1 + lo - offsets[row[first]], s2 - s1 + 1, at - s1, gram[at], context))
    return tuple(map(np.concatenate, zip(*pieces, strict=True))) if pieces else tuple(np.zeros(0, k) for k in (np.int64,) * 4 + (np.uint64,) * 2)


def in_suffix_order(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 16 bytes at each place as two signed numbers that sort like the bytes."""
    words = data[start[:, None] + np.arange(16)].view(">u8").astype(np.uint64) if len(start) else np.zeros((0, 2), np.uint64)
    return tuple(signed(words[:, k] ^ np.uint64(1 << 63)) for k in (0, 1))


def _entries(length: int):
    def run(batches):
        for _, data, offsets in blocks(batches, limit=BLOCK_BYTES):
            row, s1, _, at, gram, context = anchors(data, offsets, length)
            k1, k2 = in_suffix_order(data, offsets[row] + s1 + at)
            order = np.lexsort((context, gram))
            gram, context = gram[order], context[order]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(gram)))
            columns = [k1[order][first], k2[order][first], signed(gram[first]), signed(context[first]), n]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k1", "k2", "gram", "context", "n"])

    return run


def _merge_scan(batches):
    """Entries in suffix order -> equal ones as one, their numbers added up."""
    names, held = ["k1", "k2", "gram", "context", "n"], None
    for b in batches:
        if not b.num_rows:
            continue
        now = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
        now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        new = np.ones(len(now[0]), bool)
        new[1:] = (now[2][1:] != now[2][:-1]) | (now[3][1:] != now[3][:-1])
        first = np.flatnonzero(new)
        out = [*(c[first] for c in now[:4]), np.add.reduceat(now[4], first)]
        held = [c[-1:] for c in out]  # more of it may follow
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1]) for c in out], names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names)


def _repeat_scan(batches):
    """Merged entries in suffix order -> (gram, context, n, several) of those whose gram has another context or that were seen twice."""
    held = None  # the last entry, and whether the one before has its gram
    empty = np.zeros(0, np.int64)

    def out(gram, context, n, several):
        kept = several | (n > 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(gram[kept]), pa.array(context[kept]), pa.array(n[kept]), pa.array(several[kept])], ["gram", "context", "n", "several"]
        )

    for b in batches:
        if not b.num_rows:
            continue
        now = [b.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "context", "n")]
        gram, context, n = now if held is None else [np.concatenate(x) for x in zip(held[:3], now, strict=True)]
        same = gram[1:] == gram[:-1]
        several = np.append(held is not None and held[3], same)
        several[:-1] |= same
        yield out(gram[:-1], context[:-1], n[:-1], several[:-1])
        held = (gram[-1:], context[-1:], n[-1:], bool(several[-1]))
    yield out(*held[:3], np.array([held[3]])) if held is not None else out(empty, empty, empty, np.zeros(0, bool))


def _merge_and_repeat_scan(batches):
    """Both scans in one worker."""
    return _repeat_scan(_merge_scan(batches))


class SuffixLevels:
    """Sparse suffix arrays of batches; levels of equal size are merged as they come."""

    def __init__(self, length: int):
        self.length, self.levels = length, []

    def entries(self, batch: DataFrame) -> DataFrame:
        """batch(text, ...) -> its entries, in no order."""
        return batch.select("text").mapInArrow(_entries(self.length), ENTRY)

    def array(self, batch: DataFrame) -> DataFrame:
        """batch(text, ...) -> its entries, sharded by gram, each shard in suffix order."""
        return self._merged([self.entries(batch)])

    def _in_order(self, dfs: list[DataFrame]) -> DataFrame:
        df = _union(dfs)
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(n, "gram").sortWithinPartitions("k1", "k2", "gram", "context")

    def _merged(self, dfs: list[DataFrame]) -> DataFrame:
        return self._in_order(dfs).mapInArrow(_merge_scan, ENTRY)

    def add(self, batch: DataFrame) -> None:
        """The batch's entries join the family; equal levels merge until sizes differ. A batch that merges at once is not written by itself before."""
        size, old = 1, []
        while self.levels and self.levels[-1][0] == size:
            old.append(self.levels.pop()[1])
            size *= 2
        self.levels.append((size, materialize(self._merged([self.entries(batch), *old]), "suffix-level")))
        for df in old:
            discard(df)

    def repeats(self) -> DataFrame:
        """(gram, context, n, several) of entries of all levels whose gram has several contexts or that were seen twice."""
        return self._in_order([df for _, df in self.levels]).mapInArrow(_merge_and_repeat_scan, REPEAT)

    def matches(self, batch: DataFrame) -> DataFrame:
        """The same of the entries of a new batch and all levels: what add(batch) would make repeat, without adding it."""
        return self._in_order([self.entries(batch), *(df for _, df in self.levels)]).mapInArrow(_merge_and_repeat_scan, REPEAT)

    def drop(self) -> None:
        for _, df in self.levels:
            discard(df)


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.union(df)
    return out


def bitmap(grams: DataFrame) -> np.ndarray:
    """A set of grams as a power of two of bits, BITS_EACH for each of them, BITMAP at most."""
    n = grams.count()
    size = max(64, min(BITMAP, 1 << (n * BITS_EACH).bit_length()))
    bit = F.pmod("gram", F.lit(size))
    words = grams.select((bit / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(gram, 64) as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # BITMAP / 64 rows at most
    out = np.zeros(size // 64, np.uint64)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def has(bits: np.ndarray, gram: np.ndarray) -> np.ndarray:
    at = gram % np.uint64(64 * len(bits))  # a power of two: the same for signed numbers
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _places(length: int, repeated, several):
    """Texts -> places of anchors whose gram repeats; the first of each context in a task also carries its bytes if the gram has several contexts."""

    def run(batches):
        sent: set[int] = set()
        for rows, data, offsets in blocks(batches, limit=BLOCK_BYTES):
            row, s1, n, at, gram, context = anchors(data, offsets, length)
            kept = has(repeated.value, gram)
            row, s1, n, at, gram, context = (x[kept] for x in (row, s1, n, at, gram, context))
            carries = has(several.value, gram)
            first = np.zeros(len(gram), bool)
            first[np.unique(context, return_index=True)[1]] = True
            carries &= first
            at_first = np.flatnonzero(carries)
            carried = context[at_first].tolist()
            carries[at_first[[c in sent for c in carried]]] = False
            sent.update(carried)
            if len(sent) > SENT:
                sent.clear()
            begin = offsets[row] + s1
            held = [data[b : b + k + length - 1].tobytes() if c else None for b, k, c in zip(begin.tolist(), n.tolist(), carries.tolist(), strict=True)]
            doc, mark = (rows.column(c).take(pa.array(row)) for c in ("doc_id", "mark"))
            yield pa.RecordBatch.from_arrays(
                [doc, mark, pa.array(s1), pa.array(n), pa.array(at), pa.array(signed(gram)), pa.array(signed(context)), pa.array(held, pa.binary())],
                ["doc_id", "mark", "start", "windows", "anchor", "gram", "context", "bytes"],
            )

    return run


def _prints(length: int, n: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts with n windows each: owner, number and hash of each window."""
    begin = np.concatenate(([0], np.cumsum([len(b) for b in data])))
    h = Hashes(np.frombuffer(b"".join(data), np.uint8))
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(owner)) - np.concatenate(([0], np.cumsum(n)))[:-1][owner]
    start = begin[:-1][owner] + at
    return owner, at, mixed(h(start, start + length))


def _stretches(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of consecutive windows of one owner."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    a = np.flatnonzero(new)
    return a, (np.append(a[1:], len(owner)) - 1)[: len(a)]


VERDICT = "gram long, context long, lo long, hi long"


def _verdicts(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["gram", "context", "lo", "hi"])


def _compare(length: int):
    """Contexts sorted by (gram, context) -> for each the runs of windows that another context of its gram has too."""

    def solve(gram, context, n, data):
        owner, at, print_ = _prints(length, np.array(n), data)
        _, inverse, count = np.unique(print_, return_inverse=True, return_counts=True)
        hit = count[inverse] > 1
        owner, at = owner[hit], at[hit]
        a, b = _stretches(owner, at)
        return np.full(len(a), gram), np.array(context, np.int64)[owner[a]], at[a], at[b] + length

    def run(batches):
        now, held, out, rows = None, ([], [], []), [], 0
        for b in batches:
            for key, *row in zip(*(b.column(k).to_pylist() for k in ("gram", "context", "windows", "bytes")), strict=True):
                if key != now:
                    if len(held[0]) > 1:
                        out.append(solve(now, *held))
                        rows += len(out[-1][0])
                    now, held = key, ([], [], [])
                    if rows > 50_000:
                        yield _verdicts(map(np.concatenate, zip(*out, strict=True)))
                        out, rows = [], 0
                if not held[0] or held[0][-1] != row[0]:
                    for x, value in zip(held, row, strict=True):
                        x.append(value)
        if len(held[0]) > 1:
            out.append(solve(now, *held))
        yield _verdicts(map(np.concatenate, zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4)

    return run


def _sides(length: int):
    """Contexts -> a row for each neighbourhood of the gram, half a window's room to its left or right, that a window can have."""
    room = (length - GRAM) // 2

    def run(batches):
        for b in batches:
            gram, context, n, at, data = (b.column(k).to_pylist() for k in ("gram", "context", "windows", "anchor", "bytes"))
            out = []
            for g, c, k, a, text in zip(gram, context, n, at, data, strict=True):
                if a >= room:
                    out.append((g, c, text[a - room : a], 0))
                if k - 1 > a - room - 1 and a + GRAM + room <= len(text):
                    out.append((g, c, text[a + GRAM : a + GRAM + room], 1))
            columns = [
                pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary()),
                pa.array([o[3] for o in out], pa.int32())
            ]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "context", "beside", "side"])

    return run


def _windows(length: int):
    """Contexts -> a row for each of their windows."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                gram, context, n, data = (b.column(k).slice(lo, 1000).to_pylist() for k in ("gram", "context", "windows", "bytes"))
                owner, at, print_ = _prints(length, np.array(n, np.int64), data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(gram, np.int64)[owner]), pa.array(np.array(context, np.int64)[owner]), pa.array(at), pa.array(signed(print_))],
                    ["gram", "context", "at", "print"]
                )

    return run


def _runs(length: int):
    """(gram, context, places of windows) -> verdicts."""

    def run(batches):
        for b in batches:
            gram, context, places = (b.column(k).to_pylist() for k in ("gram", "context", "places"))
            owner = np.repeat(np.arange(len(places)), [len(p) for p in places])
            at = np.array([x for p in places for x in sorted(p)], np.int64)
            a, z = _stretches(owner, at)
            yield _verdicts((np.array(gram, np.int64)[owner[a]], np.array(context, np.int64)[owner[a]], at[a], at[z] + length))

    return run


def _counted(held: DataFrame, length: int) -> DataFrame:
    """Verdicts on contexts of grams that have too many for one task: neighbourhoods and then windows as rows, counted by tasks that add up first."""
    one = materialize(held.groupBy("gram", "context").agg(*(F.first(c).alias(c) for c in ("windows", "anchor", "bytes"))), "suffix-contexts")
    beside = one.mapInArrow(
        _sides(length), "gram long, context long, beside binary, side int"
    ).select("gram", "context", "side", F.xxhash64("beside").alias("beside"))
    beside = materialize(beside, "suffix-beside")
    shared = materialize(
        beside.groupBy("gram", "side", "beside").agg(F.count("*").alias("n")).where("n > 1").select("gram", "side", "beside"), "suffix-shared"
    )
    near = beside.join(small(shared), ["gram", "side", "beside"]).select("gram", "context").distinct()
    each = materialize(
        one.join(near, ["gram", "context"], "left_semi").mapInArrow(_windows(length), "gram long, context long, at long, print long"),
        "suffix-windows"
    )
    for df in (one, beside, shared):
        discard(df)
    twice = materialize(each.groupBy("gram", "print").agg(F.count("*").alias("n")).where("n > 1").select("gram", "print"), "suffix-twice")
    hits = each.join(small(twice), ["gram", "print"]).groupBy("gram", "context").agg(F.collect_set("at").alias("places"))  # of one context's windows
    return hits.mapInArrow(_runs(length), VERDICT)


def _cut(batches):
    for rows, data, offsets in blocks(batches):
        whole = texts(data, offsets)
        sizes, flat, counts, kept = [], [], [], []
        for text, found in zip(whole, rows.column("found").to_pylist(), strict=True):
            spans = sorted((r["a"], r["b"]) for r in found or ())
            joined: list[list[int]] = []
            for a, b in spans:
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            sizes.append(len(text))
            flat += [x for s in joined for x in s]
            counts.append(len(joined))
            kept.append(b"".join(text[a:b] for a, b in zip([0, *(s[1] for s in joined)], [*(s[0] for s in joined), len(text)], strict=True)))
        ends = np.array(flat, np.int64).reshape(-1, 2)
        offsets32 = np.zeros(len(counts) + 1, np.int32)
        np.cumsum(counts, out=offsets32[1:])
        spans = pa.ListArray.from_arrays(pa.array(offsets32), pa.StructArray.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["start", "stop"]))
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(sizes, pa.int64()), spans, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"]
        )


def suffix_dedup(docs: DataFrame, length: int = 200, batches: int = 4) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_bytes, spans, kept): one row for each row, with repeats.

    spans are the maximal runs of UTF-8 bytes covered by strings of `length` bytes that start anywhere else too, the same text
    included; kept are the other bytes in their order. Overlapping occurrences count; matches don't cross texts. Null and empty texts
    have no bytes and no spans; texts shorter than `length` keep all; a long text is cut into pieces that overlap. Rows may repeat: each then covers the
    other. A row without doc_id counts like any other. Of equal gram hashes in a window the first is the anchor, which changes no result. An empty table
    gives an empty result. Other columns are ignored.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings must have {2 * GRAM} bytes or more")
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    levels = SuffixLevels(length)
    for k in range(batches):
        levels.add(docs.where(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(batches)) == k))
    repeats = materialize(levels.repeats(), "suffix-repeats")
    levels.drop()
    bits = [spark.sparkContext.broadcast(bitmap(x)) for x in (repeats.select("gram").distinct(), repeats.where("several").select("gram").distinct())]
    places = materialize(
        docs.mapInArrow(_places(length, *bits), "doc_id long, mark long, start long, windows long, anchor long, gram long, context long, bytes binary"),
        "suffix-places"
    )

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = places.where("bytes is not null").select("gram", "context", "windows", "anchor", "bytes")
    crowded = materialize(repeats.where("several").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("gram"), "suffix-crowded")
    few = held.join(small(crowded), "gram", "left_anti")
    parts = [few.repartition(n, "gram").sortWithinPartitions("gram", "context").mapInArrow(_compare(length), VERDICT)]
    if not crowded.isEmpty():
        parts.append(_counted(held.join(small(crowded), "gram", "left_semi"), length))
    full = repeats.where("n > 1").select("gram", "context", F.lit(0).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi"))
    verdicts = materialize(_union([full, *parts]), "suffix-verdicts")
    discard(crowded)
    discard(repeats)
    stop = F.when(F.col("hi") < 0, F.col("windows") + length - 1).otherwise(F.col("hi"))
    spans = places.select("doc_id", "mark", "start", "windows", "gram", "context").join(verdicts, ["gram", "context"])
    spans = spans.select(
        F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "mark",
        F.struct((F.col("start") + F.col("lo")).alias("a"), (F.col("start") + stop).alias("b")).alias("s")
    )
    found = spans.groupBy("id", "no_id", "mark").agg(F.collect_set("s").alias("found"))
    keyed = docs.select("doc_id", "text", "mark", F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("no_id"))
    whole = keyed.join(found, ["id", "no_id", "mark"], "left").select("doc_id", "text", "found")
    return whole.mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
