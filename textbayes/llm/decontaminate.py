"""Benchmark decontamination: which words of a document lie inside an occurrence of a benchmark window.

A set join with prefix filtering at containment 1: a window of an item must occur whole, so one token is prefix enough. The tokens of
a window are ordered by rarity, counted over all documents, and the window is filed under its rarest. A document's words fetch the
shapes (place of the rarest word, window length) filed under them; the place gives the only start that is possible and the length the only
stop (position and length bounds). The words there are hashed, looked up, and compared word by word with the window.

Nothing that tasks hold grows with the corpus, and what grows with the benchmark has a bound that is checked: rarity and shapes are tables
of SLOTS entries, whatever the benchmark; up to HELD_BYTES of benchmark text the windows themselves are sent to the tasks, and
documents are judged in one pass; of a larger benchmark only a filter of FILTER_BITS at most is sent, and what passes it joins
the windows in a shuffle on (hash, length), with the compared words on both sides. Each document's text is read by one stage either way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BlockWords, blocks, fresh, materialize, mixed, signed, small

#: Entries of the tables of rarity and shapes, by a word's hash: a shared entry only adds work.
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: Bytes of benchmark text up to which windows are sent to tasks (some ten times as much memory).
HELD_BYTES = 4 << 20
#: Bits of the filter for each window of a larger benchmark, and bits at most (32 MB).
FILTER_EACH, FILTER_BITS = 16, 1 << 28

#: Words are runs of 0-9, a-z and all beyond ASCII; A-Z are lowered before.
WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


_LOW = np.frombuffer(WORDS, np.uint8)


class Words(BlockWords):
    """The words of a block of texts, by the slots of their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets, _LOW)

    def slots(self) -> np.ndarray:
        return (self.hash >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def prints(self, start: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(start), n, np.uint64)
        for i in range(n):
            h = mixed(h + self.hash[start + i])
        return h

    def text(self, start: int, n: int) -> bytes:
        return b" ".join(self.low[self.begin[start] : self.end[start + n - 1]].tobytes().split())


def _slots(batches):
    """Texts -> the distinct slots of their words."""
    seen = np.zeros(SLOTS, bool)
    for _, data, offsets in blocks(batches):
        seen[Words(data, offsets).slots()] = True
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32))], ["slot"])


def _counts(asked):
    """Texts -> how often words of the asked slots occur, added up by the task."""

    def run(batches):
        known, counts = asked.value, np.zeros(SLOTS, np.int64)
        for _, data, offsets in blocks(batches):
            got = Words(data, offsets).slots()
            counts += np.bincount(got[known[got]], minlength=SLOTS)
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(counts[slot])], ["slot", "n"])

    return run


def windows_of(words: Words, rarity: np.ndarray, size: int) -> list[tuple[np.ndarray, ...]]:
    """For each length: (text, start, length, place of the rarest word, its slot, hash) of all windows; a shorter text is one window."""
    slots, out = words.slots(), []
    count = rarity[slots]
    have = np.diff(words.first)
    for n in np.unique(np.minimum(have, size)).tolist():
        if n:
            of = np.flatnonzero(np.minimum(have, size) == n)
            each = have[of] - n + 1
            start = np.repeat(words.first[of], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            place = np.argmin(count[start[:, None] + np.arange(n)[None, :]], axis=1)  # the first of the rarest
            out.append((np.repeat(of, each), start, np.full(len(start), n), place, slots[start + place], words.prints(start, n)))
    return out


def _windows(rarity, size: int):
    """Items -> a row for each distinct window of an item: its shape, the slot and hash it is found by, and its words."""

    def run(batches):
        for rows, data, offsets in blocks(batches):
            words = Words(data, offsets)
            found = windows_of(words, rarity.value, size)
            text, start, n, place, slot, print_ = map(
                np.concatenate, zip(*found, strict=True)
            ) if found else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, np.uint64)]
            held = [words.text(s, k) for s, k in zip(start.tolist(), n.tolist(), strict=True)]
            item = rows.column("item_id").take(pa.array(text))
            kinds = [pa.array(x.astype(np.int32)) for x in (n, place, slot)]
            yield pa.RecordBatch.from_arrays(
                [item, *kinds, pa.array(signed(print_)), pa.array(held, pa.binary())], ["item_id", "length", "place", "slot", "print", "words"]
            )

    return run


class Shapes:
    """slot -> the shapes (length, place) of windows filed there, as numbers of a short list of all shapes."""

    def __init__(self, rows: pa.Table):
        length, place, slot = (rows[c].to_numpy() for c in ("length", "place", "slot"))
        self.all = sorted(set(zip(length.tolist(), place.tolist(), strict=True)))
        self.any, self.marked = np.zeros(SLOTS, bool), []
        for n, p in self.all:
            there = np.zeros(SLOTS, bool)
            there[slot[(length == n) & (place == p)]] = True
            self.marked.append(there)
            self.any |= there

    def candidates(self, words: Words):
        """(length, starts) by shape: the starts at which a window can stand."""
        slots = words.slots()
        marked = np.flatnonzero(self.any[slots])
        slots = slots[marked]
        for (n, place), bits in zip(self.all, self.marked, strict=True):
            at = marked[bits[slots]]
            start = at - place
            owner = words.owner(at)
            inside = (start >= words.first[owner]) & (start + n <= words.first[owner + 1])
            if inside.any():
                yield n, start[inside]


class Filter:
    """A set of hashes as bits: what it lacks is not in the set."""

    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(bits // 64, np.uint64)

    def has(self, print_: np.ndarray) -> np.ndarray:
        at = print_ % np.uint64(self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _filter(windows: DataFrame, n: int) -> Filter:
    """At most FILTER_BITS / 64 rows reach the driver."""
    out = Filter(max(64, min(FILTER_BITS, 1 << (n * FILTER_EACH).bit_length())))
    at = F.pmod("print", F.lit(out.bits))  # a power of two: the same for signed numbers
    got = windows.select(
        (at / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(print, 64) as int))").alias("b")
    ).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out.words[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


class Held:
    """The windows of a benchmark of bounded size: sorted by hash, with their words and items."""

    def __init__(self, table: pa.Table):
        print_ = np.asarray(table["print"].to_numpy()).view(np.uint64)
        order = np.argsort(print_, kind="stable")
        self.prints = print_[order]
        self.words, self.items = table["words"].take(pa.array(order)).combine_chunks(), table["item_id"].take(pa.array(order)).combine_chunks()

    def find(self, print_: int, words: bytes) -> list[str]:
        a, b = np.searchsorted(self.prints, np.uint64(print_), "left"), np.searchsorted(self.prints, np.uint64(print_), "right")
        return [self.items[i].as_py() for i in range(a, b) if self.words[i].as_py() == words]


def merged(spans) -> list[dict]:
    """Ranges of words, those that touch or overlap joined."""
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], b)
        else:
            out.append({"start": a, "stop": b})
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _rest(rows: pa.RecordBatch) -> tuple[list[pa.Array], list[str]]:
    """The columns but the text."""
    names = [n for n in rows.schema.names if n != "text"]
    return [rows.column(n) for n in names], names


def _judge(shapes, held):
    """Texts -> their words, hits and items, with the windows at hand; other columns stay."""

    def run(batches):
        known, found = {}, held.value
        for rows, data, offsets in blocks(batches):
            words = Words(data, offsets)
            spans, items = {}, {}
            for n, start in shapes.value.candidates(words):
                print_ = words.prints(start, n)
                near = np.minimum(np.searchsorted(found.prints, print_), len(found.prints) - 1)
                for s, p, owner in zip(*(x[found.prints[near] == print_].tolist() for x in (start, print_, words.owner(start))), strict=True):
                    key = (p, words.text(s, n))
                    if key not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[key] = found.find(*key)
                    if known[key]:
                        a = s - int(words.first[owner])
                        spans.setdefault(owner, set()).add((a, a + n))
                        items.setdefault(owner, set()).update(known[key])
            count = np.diff(words.first)
            kept, names = _rest(rows)
            hits = pa.array([merged(spans.get(i, ())) for i in range(len(count))], SPANS)
            leaked = pa.array([sorted(items.get(i, ())) for i in range(len(count))], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(count), hits, leaked], [*names, "n_words", "hits", "items"])

    return run


def _ask(shapes, filter_):
    """Texts -> their words and the windows that may stand in them; other columns stay."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int32()), ("print", pa.int64()), ("words", pa.binary())]))

    def run(batches):
        for rows, data, offsets in blocks(batches):
            words = Words(data, offsets)
            asked: dict = {}
            for n, start in shapes.value.candidates(words):
                print_ = words.prints(start, n)
                there = filter_.value.has(print_)
                for s, p, owner in zip(start[there].tolist(), signed(print_[there]).tolist(), words.owner(start[there]).tolist(), strict=True):
                    asked.setdefault(owner, []).append({"start": s - int(words.first[owner]), "length": n, "print": p, "words": words.text(s, n)})
            count = np.diff(words.first)
            kept, names = _rest(rows)
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(count), pa.array([asked.get(i, []) for i in range(len(count))], kind)], [*names, "n_words", "asked"]
            )

    return run


def _merge(batches):
    """spans -> hits, their runs; other columns stay."""
    for rows in batches:
        hits = pa.array([merged((x["start"], x["stop"]) for x in s or ()) for s in rows.column("spans").to_pylist()], SPANS)
        names = [n for n in rows.schema.names if n not in ("spans", "items")]
        yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), hits, rows.column("items")], [*names, "hits", "items"])


def _found(docs: DataFrame, windows: DataFrame, n: int, shapes, schema: str) -> DataFrame:
    """As _judge, with a shuffle of the windows that pass the filter; of a document only what is asked is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(_filter(windows, n))
    asked = docs.mapInArrow(_ask(shapes, sent), f"{schema}, n_words long, asked array<struct<start:long,length:int,print:long,words:binary>>")
    rows = materialize(asked.withColumn("row", F.monotonically_increasing_id()), "decontamination-asked")
    each = rows.select("row", F.explode("asked").alias("a")).select("row", "a.start", "a.length", "a.print", "a.words")
    hits = each.join(windows.select("length", "print", "words", "item_id"), ["length", "print", "words"])
    spans = hits.groupBy("row").agg(
        F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop"))).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("leaked")
    )
    none = F.expr("cast(array() as array<string>)")
    joined = rows.drop("asked").join(spans, "row", "left").withColumn("items", F.coalesce("leaked", none)).drop("row", "leaked")
    return joined.mapInArrow(_merge, f"{schema}, n_words long, hits array<struct<start:long,stop:long>>, items array<string>")


def matched(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """docs(..., text) with n_words, hits and items instead of the text."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").dropna()
    asked = np.zeros(SLOTS, bool)
    asked[items.select("text").mapInArrow(_slots, "slot int").distinct().toArrow()["slot"].to_numpy()] = True  # SLOTS bounds what comes
    rarity = np.zeros(SLOTS, np.int64)
    counted = docs.select("text").mapInArrow(_counts(send(asked)), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    rarity[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    windows = items.mapInArrow(_windows(send(rarity), size), "item_id string, length int, place int, slot int, print long, words binary")
    windows = materialize(windows.dropDuplicates(["item_id", "length", "print", "words"]), "benchmark-windows")
    shapes = send(Shapes(windows.select("length", "place", "slot").distinct().toArrow()))  # at most size * (size + 1) / 2 a slot
    weight = windows.agg(F.count("*").alias("n"), F.sum(F.octet_length("words") + F.octet_length("item_id")).alias("bytes")).first()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    if (weight.bytes or 0) <= size * HELD_BYTES:
        held = send(Held(windows.select("print", "words", "item_id").toArrow()))
        return docs.mapInArrow(_judge(shapes, held), f"{schema}, n_words long, hits array<struct<start:long,stop:long>>, items array<string>")
    return _found(docs, windows, weight.n, shapes, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text, ...) -> (doc_id, n_words, n_hit, hits, items, contaminated), one row for each row.

    hits are the runs of words covered by occurrences of windows (by number of the word), items the ids, as strings and sorted so, of
    items with such windows; a document is contaminated if hits are at least one in `share` of its words. Null and empty texts have no
    words; a long text is taken whole. Repeated rows come back as often as they stand there. Items without id, text or words are ignored;
    items that repeat an id count once, with the windows of all their texts. An empty table of documents gives an empty result, an empty benchmark no hits. Of a
    window's equally rare words the first files it, which changes no result. Other columns are ignored.
    """
    out = matched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, size)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    out = out.select("doc_id", "n_words", n_hit.alias("n_hit"), "hits", "items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """docs without those that hold a benchmark window anywhere, however long they are; all columns stay.

    A row goes only if its own text holds one, so rows that share a doc_id are judged apart. Null and empty texts stay, as do all rows if the
    benchmark or the table is empty; repeated rows go or stay together.
    """
    mark, length = fresh(docs, "mark"), fresh(docs, "length")
    key = {mark: F.xxhash64("text"), length: F.octet_length("text")}
    found = matched(docs.select("doc_id", *(c.alias(k) for k, c in key.items()), "text"), benchmark, size)
    gone = materialize(
        found.where(F.size("hits") > 0).select(F.col("doc_id").alias("of"), F.col(mark).alias("m"), F.col(length).alias("n")).distinct(),
        "contaminated"
    )
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col(mark) == F.col("m")) & (F.col(length) == F.col("n"))
    return docs.withColumns(key).join(small(gone), same, "left_anti").drop(*key)
