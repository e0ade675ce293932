"""N-gram Jaccard join: exact links between documents by their sets of word shingles, and the classes these links form.

The overlap counts come from a sparse product of the document by shingle incidence matrix with its transpose, computed in
blocks. Which rows meet in a block follows from size-derived bounds alone. For a set of n shingles and a threshold t, a partner shares at
least t * n of them, so:

* Of any fraction of the shingles at most (1 - t) * n may be without a second owner. The shingles with one of three residues are counted
  first; most documents fail here and are done.
* With the shingles of the others in one order for all, rarest first, two partners share a shingle among the first
  n - ceil(t * n) + 1 of each. Shingles with one owner fill most of these places, so common passages hardly ever matter.

Documents that share such a shingle are joined to the least of its owners (a star, never all pairs); the components of these stars are
the blocks. A block of more than `BLOCK_ROWS` rows or `BLOCK_SHINGLES` shingles is dealt into parts that each also hold the block's
centre. A part finds its classes; a group of near copies is one class after that. What is left to do in a block of several parts are links between
classes: the rows outside of the largest class are compared, as queries, with all rows, part by part. A block with more than `QUERY_PARTS` parts of queries may
be one that a chain of shingles holds together; where that sends less, the same is done among the owners of each shingle whose owners are of several
classes instead, so that unlike texts don't meet. Either way every pair that the bounds allow is counted or joins two rows already known to be of one class: no link between
classes is lost.

A product is computed in tiles of rows sorted by size; tiles whose sizes are too far apart, or whose rows are of one class already, are left
out. Shingles that few rows of a tile have are added up pair by pair, those that many have as a dense product, a bounded number at a time, and of a tile only
the pairs that reach the threshold are kept.

Postings travel packed, many to a row, in as many buckets as the counted shingles ask for, and each task first combines what it has: of a shingle that several of
its documents own only one posting goes on, and shingles that a large share of some task's documents own (a table of bounded size) are put last in the
order without being counted, so a very common shingle doesn't fill one task.

Sets are held as 64-bit hashes of shingles; equal sets are collapsed by a 128-bit fingerprint before anything is compared. Candidates are found by half of
it, so among 10**10 documents a few pairs of unlike sets may share an identity while candidates are sought.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BlockWords, blocks, discard, fresh, materialize, mixed, runs, signed, small
from .components import components

#: Rows and shingles of a block that one task takes at once; larger blocks are dealt into parts.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 400_000
#: Parts of queries up to which a block is compared as a whole; beyond that the owners of each of its shingles are, where that is less.
QUERY_PARTS = 4
#: Rows of a tile, columns of the incidence matrix that are dense at once, and pairs of owners that are added up at once.
TILE, COLUMNS, PAIRS = 256, 4096, 1 << 18
#: Counted shingles in a bucket (16 bytes each), which a task holds; a task takes several buckets, one after the other, where there are more than PARTITIONS.
BUCKET, PARTITIONS = 500_000, 20_000

# of bytes: only A-Z are lowered, and exactly \x20 and \x09-\x0D separate words
_LOWER = np.array([0x20 if b == 0x20 or 9 <= b <= 13 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text of a block: `size` words, or the whole sequence of a shorter text; empty without words."""
    words = BlockWords(data, offsets, _LOWER)
    have = np.diff(words.first)
    h = {}
    for n in {size, *np.unique(have[have < size]).tolist()} - {0}:
        x = np.full(max(0, len(words.hash) - n + 1), n, np.uint64)
        for i in range(n):
            x = mixed(x + words.hash[i : len(words.hash) - n + 1 + i])
        h[n] = x
    first = words.first.tolist()
    return [np.unique(h[min(n, size)][a : a + max(1, n - size + 1)]) if n else words.hash[:0] for a, n in zip(first[:-1], have.tolist(), strict=True)]


def own(h: np.ndarray) -> np.ndarray:
    """The third of the shingles that is counted first."""
    return (h >> np.uint64(20)) % np.uint64(3) == 0


def packed(bucket: np.ndarray, entries: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Entries by bucket, one string of bytes for each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    bucket, entries = bucket[order], entries[order]
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    return bucket[cuts[:-1]].tolist(), [entries[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def unpacked(batches, column: str, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for b in batches for x in b.column(column).to_pylist() if x is not None), kind)


def by_bucket(each):
    """each, applied to the rows of one bucket after the other, of batches sorted by bucket."""

    def run(batches):
        now, held = None, []
        for b in batches:
            bucket = b.column("bucket").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if held and bucket[lo] != now:
                        yield from each(held)
                        held = []
                    now = bucket[lo]
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield from each(held)

    return run


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of 64-bit numbers, the same as pmod of the signed numbers in SQL."""
    return np.ascontiguousarray(x).view(np.int64) % buckets


ENTRY = np.dtype([("token", "<u8"), ("lo", "<u8")])
POSTING = np.dtype([("lo", "<u8"), ("df", "<u4"), ("token", "<u8")])
#: Entries that a task holds before it sends them on.
FLUSH = 1 << 19
#: A shingle is common if so many, and one in so many, of the documents in a flush own it; so many common shingles are known to all.
COMMON, SHARE, KNOWN = 16, 100, 100_000
#: Stands for further owners in an entry.
OTHERS = np.uint64(0xFFFFFFFFFFFFFFFF)


def _entries(tokens: list[np.ndarray], los: list[int]) -> np.ndarray:
    out = np.zeros(sum(map(len, tokens)), ENTRY)
    if tokens:
        out["token"], out["lo"] = np.concatenate(tokens), np.repeat(np.array(los, np.uint64), [len(t) for t in tokens])
    return out


def _by_token(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries sorted by token and owner, the number of each one's token, and owners by token."""
    e = e[np.lexsort((e["lo"], e["token"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["token"][1:] != e["token"][:-1]) | (e["lo"][1:] != e["lo"][:-1])
    e = e[new]
    first = np.ones(len(e), bool)
    first[1:] = e["token"][1:] != e["token"][:-1]
    group = np.cumsum(first) - 1
    return e, group, np.bincount(group) if len(e) else np.zeros(0, np.int64)


def _sketches(size: int):
    """Texts -> a row for each, and rows of shingles that are common among a task's documents."""

    def row(ids, n, third, hi, lo, common=None):
        k = len(n)
        columns = [pa.array(n, pa.int64()), pa.array(third, pa.int64()), pa.array(signed(np.array(hi, np.uint64))), pa.array(signed(np.array(lo, np.uint64)))]
        return pa.RecordBatch.from_arrays(
            [ids, *columns, pa.nulls(k, pa.list_(pa.int64())) if common is None else pa.array([common], pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "n_third", "hi", "lo", "common"]
        )

    def run(batches):
        seen, held, n_held = set(), [], 0

        def common():
            token, owners = np.unique(np.concatenate(held), return_counts=True)
            got = token[owners >= max(COMMON, len(held) // SHARE)]
            return row(pa.nulls(1, pa.int64()), [0], [0], [0], [0], signed(got).tolist())

        for rows, data, offsets in blocks(batches):
            n, third, hi, lo = [], [], [], []
            for h in shingle_sets(data, offsets, size):
                n.append(len(h))
                third.append(int(own(h).sum()))
                hi.append(int(mixed(h).sum(dtype=np.uint64)))
                lo.append(int(mixed(h + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)))
                if lo[-1] not in seen:
                    held.append(h)
                    n_held += len(h)
                    seen.add(lo[-1])
            yield row(rows.column("doc_id"), n, third, hi, lo)
            if n_held > FLUSH:
                yield common()
                seen, held, n_held = set(), [], 0
        if held:
            yield common()

    return run


def _shingles(size: int):
    """Batches of texts -> (lo, shingles) of each that isn't a copy of one that the task had shortly before; empty sets are left out."""

    def run(batches):
        seen = set()
        for _, data, offsets in blocks(batches):
            for h in shingle_sets(data, offsets, size):
                lo = int(mixed(h + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
                if len(h) and lo not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(lo)
                    yield lo, h

    return run


def _flushes(found):
    tokens, los, n = [], [], 0
    for lo, h in found:
        tokens.append(h)
        los.append(lo)
        n += len(h)
        if n > FLUSH:
            yield _entries(tokens, los)
            tokens, los, n = [], [], 0
    if n:
        yield _entries(tokens, los)


def _third(size: int, buckets: int):
    """Texts -> packed entries of a third of their shingles, and credits: how many of these have a second owner in the same flush."""

    def run(batches):
        for flush in _flushes((lo, h[own(h)]) for lo, h in _shingles(size)(batches)):
            e, group, owners = _by_token(flush)
            several = owners[group] > 1
            lo, n = np.unique(e["lo"][several], return_counts=True)
            e["lo"][several] = OTHERS
            e = _by_token(e)[0]
            where, what = packed(bucket_of(e["token"], buckets), e)
            k = len(where)
            at = int(bucket_of(lo[:1], buckets)[0]) if len(lo) else 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([*where, at], pa.int32()), pa.array([*what, None], pa.binary()), pa.array([None] * k + [signed(lo).tolist()], pa.list_(pa.int64())), pa.array([None] * k + [n.tolist()], pa.list_(pa.int64()))],
                ["bucket", "entries", "lo", "n"]
            )

    return run


CREDIT = np.dtype([("lo", "<u8"), ("n", "<u8")])


def _credits(buckets: int):
    """All entries of some buckets -> how many shingles of each owner have another, packed by owner."""

    def run(batches):
        batches = list(batches)
        e, group, owners = _by_token(unpacked(batches, "entries", ENTRY))
        e = e[(owners[group] > 1) & (e["lo"] != OTHERS)] if len(e) else e
        los = [e["lo"], *(np.array(x, np.int64).view(np.uint64) for b in batches for x in b.column("lo").to_pylist() if x)]
        ns = [np.ones(len(e), np.int64), *(np.array(x, np.int64) for b in batches for x in b.column("n").to_pylist() if x)]
        lo, inverse = np.unique(np.concatenate(los), return_inverse=True)
        out = np.zeros(len(lo), CREDIT)
        out["lo"], out["n"] = lo, np.bincount(inverse, np.concatenate(ns), len(lo)).astype(np.uint64)
        where, what = packed(bucket_of(lo, buckets), out)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(what, pa.binary())], ["bucket", "credits"])

    return run


def _credited(batches):
    """All credits of some owners -> one row for each owner."""
    c = unpacked(batches, "credits", CREDIT)
    lo, inverse = np.unique(c["lo"], return_inverse=True)
    yield pa.RecordBatch.from_arrays([pa.array(signed(lo)), pa.array(np.bincount(inverse, c["n"], len(lo)).astype(np.int64))], ["lo", "shared"])


def _postings(size: int, buckets: int, common):
    """Texts -> packed entries by token; of common tokens, postings by owner instead."""

    def run(batches):
        last = common.value
        for e in _flushes(_shingles(size)(batches)):
            known = np.isin(e["token"], last)
            p = np.zeros(int(known.sum()), POSTING)
            p["lo"], p["token"], p["df"] = e["lo"][known], e["token"][known], 0xFFFFFFFF
            e = e[~known]
            (a, x), (b, y) = packed(bucket_of(e["token"], buckets), e), packed(bucket_of(p["lo"], buckets), p)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a + b, pa.int32()), pa.array(x + [None] * len(b), pa.binary()), pa.array([None] * len(a) + y, pa.binary())],
                ["bucket", "entries", "postings"]
            )

    return run


def _counted(buckets: int):
    """All entries of some buckets -> postings, with the number of owners, of tokens that have several, by owner."""

    def run(batches):
        batches = list(batches)
        e, group, owners = _by_token(unpacked(batches, "entries", ENTRY))
        df = owners[group] if len(e) else np.zeros(0, np.int64)
        p = np.zeros(int((df > 1).sum()), POSTING)
        p["lo"], p["token"], p["df"] = e["lo"][df > 1], e["token"][df > 1], df[df > 1]
        p = np.concatenate((p, unpacked(batches, "postings", POSTING)))
        where, what = packed(bucket_of(p["lo"], buckets), p)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(what, pa.binary())], ["bucket", "postings"])

    return run


def _stars_of(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries -> (owner, least owner of its token) for all but the least, without repeats, and the entries of the least."""
    e, group, owners = _by_token(e)
    at = np.concatenate(([0], np.cumsum(owners)))[:-1]
    least = e["lo"][at][group] if len(e) else e["lo"]
    links = np.zeros(int((e["lo"] != least).sum()), ENTRY)
    links["token"], links["lo"] = least[e["lo"] != least], e["lo"][e["lo"] != least]
    links = _by_token(links)[0]
    return links["lo"], links["token"], e[at]


def _prefixes(t: int, buckets: int):
    """All postings of some owners, and their sizes -> packed entries of the first tokens of each; tokens with one owner come first and go nowhere."""

    def run(batches):
        batches = list(batches)
        p = unpacked(batches, "postings", POSTING)
        p = p[np.lexsort((p["token"], p["df"], p["lo"]))]
        p = p[np.append(True, (p["lo"][1:] != p["lo"][:-1]) | (p["token"][1:] != p["token"][:-1]))] if len(p) else p  # copies of a text send the same
        sizes = [(lo, n) for b in batches for lo, n in zip(b.column("lo").to_pylist(), b.column("n").to_pylist(), strict=True) if lo is not None]
        lo = np.array([s[0] for s in sizes], np.int64).view(np.uint64)
        n = np.array([s[1] for s in sizes], np.int64)
        order = np.argsort(lo)
        lo, n = lo[order], n[order]
        if len(p) and len(lo):
            a, b = np.searchsorted(p["lo"], lo, "left"), np.searchsorted(p["lo"], lo, "right")
            need = np.maximum(n - (n * t + 99) // 100 + 1 - (n - (b - a)), 0)
            who = np.searchsorted(lo, p["lo"])
            who = np.minimum(who, len(lo) - 1)
            taken = (lo[who] == p["lo"]) & (np.arange(len(p)) - a[who] < need[who])
            e = np.zeros(int(taken.sum()), ENTRY)
            e["token"], e["lo"] = p["token"][taken], p["lo"][taken]
        else:
            e = np.zeros(0, ENTRY)
        where, what = packed(bucket_of(e["token"], buckets), e)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(what, pa.binary())], ["bucket", "entries"])

    return run


def _first_stars(buckets: int):
    """Entries of a task -> links of owners to the least that the task has of each token, and the entries of these."""

    def run(batches):
        for b in batches:
            u, v, e = _stars_of(unpacked([b], "entries", ENTRY))
            where, what = packed(bucket_of(e["token"], buckets), e)
            k, at = len(where), int(bucket_of(u[:1], buckets)[0]) if len(u) else 0
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*where, at], pa.int32()), pa.array([*what, None], pa.binary()), pa.array([None] * k + [signed(u).tolist()], long),
                    pa.array([None] * k + [signed(v).tolist()], long)
                ],
                ["bucket", "entries", "u", "v"],
            )

    return run


def _unpacked_entries(batches):
    """Packed entries -> a row for each (token, lo)."""
    for b in batches:
        e = unpacked([b], "entries", ENTRY)
        yield pa.RecordBatch.from_arrays([pa.array(signed(e["token"])), pa.array(signed(e["lo"]))], ["token", "lo"])


def _stars(batches):
    batches = list(batches)
    u, v, _ = _stars_of(unpacked(batches, "entries", ENTRY))
    lists = [[np.array(x, np.int64) for b in batches for x in b.column(c).to_pylist() if x] for c in ("u", "v")]
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([signed(x), *more])) for x, more in zip((u, v), lists, strict=True)], ["u", "v"])


def candidates(docs: DataFrame, sketch: DataFrame, whole: DataFrame, size: int, t: int) -> tuple[DataFrame, DataFrame]:
    """(u, v), links between fingerprints such that any two sets that can reach the threshold are connected, and the packed entries of first tokens."""
    spark = docs.sparkSession
    shingles = sketch.agg(F.sum("n_shingles")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(tasks, -(-shingles // BUCKET))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(min(n, max(tasks, PARTITIONS)), "bucket").sortWithinPartitions("bucket")

    third = dealt(docs.select("text").mapInArrow(_third(size, n), "bucket int, entries binary, lo array<long>, n array<long>"))
    credits = dealt(third.mapInArrow(by_bucket(_credits(n)), "bucket int, credits binary")).mapInArrow(by_bucket(_credited), "lo long, shared long")
    least = F.col("n_third") - F.floor(F.col("n_shingles") * (100 - t) / 100)
    left = materialize(whole.join(credits, "lo", "left").where(F.coalesce("shared", F.lit(0)) >= least).select("lo", "node", "n_shingles"), "ngram-left")
    common = sketch.where("common is not null").select(F.explode("common").alias("token")).groupBy("token").count().orderBy(
        F.desc("count"), "token"
    ).limit(KNOWN)
    known = np.sort(np.array([r["token"] for r in common.toArrow().to_pylist()], np.int64).view(np.uint64))
    ids = small(left.select(F.col("node").alias("doc_id")).distinct())
    posted = docs.join(ids, "doc_id", "left_semi").select("text").mapInArrow(
        _postings(size, n, spark.sparkContext.broadcast(known)), "bucket int, entries binary, postings binary"
    )
    counted = dealt(posted).mapInArrow(by_bucket(_counted(n)), "bucket int, postings binary")
    bucket = F.pmod("lo", F.lit(n)).cast("int")
    sizes = left.select(bucket.alias("bucket"), F.lit(None).cast("binary").alias("postings"), "lo", F.col("n_shingles").alias("n"))
    both = counted.select("bucket", "postings", F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("n")).union(sizes)
    first = materialize(dealt(both).mapInArrow(by_bucket(_prefixes(t, n)), "bucket int, entries binary"), "ngram-first")
    stars = dealt(first.mapInArrow(_first_stars(n), "bucket int, entries binary, u array<long>, v array<long>")).mapInArrow(
        by_bucket(_stars), "u long, v long"
    )
    stars = materialize(stars, "ngram-stars")
    discard(left)
    return stars, first


def _sets(size: int):
    def run(batches):
        for rows, data, offsets in blocks(batches):
            sets = shingle_sets(data, offsets, size)
            hi = np.array([mixed(h).sum(dtype=np.uint64) for h in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(signed(hi)), pa.array([h.tobytes() for h in sets], pa.binary())], ["doc_id", "hi", "shingles"]
            )

    return run


class Tile:
    """Some rows of the incidence matrix: their shingles in order, with the rows that own them."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(h) for h in sets], np.int64)
        token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(token, kind="stable")
        self.token, self.row = token[order], np.repeat(np.arange(len(sets)), self.n)[order]
        self.first = np.flatnonzero(np.append(True, self.token[1:] != self.token[:-1])) if len(token) else np.zeros(0, np.int64)
        self.distinct, self.count = self.token[self.first], np.diff(np.append(self.first, len(token)))


def overlaps(a: Tile, b: Tile) -> np.ndarray:
    """Sizes of all intersections of rows of two tiles: the product of their incidence matrices."""
    shape = (len(a.n), len(b.n))
    out = np.zeros(shape, np.float32)  # whole numbers below 2**24 are exact
    _, i, j = np.intersect1d(a.distinct, b.distinct, assume_unique=True, return_indices=True)
    many = a.count[i] * b.count[j] * 64 > shape[0] * shape[1]
    # shingles that few rows have: each pair of owners adds one
    x, y = i[~many], j[~many]
    pairs = a.count[x] * b.count[y]
    piece = np.cumsum(pairs) // PAIRS
    for k in np.split(np.arange(len(x)), np.flatnonzero(np.diff(piece)) + 1) if len(x) else ():
        p = pairs[k]
        of = np.repeat(np.arange(len(p)), p)
        at = np.arange(len(of)) - np.repeat(np.cumsum(p) - p, p)
        width = b.count[y[k]][of]
        cell = a.row[a.first[x[k]][of] + at // width] * shape[1] + b.row[b.first[y[k]][of] + at % width]
        out += np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape)
    # the others as a dense product
    x, y = i[many], j[many]
    for lo in range(0, len(x), COLUMNS):
        k, parts = slice(lo, lo + COLUMNS), []
        for tile, columns in ((a, x[k]), (b, y[k])):
            count = tile.count[columns]
            column = np.repeat(np.arange(len(columns)), count)
            at = np.arange(len(column)) - np.repeat(np.cumsum(count) - count, count)
            part = np.zeros((len(tile.n), len(columns)), np.float32)
            part[tile.row[tile.first[columns][column] + at], column] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def linked(a: Tile, b: Tile, t: int) -> np.ndarray:
    """Whether each row of a reaches the threshold with each row of b, by whole numbers."""
    o = overlaps(a, b).astype(np.int64)
    return (o > 0) & (100 * o >= t * (a.n[:, None] + b.n[None, :] - o))


def apart(a: Tile, b: Tile, t: int) -> bool:
    """Whether sizes alone rule out all pairs."""
    return 100 * int(a.n.max()) < t * int(b.n.min()) or 100 * int(b.n.max()) < t * int(a.n.min())


def tiles(sets: list[np.ndarray]) -> list[tuple[np.ndarray, Tile]]:
    """Rows by size, TILE at a time: their numbers and themselves."""
    order = np.argsort([len(h) for h in sets], kind="stable")
    return [(part, Tile([sets[i] for i in part])) for part in np.split(order, range(TILE, len(order), TILE))]


def classes(sets: list[np.ndarray], t: int) -> np.ndarray:
    """For each set the number of one set of its class, the same for all of the class."""
    label, all_ = np.arange(len(sets)), tiles(sets)
    for i, (x, a) in enumerate(all_):
        for y, b in all_[i:]:
            if apart(a, b, t):
                break  # the next are larger still
            if x is not y and len(np.unique(np.append(label[x], label[y]))) == 1:
                continue
            hit = linked(a, b, t)
            for row, found in zip(x, hit, strict=True):
                others = np.unique(label[y[found]])
                if len(others) and (len(others) > 1 or others[0] != label[row]):
                    together = np.append(others, label[row])
                    label[np.isin(label, together)] = together.min()
    return label


def _links(u: list, v: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _square(t: int):
    """Blocks (block, part) -> links of each row to one of its class in the part."""

    def run(batches):
        u, v = [], []
        for rows in runs(batches, ["block", "part"]):
            rows = list({r["node"]: r for r in rows}.values())
            if len(rows) > 1:
                for i, j in enumerate(classes([np.frombuffer(r["shingles"], np.uint64) for r in rows], t).tolist()):
                    if i != j:
                        u.append(rows[i]["node"])
                        v.append(rows[j]["node"])
            if len(u) > 10_000:
                yield _links(u, v)
                u, v = [], []
        yield _links(u, v)

    return run


def _against(t: int):
    """(block, query part, part) -> for each query one link to each class that it reaches there."""

    def run(batches):
        for rows in runs(batches, ["block", "qpart", "part"]):
            q, d = ([r for r in rows if r["query"] == k] for k in (True, False))
            found: dict = {}
            if q and d:
                sides = [tiles([np.frombuffer(r["shingles"], np.uint64) for r in side]) for side in (q, d)]
                of_q, of_d = (np.array([r["class"] for r in side], np.int64) for side in (q, d))
                for x, a in sides[0]:
                    for y, b in sides[1]:
                        if not apart(a, b, t) and len(np.unique(np.append(of_q[x], of_d[y]))) > 1:
                            for i, j in zip(*np.nonzero(linked(a, b, t) & (of_q[x][:, None] != of_d[y][None, :])), strict=True):
                                found[q[x[i]]["node"], d[y[j]]["class"]] = d[y[j]]["node"]
            yield _links([k[0] for k in found], list(found.values()))

    return run


def ngram_jaccard_join(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id, n_same).

    Two documents link when 100 * intersection >= percent * union of their sets of `size`-word shingles; component_id is the
    smallest doc_id that links reach, n_same the number of documents with exactly the same set. Null and empty texts have empty
    sets and link with nothing; long texts are taken whole. Repeated rows come back as often as they stand there, and a doc_id with several texts gives
    each of them a row. A row without doc_id comes back with a null component and takes no part. Ties have no say: links and classes are
    the same in any order. An empty table gives an empty result; other columns are ignored.
    """
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialize(docs.mapInArrow(_sketches(size), "doc_id long, n_shingles long, n_third long, hi long, lo long, common array<long>"), "ngram-sketch")
    rows_ = sketch.where("common is null").select("doc_id", "n_shingles", "n_third", "hi", "lo")
    whole = rows_.where("n_shingles > 0 and doc_id is not null").groupBy("hi", "lo", "n_shingles", "n_third").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("n_same")
    )
    stars, entries = candidates(docs.where("doc_id is not null"), sketch, whole, size, percent)
    block_of = components(stars).select(F.col("id").alias("lo"), F.col("component").alias("block"))
    members = materialize(whole.join(block_of, "lo").select("node", "hi", "lo", "n_shingles", "block"), "ngram-members")

    def in_parts(rows: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(rows / F.lit(BLOCK_ROWS)), F.ceil(shingles / F.lit(BLOCK_SHINGLES))).cast("int")

    sizes = members.groupBy("block").agg(in_parts(F.count("*"), F.sum("n_shingles")).alias("parts"), F.min("node").alias("centre"))

    def rows(of: DataFrame) -> DataFrame:
        """of(node, hi, ...) with the shingles, hashed anew from the texts of just these documents."""
        ids = small(of.select(F.col("node").alias("doc_id")).distinct())
        sets = docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets(size), "doc_id long, hi long, shingles binary").dropDuplicates(["doc_id", "hi"])
        return sets.withColumnRenamed("doc_id", "node").join(of, ["node", "hi"])

    def dealt(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "node")

    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # blocks of several parts are few: one for BLOCK_ROWS rows at most, or for BLOCK_SHINGLES shingles
    placed = members.join(small(sizes.where("parts > 1")), "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    first = rows(placed).withColumn(
        "part", F.explode(F.when(F.col("node") == F.col("centre"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part)))
    )
    links = materialize(
        dealt(first.select("block", "part", "node", "shingles"), "block", "part").mapInArrow(_square(percent), "u long, v long"), "ngram-links"
    )
    found = components(links).withColumnRenamed("id", "node")

    divided = placed.where("parts > 1").select("block", "lo", "node", "hi", "n_shingles")
    if not divided.isEmpty():
        now = divided.join(found, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")

        def open_(owners: DataFrame, *more: str) -> DataFrame:
            """(block, most, parts, qparts, cost, *more) of the blocks of owners(block, node, class, n_shingles, *more) with several classes, more
            being the same for all of a block; of blocks with the same owners one. cost: how many shingles are sent to compare them."""
            sums = (F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"sum{k}") for k in (0, 1))
            counts = owners.groupBy("block", "class", *more).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), *sums)
            totals = (F.sum(c).alias(c) for c in ("n", "s", "sum0", "sum1"))
            each = counts.groupBy("block", *more).agg(
                F.count("*").alias("of"), F.max_by(F.struct("class", "n", "s"), F.struct("n", "class")).alias("most"), *totals
            ).where("of > 1")
            one = each.groupBy("sum0", "sum1", "n", *more).agg(F.min(F.struct("block", "most", "s")).alias("one")).select("one.*", "n", *more)
            others = F.col("s") - F.col("most.s")
            one = one.withColumns({"parts": in_parts(F.col("n"), F.col("s")), "qparts": in_parts(F.col("n") - F.col("most.n"), others)})
            return one.select(
                "block", F.col("most.class").alias("most"), "parts", "qparts", (F.col("s") * F.col("qparts") + others * F.col("parts")).alias("cost"),
                *more
            )

        as_wholes = materialize(open_(now), "ngram-wholes")
        wide = as_wholes.where(F.col("qparts") > QUERY_PARTS).select("block", F.col("cost").alias("whole_cost"))
        chained = now.join(small(wide), "block").withColumnRenamed("block", "whole")
        by_shingle = entries.mapInArrow(_unpacked_entries, "block long, lo long").join(chained, "lo")
        as_shingles = materialize(open_(by_shingle, "whole", "whole_cost"), "ngram-shingles")
        apart_ = as_shingles.groupBy(
            "whole", "whole_cost"
        ).agg(F.sum("cost").alias("cost")).where("cost < whole_cost").select("whole")  # where that sends less
        columns = ["node", "hi", "block", "parts", "qparts", "class", (F.col("class") != F.col("most")).alias("query")]
        wholes = now.join(small(as_wholes.join(apart_.withColumnRenamed("whole", "block"), "block", "left_anti")), "block").select(columns)
        shingles = by_shingle.select("block", "node", "hi", "class").join(small(as_shingles.join(apart_, "whole", "left_semi")), "block").select(columns)
        both = materialize(wholes.union(shingles), "ngram-rest")
        discard(as_wholes)
        discard(as_shingles)
        if not both.isEmpty():
            held = rows(both)
            qpart = F.pmod(F.xxhash64("node", F.lit(1)), F.col("qparts")).cast("int")
            data = held.withColumn("part", part).withColumn("qpart", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1))).withColumn("query", F.lit(False))
            asked = held.where("query").withColumn("qpart", qpart).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            columns = ["block", "qpart", "part", "query", "node", "class", "shingles"]
            more = materialize(
                dealt(data.select(columns).union(asked.select(columns)), "block", "qpart", "part").mapInArrow(_against(percent), "u long, v long"),
                "ngram-more"
            )
            again = components(links.union(more)).withColumnRenamed("id", "node")
            discard(more)
            found = again
        discard(both)
    for df in (stars, entries, members, links):
        discard(df)

    named = whole.join(found, "node", "left").select("hi", "lo", "n_shingles", F.coalesce("component", "node").alias("found"), "n_same")
    return rows_.select("doc_id", "n_shingles", "hi", "lo").join(named, ["hi", "lo", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"), F.when(
            F.col("doc_id").isNotNull(), F.coalesce("n_same", F.lit(1))
        ).otherwise(1).cast("long").alias("n_same")
    )


def keep_one(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """docs without those that link, directly or over others, to a document with a smaller doc_id; all columns stay.

    Rows without doc_id are kept. Rows that repeat both doc_id and text are reduced to one; where only a doc_id repeats, each of its texts
    is a document of its own, and their order is that of the texts' hashes.
    """
    known = docs.where("doc_id is not null")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        found = materialize(ngram_jaccard_join(docs, size, percent).select("doc_id", "component_id"), "ngram-found")
        return docs.join(small(found.where("component_id < doc_id").select("doc_id")), "doc_id", "left_anti")
    mark, key = fresh(docs, "mark"), fresh(docs, "key")
    marked = known.withColumn(mark, F.xxhash64("text"))
    # numbers of sorted rows grow with the order, so the smallest number of a component is its smallest doc_id's
    keys = materialize(marked.select("doc_id", mark).distinct().orderBy("doc_id", mark).withColumn(key, F.monotonically_increasing_id()), "ngram-keys")
    one = marked.dropDuplicates(["doc_id", mark])
    keyed = materialize(one.select("doc_id", mark, "text").join(keys, ["doc_id", mark]).select(F.col(key).alias("doc_id"), "text"), "ngram-keyed")
    found = materialize(ngram_jaccard_join(keyed, size, percent).where("component_id < doc_id").select(F.col("doc_id").alias(key)), "ngram-found")
    gone = small(keys.join(found, key).select("doc_id", mark))
    kept = one.join(gone, ["doc_id", mark], "left_anti").select(docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))
