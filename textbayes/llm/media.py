"""Media columns: ISO media files (nested boxes with sample tables), written, walked and read without decoding a sample.

A file is ftyp, mdat and moov/trak/mdia/minf/stbl; the sample tables stsd (codec), stts (durations), stsc and stco or co64 (chunks),
stsz (sizes) and stss (keyframes) give every sample's byte range. `describe` walks any such file and needs no more than its boxes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, texts

#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}
#: Boxes inside one another at most; files have about ten.
DEPTH = 32
#: Bytes of a sample, samples of a chunk (its first is a keyframe), samples a second.
SAMPLE, CHUNK, RATE = 64, 256, 8000


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body) + 8
    return struct.pack(">I4s", size, kind) + body if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def store(payload: bytes) -> bytes:
    """A file with one track of 8-bit samples in frames of SAMPLE bytes; the payload must be a positive multiple of that."""
    n = len(payload) // SAMPLE
    if n * SAMPLE != len(payload) or not n:
        raise ValueError(f"the payload must be a positive multiple of {SAMPLE} bytes")
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    start = len(ftyp) + (8 if len(payload) + 8 < 1 << 32 else 16)
    chunks = -(-n // CHUNK)
    where = start + np.arange(chunks, dtype=np.int64) * CHUNK * SAMPLE
    wide = bool(where[-1] >= 1 << 32)
    last = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)] * (last != CHUNK or chunks == 1)
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
        full(b"stss", struct.pack(">I", chunks), (np.arange(chunks, dtype=np.int64) * CHUNK + 1).astype(">u4").tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", SAMPLE, n)),
        full(b"co64" if wide else b"stco", struct.pack(">I", chunks), where.astype(">u8" if wide else ">u4").tobytes()),
    )
    url = full(b"url ", flags=1)
    minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), url)), stbl)
    mdia = box(
        b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, n * SAMPLE, 0x55C4, 0), version=1),
        full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"), minf
    )
    tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, n * SAMPLE), bytes(8), struct.pack(">hhhh", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=3)
    mvhd = full(
        b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, n * SAMPLE), struct.pack(">IH10x", 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2),
        version=1
    )
    return b"".join((ftyp, box(b"mdat", payload), box(b"moov", mvhd, box(b"trak", tkhd, mdia))))


def walk(data: bytes | memoryview, start: int = 0, stop: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of box kinds, begin and end of its body), depth first; bodies are not read. A box that doesn't fit, or is nested too deeply, raises ValueError."""
    if len(path) > DEPTH:
        raise ValueError("boxes are nested too deeply")
    stop = len(data) if stop is None else stop
    while start < stop:
        if stop - start < 8:
            raise ValueError(f"a box is cut off at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        begin = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, begin)
            begin += 8
        end = stop if size == 0 else start + size
        if end < begin or end > stop:
            raise ValueError(f"box {kind!r} at {start} doesn't fit")
        yield (*path, kind), begin, end
        if kind in NESTED:
            yield from walk(data, begin, end, (*path, kind))
        start = end


def _table(data, at: dict, kind: bytes, form: str, skip: int = 4) -> np.ndarray:
    if kind not in at:
        return np.zeros(0, np.int64)
    (n,) = struct.unpack_from(">I", data, at[kind][0] + skip)
    return np.frombuffer(data, form, n, at[kind][0] + skip + 4).astype(np.int64)


def tracks(data: bytes) -> list[dict]:
    """For each track: codec, duration in seconds, byte ranges of samples in order (offsets, sizes) and indexes of keyframes.

    Samples in fragments aren't read: a file with moof boxes raises ValueError.
    """
    found: list[dict] = []
    for path, begin, end in walk(data):
        if path == (b"moof",):
            raise ValueError("the file has fragments, which aren't read")
        if path[-2:] == (b"moov", b"trak"):
            found.append({})
        elif found and b"trak" in path:
            found[-1][path[-1]] = (begin, end)
    out = []
    for at in found:
        version = data[at[b"mdhd"][0]]
        scale, duration = struct.unpack_from(">IQ", data, at[b"mdhd"][0] + 20) if version else struct.unpack_from(">II", data, at[b"mdhd"][0] + 12)
        fixed, n = struct.unpack_from(">II", data, at[b"stsz"][0] + 4)
        if n * max(fixed, 1) > len(data):  # before anything of that size is made; a sample without bytes has an entry in the table
            raise ValueError("the samples don't fit the file")
        sizes = np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, at[b"stsz"][0] + 12).astype(np.int64)
        chunks = _table(data, at, b"stco", ">u4") if b"stco" in at else _table(data, at, b"co64", ">u8")
        (entries,) = struct.unpack_from(">I", data, at[b"stsc"][0] + 4)
        runs = np.frombuffer(data, ">u4", 3 * entries, at[b"stsc"][0] + 8).astype(np.int64).reshape(-1, 3)
        per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
        if per.sum() != n:
            raise ValueError("the chunks don't hold the samples")
        owner = np.repeat(np.arange(len(chunks)), per)[:n]
        before = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        first = np.concatenate(([0], np.cumsum(per)))[:-1]
        offsets = chunks[owner] + before - before[first[owner]] if n else np.zeros(0, np.int64)
        keys = _table(data, at, b"stss", ">u4") - 1 if b"stss" in at else np.arange(n)
        if n and (offsets + sizes > len(data)).any():
            raise ValueError("a sample lies outside of the file")
        out.append({"codec": bytes(data[at[b"stsd"][0] + 12 : at[b"stsd"][0] + 16]).decode("latin-1").strip(), "seconds": duration / scale if scale else 0.0, "offsets": offsets, "sizes": sizes, "keyframes": keys})
    return out


def joined(offsets: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges with neighbours that touch joined."""
    if not len(offsets):
        return []
    cut = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    a, b = np.append(0, cut), np.append(cut, len(offsets)) - 1
    return list(zip(offsets[a].tolist(), (offsets[b] + sizes[b]).tolist(), strict=True))


def payload_of(data: bytes, track: int = 0) -> bytes:
    """The samples of a track, by default the first, read by their byte ranges."""
    found = tracks(data)[track]
    return b"".join(data[a:b] for a, b in joined(found["offsets"], found["sizes"]))


RANGES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


TRACK_FIELDS = ["codec", "seconds", "n_samples", "keyframes", "ranges"]
TRACKS = pa.list_(pa.struct([("codec", pa.string()), ("seconds", pa.float64()), ("n_samples", pa.int64()), ("keyframes", RANGES), ("ranges", RANGES)]))


def _keyframes(track: dict) -> list[dict]:
    starts, sizes = track["offsets"][track["keyframes"]], track["sizes"][track["keyframes"]]
    return [{"start": a, "stop": b} for a, b in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)]


def _ranges(track: dict) -> list[dict]:
    return [{"start": a, "stop": b} for a, b in joined(track["offsets"], track["sizes"])]


def _described(files: list[bytes]) -> list[pa.Array]:
    rows = []
    for data in files:
        try:
            found = [{"codec": t["codec"], "seconds": t["seconds"], "n_samples": len(t["sizes"]), "keyframes": _keyframes(t), "ranges": _ranges(t)} for t in tracks(data)]
            rows.append((found or None, None if found else "no track"))
        except (ValueError, KeyError, IndexError, MemoryError, RecursionError, struct.error) as e:
            rows.append((None, f"{type(e).__name__}: {e}"))
    get = lambda name: [t and t[0][name] for t, _ in rows]
    first = [pa.array(get(f.name), f.type) for f in TRACKS.value_type]
    return [*first, pa.array([t for t, _ in rows], TRACKS), pa.array([e for _, e in rows], pa.string())]


_SPANS = "array<struct<start:long,stop:long>>"
DESCRIBED = f"codec string, seconds double, n_samples long, keyframes {_SPANS}, ranges {_SPANS}, tracks array<struct<codec:string,seconds:double,n_samples:long,keyframes:{_SPANS},ranges:{_SPANS}>>, error string"


def media_columns(files: DataFrame, content: str = "media") -> DataFrame:
    """files(..., content binary) -> the same rows and columns with the first track's codec, seconds, n_samples, keyframes (byte ranges of its
    keyframes), ranges (of all its samples, neighbours joined), the same of all tracks in tracks, and error.

    A null, empty, broken, hostile or fragmented file has null for all but error; a file is never read beyond its boxes and tables, and no table is
    made larger than the file. Repeated rows come back as often as they stand there, an empty table gives an empty result. The added columns replace columns
    of the same names.
    """
    names = [*TRACK_FIELDS, "tracks", "error"]
    kept = files.drop(*names)

    def run(batches):
        for rows in batches:
            yield pa.RecordBatch.from_arrays([*rows.columns, *_described([x or b"" for x in rows.column(content).to_pylist()])], [*rows.schema.names, *names])

    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), DESCRIBED]))


def store_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_bytes, media): the text's UTF-8 and bytes 0 up to a positive multiple of 64, stored; null counts as empty.

    One row for each row, repeats too; equal texts give equal files; a long text is one file.
    """

    def run(batches):
        for rows, data, offsets in blocks(batches):
            whole = texts(data, offsets)
            media = [store(t + bytes(-len(t) % SAMPLE or (0 if t else SAMPLE))) for t in whole]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def digests(stored: DataFrame) -> DataFrame:
    """stored(doc_id, n_bytes, media, codec, seconds, n_samples, keyframes, ranges) -> digests of the payload, read back by ranges, and of the file.

    A file without ranges (null or broken) has null for all that is made of its payload or columns, and null media_bytes if it is null itself.
    Repeated rows come back as often as they stand there, an empty table gives an empty result.
    """

    def run(batches):
        for rows in batches:
            out = []
            columns = (rows.column(c).to_pylist() for c in ("media", "codec", "seconds", "n_samples", "keyframes", "ranges"))
            for data, codec, seconds, n, keys, ranges in zip(*columns, strict=True):
                file = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                if data is None or ranges is None:
                    out.append((None, None, None, *file, None))
                    continue
                payload = b"".join(data[r["start"] : r["stop"]] for r in ranges)
                where = hashlib.sha256(b",".join(b"%d:%d" % (k["start"], k["stop"]) for k in keys)).hexdigest()[:16]
                feature = f"codec={codec};seconds={seconds:.6f};samples={n};keyframes={len(keys)};ranges={where}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *file, feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            made = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("n_bytes"), *made],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            )

    return stored.mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
