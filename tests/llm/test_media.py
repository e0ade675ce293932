import hashlib
import random
import struct
import tracemalloc

from textbayes.llm import media, queries
from tests.llm import plain


def two_tracks(payload):
    """A stored file whose track stands twice, the second time as video."""
    data = media.store(payload)
    begin, end = next((b, e) for p, b, e in media.walk(data) if p == (b"moov", b"trak"))
    start = data.index(b"moov") - 4
    trak = data[begin - 8 : end]
    body = data[start + 8 :] + trak.replace(b"raw ", b"avc1")
    return data[:start] + struct.pack(">I4s", len(body) + 8, b"moov") + body


def test_every_track_is_described(spark):
    payload = bytes(range(256)) * 64
    data = two_tracks(payload)
    fragmented = media.store(payload) + media.box(b"moof", b"")
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(fragmented)), (3, None)], "id long, media binary")
    out = {r.id: r for r in media.media_columns(df).collect()}
    assert [(t.codec, t.n_samples, len(t.keyframes)) for t in out[1].tracks] == [("raw", 256, 1), ("avc1", 256, 1)]
    assert (out[1].codec, out[1].n_samples, out[1].error) == ("raw", 256, None)
    assert media.payload_of(data, 1) == payload
    assert out[2].n_samples is None and out[2].tracks is None and "fragments" in out[2].error
    assert out[3].tracks is None and out[3].error == "no track"


def find(data, *path):
    """The body of the first box at a path, without the module's walker."""
    for kind in path:
        at = 0
        while data[at + 4 : at + 8] != kind:
            at += int.from_bytes(data[at : at + 4], "big")
        data = data[at + 8 : at + int.from_bytes(data[at : at + 4], "big")]
    return data


def numbers(data, width=4):
    return [int.from_bytes(data[i : i + width], "big") for i in range(0, len(data), width)]


def test_stored_form_read_by_other_means(spark, tmp_path):
    data = plain.rows(spark, extra=["long " * 40_000])
    plain.frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    stored = {(r.doc_id, r.n_bytes): bytes(r.media) for r in media.store_texts(plain.frame(spark, data)).collect()}
    got = {(r.doc_id, r.n_bytes): r for r in queries.op7_media_columns(spark, str(tmp_path)).collect()}
    assert got.keys() == stored.keys()
    for key, file in stored.items():
        stbl = find(file, b"moov", b"trak", b"mdia", b"minf", b"stbl")
        fixed, n = numbers(find(stbl, b"stsz"))[1:]
        chunks, keys = numbers(find(stbl, b"stco"))[2:], numbers(find(stbl, b"stss"))[2:]
        entry = find(stbl, b"stsd")[8:]
        per = [media.CHUNK] * (len(chunks) - 1) + [n - media.CHUNK * (len(chunks) - 1)]
        payload = b"".join(file[c : c + p * fixed] for c, p in zip(chunks, per, strict=True))
        starts = [chunks[(k - 1) // media.CHUNK] + (k - 1) % media.CHUNK * fixed for k in keys]
        where = hashlib.sha256(",".join(f"{a}:{a + fixed}" for a in starts).encode()).hexdigest()[:16]
        r = got[key]
        assert (r.media_bytes, r.media_sha256, r.payload_sha256) == (len(file), hashlib.sha256(file).hexdigest(), hashlib.sha256(payload).hexdigest())
        assert r.feature == f"codec={entry[4:8].decode().strip()};seconds={len(payload) / 8000:.6f};samples={n};keyframes={len(keys)};ranges={where}"
        assert (numbers(entry[30:32], 2)[0], numbers(find(stbl, b"stts"))[2:]) == (0, [n, 64]) and find(file, b"mdat") == payload


def test_hostile_files(spark):
    good = media.store(bytes(range(64)) * 40)
    at = good.index(b"stsz") + 8
    many = good[:at] + struct.pack(">II", 64, 0xFFFFFFF0) + good[at + 8 :]
    at = good.index(b"stsc") + 4 + 8
    wide = good[:at] + struct.pack(">III", 1, 0xFFFFFFF0, 1) + good[at + 12 :]
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    rnd = random.Random(0)
    broken = []
    for _ in range(200):
        b = bytearray(good)
        for _ in range(3):
            b[rnd.randrange(len(b) - 2600, len(b))] = rnd.randrange(256)
        broken.append(bytes(b))
    tracemalloc.start()
    described = [media._described([f]) for f in (many, wide, deep, *broken)]
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()
    assert all(d[-1][0].as_py() for d in described[:3])
    df = spark.createDataFrame([(1, 3, bytearray(many)), (2, 0, None), (3, 3, bytearray(good)), (3, 3, bytearray(good))], "doc_id long, n_bytes long, media binary")
    out = sorted((r.doc_id, r.payload_bytes, r.media_bytes, r.feature is None) for r in media.digests(media.media_columns(df)).collect() if r.media_bytes)
    assert out == [(1, None, len(many), True), (3, 2560, len(good), False), (3, 2560, len(good), False)]
    assert media.digests(media.media_columns(df)).where("doc_id = 2 and media_bytes is null and payload_sha256 is null").count() == 1
    assert media.digests(media.media_columns(df.limit(0))).count() == 0 == media.store_texts(spark.createDataFrame([], "doc_id long, text string")).count()
