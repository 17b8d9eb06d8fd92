import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tessera.llm import mpeg_audio as M, sharding as S


def test_text_media_digest(spark):
    rows = [(1, "Grüße " * 100), (2, None), (3, ""), (4, "x" * 192), (5, "x" * 193), (None, "日本"), (1, "Grüße " * 100), (6, "long " * 40000)]
    got = M.text_media_digest(spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, feature string")).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        text = dict((i, t) for i, t in rows)[r.doc_id] or ""
        raw = text.encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        media = M.pack(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
        assert by_text.setdefault(text, r.feature) == r.feature
        assert r.seconds == pytest.approx(-(-len(payload) // 576) * 1152 / 48000) or len(payload) % 576
    assert M.text_media_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pack_round_trip():
    rng = random.Random(0)
    for n in [0, 1, 191, 192, 193, 575, 576, 577, 5000]:
        raw = bytes(rng.randrange(256) for _ in range(n))
        payload, size = M.unpack(M.pack(raw))
        assert payload == M.padded(raw) and size == n


def frame(kbits=128, padding=0, version=3, layer=3, hz=0, mono=False, crc=False, body=b""):
    layer_bits = 4 - layer
    head = bytes([0xFF, 0xE0 | version << 3 | layer_bits << 1 | (not crc), M.KBITS[version == 3, layer].index(kbits) << 4 | hz << 2 | padding << 1, 0xC0 if mono else 0])
    h = M.parse_header(head)
    if crc:
        side = bytes(M.SIDE[version == 3, mono])
        head += M.crc16(head[2:4] + side).to_bytes(2, "big") + side
    return head + body + bytes(h.size - len(head) - len(body))


def test_sizes_and_durations():
    # 128 kbit/s at 44.1 kHz has frames of 417 bytes, 418 with padding
    assert len(frame()) == 417 and len(frame(padding=1)) == 418
    assert len(frame(kbits=32, layer=1, hz=2)) == 48 and len(frame(kbits=64, layer=2, hz=1)) == 192
    assert len(frame(kbits=64, version=2)) == 208 and len(frame(kbits=8, version=0, hz=1)) == 48
    s = M.scan(frame() + frame(padding=1) + frame())
    assert (s.offsets, s.samples, s.hertz) == ([0, 417, 835], 3456, 44100)
    assert M.scan(frame(kbits=64, version=2) * 4).samples == 4 * 576


def test_resynchronisation_tags_and_checksums():
    good = frame(crc=True, mono=True)
    bad = bytearray(good)
    bad[10] ^= 1
    tag = b"ID3\3\0\0\0\0\0\x15TIT2\0\0\0\x04\0\0\0abcxxxxxxx"
    v1 = b"TAG" + b"Title".ljust(30, b"\0") + bytes(95)
    stream = tag + good * 2 + b"\xff\xfbgarbage\xff" + good + bytes(bad) + good[:100] + v1
    s = M.scan(stream)
    assert len(s.offsets) == 4 and s.checked == 4 and s.failed == 1
    assert s.tags["TIT2"] == "abc" and s.tags["ID3v1"] == "Title"
    assert s.skipped == 10 + 100
    ape = b"APETAGEX" + struct.pack("<IIII", 2000, 32, 0, 0) + bytes(8)
    assert len(M.scan(good * 3 + ape).offsets) == 3
    assert M.scan(b"").offsets == [] and M.scan(b"\xff" * 500).offsets == []


def test_payloads_that_look_like_an_id3v1_tag():
    for units, at in ((1, 89), (2, 329), (3, 521)):
        for before in (0, 3, 6):
            raw = bytearray(b"x" * (before + units) * M.UNIT)
            raw[before * M.UNIT + at : before * M.UNIT + at + 3] = b"TAG"
            stored = M.pack(bytes(raw))
            assert stored[-128:-125] == b"TAG"
            s = M.scan(stored)
            assert M.unpack(stored, s) == (bytes(raw), len(raw)) and (s.skipped, len(s.offsets)) == (0, s.table_frames) and "ID3v1" not in s.tags
            tagged = M.scan(stored + b"TAG" + b"Title".ljust(125, b"\0"))
            assert tagged.offsets == s.offsets and tagged.tags["ID3v1"] == "Title"


@pytest.mark.parametrize("word", [b"TAG", b"APETAGEX" + struct.pack("<III", 2000, 300, 1), b"ID3\4\0\0\0\0\1\0", b"\xff\xfb\x94\xc0", b"Xing\0\0\0\1"])
def test_tag_words_at_every_place(word):
    for size in (192, 384, 576, 768, 960):
        for at in range(size - len(word) + 1):
            raw = bytearray(b"y" * size)
            raw[at : at + len(word)] = word
            assert M.unpack(M.pack(bytes(raw))) == (bytes(raw), size)


def bit_checksum(bits):
    value = 0xFFFF
    for b in bits:
        value = (value << 1 ^ (0x8005 if (value >> 15) ^ int(b) else 0)) & 0xFFFF
    return value


@pytest.mark.parametrize("used", [(), (0,), (0, 5, 26)])
def test_layer_2_checksum(used):
    widths = [4] * 11 + [3] * 12 + [2] * 4  # one channel of 64 kbit/s at 44.1 kHz
    allocation = "".join(format(int(k in used), f"0{w}b") for k, w in enumerate(widths))
    covered = allocation + "10" * len(used)
    head = bytes([0xFF, 0xFC, M.KBITS[True, 2].index(64) << 4, 0xC0])
    size = M.parse_header(head).size
    body = covered + "1" * (8 * size - 48 - len(covered))
    crc = bit_checksum("".join(format(x, "08b") for x in head[2:]) + covered)
    good = head + crc.to_bytes(2, "big") + int(body, 2).to_bytes(size - 6, "big")
    bad = bytearray(good)
    bad[6] ^= 0x10
    s = M.scan(good * 2 + bytes(bad) + good)
    assert (len(s.offsets), s.checked, s.failed, s.samples) == (4, 4, 1, 4 * 1152)


def test_free_format():
    head = lambda padding: bytes([0xFF, 0xFB, padding << 1, 0xC0])
    stream = b"".join(head(p) + bytes(196 + p) for p in (0, 1, 0, 0, 1))
    s = M.scan(b"junk" + stream + b"TAG" + bytes(125))
    assert (s.offsets, s.sizes) == ([4, 204, 405, 605, 805], [200, 201, 200, 200, 201]) and "ID3v1" in s.tags
    assert s.samples == 5 * 1152 and s.skipped == 4


def test_variable_rate_tables():
    xing = frame(body=bytes(32) + b"Xing" + struct.pack(">III", 7, 2, 1251) + bytes(range(100)))
    s = M.scan(xing + frame() * 2)
    assert (s.table, s.table_frames, s.table_bytes, len(s.offsets), s.seek[99]) == ("Xing", 2, 1251, 2, 99 * 1251 // 256)
    vbri = frame(body=bytes(32) + b"VBRI" + bytes(6) + struct.pack(">IIHHHH", 1251, 2, 2, 1, 2, 1) + struct.pack(">HH", 417, 417))
    s = M.scan(vbri + frame() * 2)
    assert (s.table, s.table_frames, s.table_bytes, s.seek) == ("VBRI", 2, 1251, [417, 834])


def test_scan_media(spark):
    rows = [(1, frame() * 5), (2, None), (3, b"nothing"), (4, b"")]
    got = {r.doc_id: r for r in M.scan_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1].frames == 5 and got[1].seek_offsets == [417 * k for k in range(5)] and got[1].seconds == 5 * 1152 / 44100
    assert [got[k].frames for k in (2, 3, 4)] == [0, 0, 0]


def brute_table(shards, slots):
    orders = [[(o + k * s) % slots for k in range(slots)] for o, s in (S.preference(x, slots) for x in shards)]
    table, at = [-1] * slots, [0] * len(shards)
    while -1 in table:
        for k, order in enumerate(orders):
            while at[k] < slots and table[order[at[k]]] >= 0:
                at[k] += 1
            if at[k] < slots:
                table[order[at[k]]] = k
    return table


@pytest.mark.parametrize("n, slots", [(1, 2), (3, 7), (5, 101), (7, 7)])
def test_lookup_table(n, slots):
    shards = [f"s{i}" for i in range(n)]
    assert S.lookup_table(shards, slots).tolist() == brute_table(shards, slots)


def test_table_is_even_and_stable():
    a, b = S.lookup_table([f"s{i}" for i in range(20)], 10007), S.lookup_table([f"s{i}" for i in range(19)], 10007)
    assert np.ptp(np.bincount(a)) <= 1
    moved = ((a != b) & (a != 19)).mean()
    assert moved < 0.05
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            S.lookup_table(bad)
    with pytest.raises(ValueError):
        S.lookup_table(["a"], 100)


def test_placement(spark, tmp_path):
    rows = [(i, f"t{i}", "old") for i in range(500)] + [(None, "null", "old"), (3, "t3", "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    shards = ["a", "b", "c"]
    got = S.place(df, shards=shards, slots=101)
    assert sorted(got.columns) == ["doc_id", "shard", "slot", "text"]
    table = S.lookup_table(shards, 101)
    for r in got.collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:12], 16) % 101
        assert (r.slot, r.shard) == (slot, shards[table[slot]])
    assert got.count() == 502
    S.write_shards(df.drop("shard"), str(tmp_path / "out"), shards=shards, slots=101)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 502 and {r.shard for r in back.select("shard").distinct().collect()} == set(shards)
    assert S.place(df.limit(0), shards=shards, slots=101).count() == 0
