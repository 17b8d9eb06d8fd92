"""MPEG audio columns: a packer and a reader of streams in binary columns.

``scan`` reads any stream of layers I to III of MPEG 1, 2 and 2.5: it skips
and parses ID3v2, APEv2 and ID3v1 tags, finds frame headers again after
damage (then a header counts only if another that fits follows where it says
the frame ends, or the stream ends there), reads Xing, Info and VBRI tables,
verifies the checksums, and gives the exact duration in samples and the offset
of every frame. The frames of a free-format stream are as long as the distance of
its first two headers tells.

``pack`` stores bytes in the ancillary part of silent layer III frames: a
frame of 80, 160 or 224 kbit/s holds one, two or three units of 192 bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import arrow, text_buffer

# Fixed values of the MPEG audio standards: kbit/s by (version 1?, layer), Hz by
# version code, samples a frame by (version 1?, layer), side information bytes
# by (version 1?, mono?).
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}
SIDE = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}
CRC_POLYNOMIAL = 0x8005
# Allocation bits of layer II by sub-band, for the standards' tables a to d and
# for the low sampling rates.
LAYER2_BITS = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "low": (4,) * 4 + (3,) * 7 + (2,) * 19,
}
#: No free-format frame is longer.
LONGEST_FREE = 4608

UNIT = 192
#: Units in a frame: bit rate and frame bytes at 48 kHz.
RATES = {1: (80, 240), 2: (160, 480), 3: (224, 672)}
OVERHEAD = 4 + 2 + 17


@dataclass(frozen=True)
class Header:
    version1: bool
    layer: int
    protected: bool
    kbits: int
    hertz: int
    mono: bool
    size: int
    samples: int
    padding: int
    kind: tuple


@lru_cache(4096)
def parse_header(word: bytes, free: int = 0) -> Header | None:
    """The four bytes of a frame header, or None where they are none. A header
    without a bit rate is one only if ``free``, the frame's bytes, is given."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    code, layer, rate, hz = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3), word[2] >> 4, word[2] >> 2 & 3
    if code == 1 or layer == 4 or rate == 15 or hz == 3 or word[3] & 3 == 2 or (rate == 0) != (free > 0):
        return None
    one = code == 3
    kbits, hertz, padding = KBITS[one, layer][rate], HERTZ[code][hz], word[2] >> 1 & 1
    samples = SAMPLES[one, layer]
    if free:
        size = free + padding * (4 if layer == 1 else 1)
    else:
        size = (12000 * kbits // hertz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hertz + padding
    return Header(one, layer, not word[1] & 1, kbits, hertz, word[3] >> 6 == 3, size, samples, padding, (code, layer, hz))


@lru_cache(4096)
def crc16(data: bytes) -> int:
    value = 0xFFFF
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ CRC_POLYNOMIAL if value & 0x8000 else value << 1) & 0xFFFF
    return value


@dataclass
class Stream:
    """What ``scan`` found. ``offsets`` and ``sizes`` are of the audio frames;
    the frame of a Xing, Info or VBRI table isn't one of them."""

    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    samples: int = 0
    hertz: int = 0
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    seek: list[int] = field(default_factory=list)
    checked: int = 0
    failed: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)

    @property
    def seconds(self) -> float:
        return self.samples / self.hertz if self.hertz else 0.0


def _synchsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """End of the ID3v2 tag at ``at``; its text fields go to ``tags``."""
    version, flags = data[at + 3], data[at + 5]
    end = at + 10 + _synchsafe(data[at + 6 : at + 10]) + (10 if flags & 0x10 else 0)
    pos = at + 10
    if flags & 0x40 and version >= 3:
        pos += _synchsafe(data[pos : pos + 4]) if version == 4 else 4 + int.from_bytes(data[pos : pos + 4], "big")
    while version >= 3 and pos + 10 <= min(end, len(data)) and data[pos]:
        name = data[pos : pos + 4].decode("latin-1")
        size = _synchsafe(data[pos + 4 : pos + 8]) if version == 4 else int.from_bytes(data[pos + 4 : pos + 8], "big")
        body = data[pos + 10 : pos + 10 + size]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
            name, text = (f"TXXX:{text.split(chr(0))[0]}", text.partition("\0")[2]) if name == "TXXX" else (name, text)
            tags[name] = text
        pos += 10 + size
    return end


def _table(data: bytes, at: int, head: Header, out: Stream) -> bool:
    """Read a Xing, Info or VBRI table in the frame at ``at``."""
    for skip in (0, 2):
        pos = at + 4 + SIDE[head.version1, head.mono] + skip
        name = data[pos : pos + 4]
        if name in (b"Xing", b"Info") and head.layer == 3 and len(data) >= pos + 8:
            flags, pos, out.table = int.from_bytes(data[pos + 4 : pos + 8], "big"), pos + 8, name.decode()
            if flags & 1:
                out.table_frames, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
            if flags & 2:
                out.table_bytes, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
            if flags & 4:
                out.seek = [x * (out.table_bytes or 0) // 256 for x in data[pos : pos + 100]]
            return True
    pos = at + 36
    if data[pos : pos + 4] == b"VBRI" and len(data) >= pos + 26:
        out.table = "VBRI"
        out.table_bytes, out.table_frames, entries, scale, width, _ = struct.unpack(">IIHHHH", data[pos + 10 : pos + 26])
        total = 0
        for k in range(entries):
            total += int.from_bytes(data[pos + 26 + k * width : pos + 26 + (k + 1) * width], "big") * scale
            out.seek.append(total)
        return True
    return False


def _sub_bands(version1: bool, kbits: int, hertz: int) -> tuple[int, ...]:
    """Bits of a layer II allocation in each sub-band; ``kbits`` is one channel's."""
    if not version1:
        return LAYER2_BITS["low"]
    if kbits in (32, 48):
        return LAYER2_BITS["d" if hertz == 32000 else "c"]
    return LAYER2_BITS["a" if hertz == 48000 or 0 < kbits <= 80 else "b"]


def _layer2_covered(data: bytes, at: int, head: Header) -> int:
    """Bits of the allocation and of the scale factors' selection: two bits for
    each channel's sub-band that has an allocation."""
    channels = 1 if head.mono else 2
    widths = _sub_bands(head.version1, head.kbits // channels, head.hertz)
    joint = data[at + 3] >> 6 == 1
    bound = 0 if head.mono else min(len(widths), 4 * ((data[at + 3] >> 4 & 3) + 1) if joint else len(widths))
    word = int.from_bytes(data[at + 6 : at + 6 + 64].ljust(64, b"\0"), "big")
    bit = chosen = 0
    for band, width in enumerate(widths):
        for _ in range(2 if band < bound else 1):
            used = word >> 512 - bit - width & (1 << width) - 1
            chosen += (1 if band < bound else channels) * (used > 0)
            bit += width
    return bit + 2 * chosen


def _crc_bits(data: bytes, at: int, bits: int) -> int:
    """Checksum of the header's last 16 bits and of ``bits`` after the checksum."""
    value = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + bits // 8])
    for k in range(bits % 8):
        top = (value >> 15 & 1) ^ (data[at + 6 + bits // 8] >> 7 - k & 1)
        value = (value << 1 ^ (CRC_POLYNOMIAL if top else 0)) & 0xFFFF
    return value


def _checksum(data: bytes, at: int, head: Header, out: Stream) -> None:
    if head.layer == 3:
        bits = 8 * SIDE[head.version1, head.mono]
    elif head.layer == 1:
        joint = data[at + 3] >> 6 == 1
        shared = 4 * ((data[at + 3] >> 4 & 3) + 1) if joint else 32
        bits = 4 * (32 if head.mono else shared * 2 + (32 - shared))
    else:
        bits = _layer2_covered(data, at, head)
    if 6 + -(-bits // 8) > head.size:
        out.checked, out.failed = out.checked + 1, out.failed + 1
        return
    out.checked += 1
    out.failed += _crc_bits(data, at, bits) != int.from_bytes(data[at + 4 : at + 6], "big")


def _closing(data: bytes, low: int) -> tuple[int, dict[str, str]]:
    """Where the tags at the end of the data begin, but not before ``low``, the
    end of the last frame; and what they say."""
    end, tags = len(data), {}
    if end - 128 >= low and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags["ID3v1"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    if end - 32 >= low and data[end - 32 : end - 24] == b"APETAGEX":
        size = int.from_bytes(data[end - 20 : end - 16], "little") + (32 if data[end - 9] & 0x80 else 0)
        if size >= 32 and end - size >= low:
            tags["APE"] = str(int.from_bytes(data[end - 16 : end - 12], "little"))
            end -= size
    return end, tags


def _free_size(data: bytes, at: int) -> int:
    """Bytes of a free-format frame without padding: up to the next header that
    is of the same kind, which a third one confirms or the data end after."""
    kind = parse_header(data[at : at + 4], 1)
    step = 4 if kind and kind.layer == 1 else 1
    last = at + LONGEST_FREE
    pos = data.find(data[at : at + 2], at + 24, last)
    while kind and pos >= 0:
        pad = kind.padding * step
        after = parse_header(data[pos : pos + 4], 1)
        if after and after.kind == kind.kind and after.kbits == 0:
            end = pos + (pos - at - pad) + after.padding * step
            third = parse_header(data[end : end + 4], 1)
            if end == len(data) or third and third.kind == kind.kind:
                return pos - at - pad
        pos = data.find(data[at : at + 2], pos + 1, last)
    return 0


def scan(data: bytes) -> Stream:
    """Read a whole stream; empty data give no frames.

    Tags at the end are looked for only after the last whole frame, so nothing
    inside a frame is taken for one: a frame that ends with the data, or where
    the next frame begins, is audio, whatever its bytes.
    """
    out, n, pos, low, free = Stream(), len(data), 0, 0, 0
    kind, first, synced = None, True, False
    while pos < n:
        if data[pos : pos + 3] == b"ID3" and pos + 10 <= n:
            pos = low = min(n, _id3v2(data, pos, out.tags))
            continue
        head = parse_header(data[pos : pos + 4], free)
        if head is None and not free and kind is None and parse_header(data[pos : pos + 4], 1):
            free = _free_size(data, pos)
            head = parse_header(data[pos : pos + 4], free) if free else None
        if head and pos + head.size <= n and (kind is None or head.kind == kind):
            to = pos + head.size
            after = parse_header(data[to : to + 4], free)
            sure = to == n or after and after.kind == head.kind or data[to : to + 3] == b"ID3" or _closing(data, to)[0] == to
            if sure or synced and _closing(data, pos + 1)[0] >= to:
                kind, out.hertz = head.kind, head.hertz
                if not (first and _table(data, pos, head, out)):
                    out.offsets.append(pos)
                    out.sizes.append(head.size)
                    out.samples += head.samples
                if head.protected:
                    _checksum(data, pos, head, out)
                first, synced = False, True
                pos = low = to
                continue
        synced = False
        end, tags = _closing(data, low)
        if pos >= end:
            out.tags.update(tags)
            break
        on = data.find(b"\xff", pos + 1, end)
        on = end if on < 0 else on
        tag = data.find(b"ID3", pos + 1, on)
        on = tag if tag >= 0 else on
        out.skipped += on - pos
        pos = on
    return out


def _header(kbits: int, protected: bool) -> bytes:
    return bytes([0xFF, 0xFB ^ protected, KBITS[True, 3].index(kbits) << 4 | 1 << 2, 0xC0])


@lru_cache(8)
def _frame_start(units: int) -> bytes:
    head = _header(RATES[units][0], True)
    side = bytes(17)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


def padded(raw: bytes) -> bytes:
    """Spaces appended up to a positive multiple of ``UNIT``."""
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))


def pack(raw: bytes) -> bytes:
    """A variable-rate layer III stream that holds ``raw``, padded.

    An ID3v2 tag tells the unpadded length; a Xing table has the frames, the
    bytes and a hundred seek points.
    """
    payload = padded(raw)
    parts, pos = [], 0
    while pos < len(payload):
        units = min(3, (len(payload) - pos) // UNIT)
        body = payload[pos : pos + units * UNIT]
        parts.append(_frame_start(units) + body + bytes(RATES[units][1] - OVERHEAD - len(body)))
        pos += len(body)
    table_size = RATES[1][1]
    total = table_size + sum(map(len, parts))
    ends = np.cumsum([table_size, *map(len, parts)])
    toc = bytes((ends[np.arange(100) * len(parts) // 100] * 256 // total).astype(np.uint8))
    table = _header(RATES[1][0], False) + bytes(17) + b"Xing" + struct.pack(">III", 7, len(parts), total) + toc
    text = b"\3payload\0" + str(len(raw)).encode()
    entry = b"TXXX" + bytes([0, 0, 0, len(text)]) + b"\0\0" + text
    size = len(entry)
    tag = b"ID3\4\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + entry
    return tag + table + bytes(table_size - len(table)) + b"".join(parts)


def unpack(data: bytes, stream: Stream | None = None) -> tuple[bytes, int]:
    """The padded bytes that ``pack`` stored, and the unpadded length."""
    stream = stream or scan(data)
    units = {size: n for n, (_, size) in RATES.items()}
    parts = [data[at + OVERHEAD : at + OVERHEAD + units[size] * UNIT] for at, size in zip(stream.offsets, stream.sizes)]
    return b"".join(parts), int(stream.tags["TXXX:payload"])


def feature(s: Stream) -> str:
    """Equal streams have equal features; the last part digests all offsets."""
    offsets = zlib.crc32(np.array(s.offsets, np.int64).tobytes())
    return f"mp3 frames={len(s.offsets)} samples={s.samples} hz={s.hertz} us={s.samples * 1_000_000 // s.hertz if s.hertz else 0} table={s.table}:{s.table_frames}:{s.table_bytes} crc={s.checked - s.failed}/{s.checked} skipped={s.skipped} offsets={offsets:08x}"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for i in range(0, batch.num_rows, 1024):
            n = min(1024, batch.num_rows - i)
            media = [pack(data[offsets[k] : offsets[k + 1]].tobytes()) for k in range(i, i + n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), pa.array(media, pa.binary())], ["doc_id", "media"])


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media: the stored form of each text, a null one as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.transform(arrow, _encode, "doc_id long, media binary")


SCANNED = "doc_id long, frames long, samples long, hertz int, seconds double, vbr_table string, crc_checked long, crc_failed long, skipped_bytes long, seek_offsets array<long>"


def _scan_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [scan(m or b"") for m in batch.column("media").to_pylist()]
        columns = [[len(s.offsets) for s in found], [s.samples for s in found], pa.array([s.hertz for s in found], pa.int32()), [s.seconds for s in found], [s.table or None for s in found], [s.checked for s in found], [s.failed for s in found], [s.skipped for s in found], pa.array([s.offsets for s in found], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(x if isinstance(x, pa.Array) else pa.array(x, pa.string() if k == 4 else None) for k, x in enumerate(columns))], [f.split()[0] for f in SCANNED.split(", ")])


def scan_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Durations, checks and the seek offset of every frame for each stream.

    Null, empty and unreadable media have no frames.
    """
    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).transform(arrow, _scan_all, SCANNED)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, seek_offsets array<long>"


def _digest_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in DIGEST.split(", ")]
    for batch in batches:
        rows = []
        for media in batch.column("media").to_pylist():
            s = scan(media)
            payload, size = unpack(media, s)
            rows.append((size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), s.seconds, s.offsets))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names)


def text_media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every text, read the stored bytes back and digest both.

    One row for each row of ``docs``; equal texts have equal values.
    """
    return encode_texts(docs, id_col, text_col).transform(arrow, _digest_all, DIGEST)
