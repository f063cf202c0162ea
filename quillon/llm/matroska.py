"""Media columns: Matroska. Parsing of EBML elements into packet tables, and a small writer.

``parse`` reads variable-length ids and sizes, walks segments and clusters of known or unknown size, undoes Xiph, fixed
and EBML lacing, and gives one row per frame with its track, timestamp and byte range, beside the tracks and cues.
Packets' times are nanoseconds by the file's scale, and whole milliseconds of them; within a laced block by its duration,
else the track's default one, else the length of PCM samples, else unknown (null). Cues and the duration stay in ticks.
``mux`` stores bytes losslessly as 8-bit samples in an audio track, frames of 192 samples laced into blocks.

Edge cases: a null text is stored as one padded frame, as an empty one is; equal texts give equal files; nothing in a
file depends on other rows; damaged or cut files raise ValueError; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from itertools import accumulate
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
NUMBER, UID, TYPE, LACING, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE, GROUP, BLOCK, BLOCK_DURATION, DEFAULT_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0x23E383
POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}

FRAME, RATE_HZ, FRAME_MS = 192, 8000, 24
#: Frames in a block and blocks in a cluster; a block's time is 16 bits from its cluster's.
LACED, BLOCKS = 16, 32


class Packet(NamedTuple):
    track: int
    timestamp: int | None
    offset: int
    size: int
    cluster: int
    keyframe: bool
    time_ns: int | None


class Media(NamedTuple):
    tracks: list[dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    clusters: list[int]
    scale: int
    duration: float


def vint(data, at: int, keep: bool = False) -> tuple[int, int]:
    """A variable-length number and where it ends; ``keep``: with its length mark, as ids have it. -1: unknown size."""
    if at >= len(data):
        raise ValueError("cut off")
    first = data[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > len(data):
        raise ValueError(f"no element at {at}")
    value = int.from_bytes(data[at : at + n], "big")
    if keep:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def size_bytes(n: int, length: int = 0) -> bytes:
    length = length or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], how: str) -> tuple[int, bytes]:
    """Flag bits and body of a block's frames."""
    if how == "none" or len(frames) == 1:
        if len(frames) > 1:
            raise ValueError("several frames need lacing")
        return 0, frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if how == "fixed":
        if len(set(sizes)) > 1:
            raise ValueError("fixed lacing needs equal sizes")
        return 0x04, head + b"".join(frames)
    if how == "xiph":
        return 0x02, head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1]) + b"".join(frames)
    out = head + size_bytes(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        d = b - a
        k = next(k for k in range(1, 9) if abs(d) < (1 << 7 * k - 1) - 1)
        out += size_bytes(d + (1 << 7 * k - 1) - 1, k)
    return 0x06, out + b"".join(frames)


def mux(payload: bytes, how: str = "fixed", laced: int = LACED, blocks: int = BLOCKS) -> bytes:
    """A file with one track of 8-bit samples that holds the payload, whose length is a multiple of 192."""
    if len(payload) % FRAME or not payload:
        raise ValueError("the payload isn't whole frames")
    laced = 1 if how == "none" else laced
    count = len(payload) // FRAME
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", count * FRAME_MS)) + element(MUXER, b"quillon") + element(WRITER, b"quillon"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", RATE_HZ)) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(TYPE, 2) + number(LACING, int(how != "none")) + number(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    for first in range(0, count, laced * blocks):
        parts = [number(TIMESTAMP, first * FRAME_MS)]
        for b in range(first, min(count, first + laced * blocks), laced):
            frames = [payload[i * FRAME : (i + 1) * FRAME] for i in range(b, min(count, b + laced, first + laced * blocks))]
            flags, data = lace(frames, how)
            parts.append(element(SIMPLE, b"\x81" + struct.pack(">hB", (b - first) * FRAME_MS, 0x80 | flags) + data))
        cues.append(element(POINT, number(CUE_TIME, first * FRAME_MS) + element(POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(c := element(CLUSTER, b"".join(parts)))
        at += len(c)
    body.append(element(CUES, b"".join(cues)))
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ, 2))
    return head + element(SEGMENT, b"".join(body))


def children(data, at: int, end: int):
    """Id, start and end of the body of each element in a range; an unknown size reaches to the next top element or the end."""
    while at < end:
        kind, body = vint(data, at, True)
        n, body = vint(data, body)
        if n < 0:
            stop = body
            if kind == CLUSTER:
                while stop < end:
                    k, b = vint(data, stop, True)
                    if k in TOP:
                        break
                    m, b = vint(data, b)
                    if m < 0:
                        raise ValueError("nested unknown sizes")
                    stop = b + m
            else:
                stop = end
        else:
            stop = body + n
        if stop > end:
            raise ValueError("an element passes its parent's end")
        yield kind, body, stop
        at = stop


def uint(data, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def real(data, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def frames_of(data, at: int, end: int) -> tuple[int, int, bool, list[tuple[int, int]]]:
    """Track, relative time, keyframe flag and byte ranges of the frames of a block."""
    track, at = vint(data, at)
    if at + 3 > end:
        raise ValueError("cut block")
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    how = flags >> 1 & 3
    if not how:
        return track, time, bool(flags & 0x80), [(at, end - at)]
    n = data[at] + 1
    at += 1
    if how == 2:
        each, rest = divmod(end - at, n)
        if rest:
            raise ValueError("fixed lacing of unequal frames")
        return track, time, bool(flags & 0x80), [(at + i * each, each) for i in range(n)]
    sizes: list[int] = []
    if how == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for i in range(n - 1):
            start = at
            value, at = vint(data, at)
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * (at - start) - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames pass the block's end")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, time, bool(flags & 0x80), out


def times(start: int, sizes: list[int], length: int | None, track: dict) -> list[int | None]:
    """When the frames of a block start, in nanoseconds, from the block's time and its length if it has one."""
    n, each = len(sizes), track.get("default_ns", 0)
    if n == 1 or length is not None:
        return [start + i * (length or 0) // n for i in range(n)]
    if each:
        return [start + i * each for i in range(n)]
    bits = track["rate"] * track["channels"] * track["depth"] if track.get("codec", "").startswith("A_PCM/") else 0
    if bits:
        return [start + round(8e9 * before / bits) for before in accumulate(sizes[:-1], initial=0)]
    return [start, *[None] * (n - 1)]


def parse(data: bytes) -> Media:
    """The tables of a file; ValueError if it is damaged or cut off."""
    try:
        return read(data)
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError(f"damaged file: {e!r}") from e


def read(data: bytes) -> Media:
    tracks: list[dict] = []
    by_number: dict[int, dict] = {}
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    clusters: list[int] = []
    scale, duration = 1_000_000, 0.0
    top = list(children(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML head")
    for kind, a, b in top:
        if kind != SEGMENT:
            continue
        # what the times of packets depend on first, wherever it stands
        for k, c, d in sorted(children(data, a, b), key=lambda x: x[0] not in (INFO, TRACKS)):
            if k == INFO:
                for x, e, f in children(data, c, d):
                    scale = uint(data, e, f) if x == SCALE else scale
                    duration = real(data, e, f) if x == DURATION else duration
            elif k == TRACKS:
                for x, e, f in children(data, c, d):
                    if x == TRACK:
                        t: dict = {"number": 0, "type": 0, "codec": "", "rate": 0.0, "channels": 1, "depth": 0, "default_ns": 0}
                        for y, g, h in children(data, e, f):
                            if y in (NUMBER, TYPE):
                                t["number" if y == NUMBER else "type"] = uint(data, g, h)
                            elif y == DEFAULT_DURATION:
                                t["default_ns"] = uint(data, g, h)
                            elif y == CODEC:
                                t["codec"] = bytes(data[g:h]).decode("ascii", "replace")
                            elif y == AUDIO:
                                for z, i, j in children(data, g, h):
                                    if z == RATE:
                                        t["rate"] = real(data, i, j)
                                    elif z in (CHANNELS, DEPTH):
                                        t["channels" if z == CHANNELS else "depth"] = uint(data, i, j)
                        tracks.append(t)
                        by_number[t["number"]] = t
            elif k == CLUSTER:
                base, number_of = 0, len(clusters)
                clusters.append(c)
                for x, e, f in children(data, c, d):
                    if x == TIMESTAMP:
                        base = uint(data, e, f)
                        continue
                    length = None
                    if x == GROUP:
                        inner = {y: (g, h) for y, g, h in children(data, e, f)}
                        if BLOCK not in inner:
                            continue
                        if BLOCK_DURATION in inner:
                            length = uint(data, *inner[BLOCK_DURATION])
                        e, f = inner[BLOCK]
                    elif x != SIMPLE:
                        continue
                    track, time, key, ranges = frames_of(data, e, f)
                    at_ns = times((base + time) * scale, [n for _, n in ranges], length if length is None else length * scale, by_number.get(track, {}))
                    packets += [Packet(track, None if t is None else t // 1_000_000, o, n, number_of, key, t) for (o, n), t in zip(ranges, at_ns, strict=True)]
            elif k == CUES:
                for x, e, f in children(data, c, d):
                    if x == POINT:
                        inner = {y: (g, h) for y, g, h in children(data, e, f)}
                        for y, g, h in children(data, e, f):
                            if y == POSITIONS:
                                at = {z: uint(data, i, j) for z, i, j in children(data, g, h)}
                                cues.append((uint(data, *inner[CUE_TIME]), at.get(CUE_TRACK, 0), a + at.get(CUE_CLUSTER, 0)))
    return Media(tracks, packets, cues, clusters, scale, duration)


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    """The bytes of a track's frames, in file order."""
    return b"".join([data[p.offset : p.offset + p.size] for p in media.packets if p.track == track])


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, and its payload: with spaces up to a positive multiple of a frame."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % FRAME if raw else FRAME)


def stored(text: str | None) -> tuple:
    """A text stored as media, read back, and the features of what was read."""
    n, payload = padded(text)
    data = mux(payload)
    media = parse(data)
    back = payload_of(data, media)
    samples = np.frombuffer(back, np.uint8)
    t = media.tracks[0]
    first, last = media.packets[0], media.packets[-1]
    feature = f"codec={t['codec']};rate={t['rate']:.0f};depth={t['depth']};clusters={len(media.clusters)};cues={len(media.cues)};packets={len(media.packets)};first_ms={first.timestamp};last_ms={last.timestamp};duration_ms={media.duration:.0f};mean={samples.mean():.4f};peak={int(samples.max())}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature


def _work():
    return lambda texts: [stored(x) for x in texts]



def _muxed():
    return lambda texts: [(mux(padded(x)[1]),) for x in texts]


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, media``: each text as a file in a binary column."""
    return map_texts(docs, _muxed, "media binary", key, text)


def media_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` with lengths, digests and features of every text stored as media and read back."""
    return map_texts(docs, _work, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", key, text)


def packet_table(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per packet of every file in a binary column: track, timestamp (ms), byte range, cluster, keyframe, time in nanoseconds."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        names = [key, *Packet._fields]
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                rows = parse(data).packets if data else []
                for a in range(0, len(rows), 100_000):
                    part = rows[a : a + 100_000]
                    cols = list(zip(*part, strict=True))
                    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()]
                    keys = pa.array([batch.column(0)[i].as_py()] * len(part), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return files.select(F.col(key), F.col(media)).mapInArrow(run, f"`{key}` {kind}, track int, timestamp long, offset long, size long, cluster int, keyframe boolean, time_ns long")
