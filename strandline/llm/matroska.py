"""Matroska files in binary columns: written, and parsed into packet tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.support import small_batches, table

# Element ids of the container format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, MUXER, WRITER = 0x2AD7B1, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, DEFAULT_DURATION, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0x9C
TRACK_SCALE, ENCODINGS = 0x23314F, 0x6D80
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}
LACES = {0: "none", 2: "xiph", 4: "fixed", 6: "ebml"}


class Malformed(ValueError):
    """The bytes aren't a Matroska file."""


def read_vint(data, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """A variable-length integer and the place after it; with the marker it is an element id. All ones: -1, unknown."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no integer at {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise Malformed(f"cut off at {at}")
    value = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return value, at + n
    value ^= 1 << (7 * n)
    return (-1 if value == (1 << (7 * n)) - 1 else value), at + n


def write_vint(value: int) -> bytes:
    n = 1
    while value >= (1 << (7 * n)) - 1:
        n += 1
    return (value | 1 << (7 * n)).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + write_vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def children(data, at: int, end: int, siblings: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, first byte, end) of each element. One of unknown size ends where a sibling starts or its parent ends.

    A segment or a cluster that is cut off is given as far as it goes, and the fault follows.
    """
    while at < end:
        ident, body = read_vint(data, at, True)
        size, body = read_vint(data, body)
        if size < 0:
            stop = end
            if ident == CLUSTER:
                at2 = body
                while at2 < end:
                    inner, b2 = read_vint(data, at2, True)
                    if inner in siblings:
                        break
                    s2, b2 = read_vint(data, b2)
                    if s2 < 0:
                        raise Malformed("unknown size inside a cluster")
                    at2 = b2 + s2
                stop = at2
        else:
            stop = body + size
        if stop > end and ident not in (SEGMENT, CLUSTER):
            raise Malformed(f"element at {at} ends beyond its parent")
        yield ident, body, min(stop, end)
        if stop > end:
            raise Malformed(f"element at {at} ends beyond its parent")
        at = stop


def until_fault(elements: Iterator[tuple[int, int, int]], faults: list[Malformed]) -> Iterator[tuple[int, int, int]]:
    """The elements before a fault, which is put aside."""
    try:
        yield from elements
    except Malformed as fault:
        faults.append(fault)


@dataclass(frozen=True)
class Track:
    number: int
    kind: int
    codec: str
    default_duration: int
    #: what the times of its blocks, but not of clusters, are multiplied by
    scale: float
    #: compressed, encrypted or stripped of headers
    encoded: bool


PACKET = ["track", "codec", "cluster", "block", "lacing", "frame", "timestamp_ns", "duration_ns", "keyframe", "cued", "start", "length", "encoded"]


def laced(data, at: int, end: int, flags: int) -> list[tuple[int, int]]:
    """(start, length) of the frames of a block whose payload begins at ``at``."""
    lace = flags & 6
    if not lace:
        return [(at, end - at)]
    if at >= end:
        raise Malformed("no frame count")
    n, at, sizes = data[at] + 1, at + 1, []
    if lace == 4:
        if (end - at) % n:
            raise Malformed("frames of a fixed lace differ")
        sizes = [(end - at) // n] * n
    elif lace == 2:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Malformed("cut off lace")
                byte, at = data[at], at + 1
                size += byte
                if byte < 255:
                    break
            sizes.append(size)
        sizes.append(-1)
    else:
        for k in range(n - 1):
            width = 9 - data[at].bit_length() if at < end and data[at] else 0
            value, at = read_vint(data, at)
            value = (1 << (7 * width)) - 1 if value < 0 else value
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << (7 * width - 1)) - 1))
        sizes.append(-1)
    if sizes[-1] < 0:
        sizes[-1] = end - at - sum(sizes[:-1])
    if min(sizes) < 0 or at + sum(sizes) != end:
        raise Malformed("lace sizes don't fill the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def packets(data: bytes) -> Iterator[tuple]:
    """Frames in file order, as tuples of ``PACKET``. ``cluster`` and ``block`` are the places of their elements' bodies.

    ``timestamp_ns`` is the block's time, plus default durations for later frames of a lace (None where the track has no
    default duration). ``cued``: a cue points to the cluster at the block's time for the track. ``encoded``: the track
    has content encodings, which have to be undone on the bytes of the range. Of a file that breaks off or is damaged
    the frames before the fault come first, then ``Malformed`` is raised.
    """
    faults: list[Malformed] = []

    def uint(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    top = list(until_fault(children(data, 0, len(data), {EBML, SEGMENT}), faults))
    if not top or top[0][0] != EBML:
        raise Malformed("no EBML header")
    for ident, seg, seg_end in top:
        if ident != SEGMENT:
            continue
        scale, tracks, cues, clusters = 1_000_000, {}, set(), []
        for kind, a, b in until_fault(children(data, seg, seg_end, TOP), faults):
            if kind == INFO:
                for x, p, q in children(data, a, b):
                    if x == TIMESTAMP_SCALE:
                        scale = uint(p, q)
            elif kind == TRACKS:
                for x, p, q in children(data, a, b):
                    if x == TRACK_ENTRY:
                        got = {y: data[r:s] for y, r, s in children(data, p, q)}
                        num = lambda k: int.from_bytes(got.get(k, b""), "big")
                        tracks[num(TRACK_NUMBER)] = Track(num(TRACK_NUMBER), num(TRACK_TYPE), got.get(CODEC, b"").rstrip(b"\0").decode("ascii", "replace"), num(DEFAULT_DURATION), _float(got.get(TRACK_SCALE, b"")), ENCODINGS in got)
            elif kind == CUES:
                for x, p, q in children(data, a, b):
                    if x == CUE_POINT:
                        inside = list(children(data, p, q))
                        time = next((uint(r, s) for y, r, s in inside if y == CUE_TIME), 0)
                        for y, r, s in inside:
                            if y == CUE_POSITIONS:
                                got = {z: uint(t, u) for z, t, u in children(data, r, s)}
                                cues.add((got.get(CUE_TRACK), time, seg + got.get(CUE_CLUSTER, -1)))
            elif kind == CLUSTER:
                clusters.append((a, b))
        for a, b in clusters:
            time, head = 0, a - 8
            # a cue holds the place of the cluster's id, whose four bytes come before the size
            head = next((h for h in range(a - 5, max(a - 13, seg) - 1, -1) if uint(h, h + 4) == CLUSTER), a)
            for x, p, q in until_fault(children(data, a, b), faults):
                if x == CLUSTER_TIME:
                    time = uint(p, q)
                    continue
                length, key = None, None
                if x == BLOCK_GROUP:
                    inside = {y: (r, s) for y, r, s in children(data, p, q)}
                    if BLOCK not in inside:
                        continue
                    key, length = REFERENCE not in inside, uint(*inside[BLOCK_DURATION]) if BLOCK_DURATION in inside else None
                    p, q = inside[BLOCK]
                elif x != SIMPLE_BLOCK:
                    continue
                track, at = read_vint(data, p)
                if at + 3 > q:
                    raise Malformed("cut off block")
                relative, flags = struct.unpack_from(">hB", data, at)
                key = bool(flags & 0x80) if key is None else key
                known = tracks.get(track)
                each = (known.default_duration or None) if known else None
                frames = laced(data, at + 3, q, flags)
                if length is not None:
                    each = length * scale // len(frames)
                begin = (time + relative) * scale if known is None or known.scale == 1 else time * scale + round(relative * scale * known.scale)
                cued = (track, time + relative, head) in cues
                for i, (start, n) in enumerate(frames):
                    stamp = begin + i * each if each else (None if i else begin)
                    yield track, known.codec if known else None, a, p, LACES[flags & 6], i, stamp, each, key, cued and not i, start, n, known is not None and known.encoded
    if faults:
        raise faults[0]


def _float(data: bytes) -> float:
    return struct.unpack(">f" if len(data) == 4 else ">d", data)[0] if len(data) in (4, 8) else 1.0


RATE_HZ, FRAME, LACE, BLOCKS = 8000, 1920, 8, 16


def mux_samples(payload: bytes) -> bytes:
    """8-bit mono samples as a file: laced blocks (the three laces in turn) in clusters, with cues. Equal input, equal output."""
    frame_ns, scale = FRAME * 10**9 // RATE_HZ, 10**6
    header = element(EBML, b"".join([number(VERSION, 1), number(READ_VERSION, 1), number(MAX_ID, 4), number(MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), number(DOC_VERSION, 4), number(DOC_READ, 2)]))
    info = element(INFO, number(TIMESTAMP_SCALE, scale) + element(MUXER, b"strandline") + element(WRITER, b"strandline"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", float(RATE_HZ))) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + number(DEFAULT_DURATION, frame_ns) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    out, cues = [info, tracks], []
    at, step = len(info) + len(tracks), FRAME * LACE
    for c in range(0, len(payload), step * BLOCKS):
        time, blocks = c * 1000 // RATE_HZ, []
        for k, p in enumerate(range(c, min(c + step * BLOCKS, len(payload)), step)):
            part = payload[p : p + step]
            sizes = [min(FRAME, len(part) - i) for i in range(0, len(part), FRAME)]
            lace = 0 if len(sizes) == 1 else (4, 6, 2)[k % 3]
            if lace == 4 and sizes[-1] != FRAME:
                lace = 6
            head = b""
            if lace == 6:
                head = write_vint(sizes[0]) + b"".join(_signed(b - a) for a, b in zip(sizes, sizes[1:-1]))
            elif lace == 2:
                head = b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
            count = bytes([len(sizes) - 1]) if lace else b""
            relative = p * 1000 // RATE_HZ - time
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", relative, 0x80 | lace) + count + head + part))
        cluster = element(CLUSTER, number(CLUSTER_TIME, time) + b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        out.append(cluster)
        at += len(cluster)
    return header + element(SEGMENT, b"".join(out) + element(CUES, b"".join(cues)))


def _signed(value: int) -> bytes:
    """A difference of lace sizes: the shortest width whose range, moved by its half, holds it."""
    n = 1
    while not -((1 << (7 * n - 1)) - 1) < value < (1 << (7 * n - 1)) - 1:
        n += 1
    return ((value + (1 << (7 * n - 1)) - 1) | 1 << (7 * n)).to_bytes(n, "big")


PACKET_DDL = "track bigint, codec string, cluster bigint, block bigint, lacing string, frame int, timestamp_ns bigint, duration_ns bigint, keyframe boolean, cued boolean, start bigint, length bigint, encoded boolean"
PACKET_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame: ``id`` and the columns of ``PACKET``; ``start`` and ``length`` are its byte range in the file.

    Rows that aren't Matroska give one row whose ``error`` says why, after the frames found before the fault; null gives
    none, and so does a file without frames. Output goes out in small batches, so a long file needs no more memory than
    its bytes. Rows that repeat give their packets again.
    """
    plain = media.select(F.col(id_col).cast("string").alias("id"), F.col(media_col).cast("binary").alias("media"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["id", *PACKET, "error"], [pa.string(), *PACKET_TYPES, pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

        for got in batches:
            rows = []
            for ident, data in zip(got.column(0).to_pylist(), got.column(1)):
                if not data.is_valid:
                    continue
                try:
                    for packet in packets(data.as_py()):
                        rows.append((ident, *packet, None))
                        if len(rows) >= 10_000:
                            yield batch(rows)
                            rows = []
                except Malformed as fault:
                    rows.append((ident, *[None] * len(PACKET), str(fault)))
            if rows:
                yield batch(rows)

    return plain.transform(small_batches).mapInArrow(parse, f"id string, {PACKET_DDL}, error string")


def feature(samples: bytes) -> str:
    """Sum, energy, crossings of the middle and the highest sample, all whole numbers."""
    x = np.frombuffer(samples, dtype=np.uint8)
    up = x >= 128
    return f"sum={int(x.sum(dtype=np.int64))};energy={int(np.square(x.astype(np.int32) - 128).sum(dtype=np.int64))};crossings={int(np.count_nonzero(up[1:] != up[:-1]))};peak={int(x.max(initial=0))}"


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_packets bigint, last_ns bigint"
UNIT = 192


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as samples of a Matroska file, read back through its packets.

    The text's UTF-8 bytes (null: none) are padded with spaces to a positive multiple of 192 and muxed; everything that
    is returned but ``n_bytes`` comes from the parsed packets' byte ranges or from the file. One text is held at a time.
    Equal texts give equal values, whatever the id; rows that repeat are kept; an empty table gives an empty result.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FEATURES.split(", ")]
        for got in batches:
            rows = []
            for ident, text in zip(got.column(0).to_pylist(), got.column(1).cast(pa.binary())):
                raw = text.as_py() or b""
                media = mux_samples(raw + b" " * (UNIT - len(raw) if not raw else -len(raw) % UNIT))
                found = list(packets(media))
                view = memoryview(media)
                back = b"".join(view[p[10] : p[10] + p[11]] for p in found)
                rows.append((ident, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(back), len(found), found[-1][6]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for n, c in zip(names, zip(*rows))], names=names)

    return plain.transform(small_batches).mapInArrow(run, FEATURES)


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
