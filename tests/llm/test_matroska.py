import hashlib
import random
import struct
import zlib

import pytest

from strandline.llm import matroska as m
from tests.llm.helpers import clashing, tricky


@pytest.mark.parametrize("n", [192, 1920, 1920 * 8, 1920 * 8 + 192, 1920 * 8 * 3 + 1728, 1920 * 8 * 16, 1920 * 8 * 40 + 960])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    media = m.mux_samples(payload)
    found = list(m.packets(media))
    assert b"".join(media[p[10] : p[10] + p[11]] for p in found) == payload
    done = 0
    for p in found:  # each frame's time is that of its first sample
        assert p[6] == done * 10**9 // 8000 and p[0] == 1 and p[1] == "A_PCM/INT/LIT"
        done += p[11]
    clusters = {p[2] for p in found}
    assert sum(p[9] for p in found) == len(clusters)  # a cue for each cluster's first block


def test_all_laces():
    found = list(m.packets(m.mux_samples(bytes(1920 * 8 * 5))))
    assert {p[4] for p in found} == {"fixed", "ebml", "xiph"}


@pytest.mark.parametrize("sizes", [[5], [300, 300, 1], [0, 700, 255, 254], [1, 90_000, 2, 8], [64, 127, 1, 63, 64, 20_000, 5]])
@pytest.mark.parametrize("lace", [2, 6])
def test_laces_by_hand(sizes, lace):
    if len(sizes) == 1:
        assert m.laced(b"12345", 0, 5, 0) == [(0, 5)]
        return
    if lace == 6:
        head = m.write_vint(sizes[0]) + b"".join(m._signed(b - a) for a, b in zip(sizes, sizes[1:-1]))
    else:
        head = b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    data = bytes([len(sizes) - 1]) + head + bytes(sum(sizes))
    assert [n for _, n in m.laced(data, 0, len(data), lace)] == sizes


def test_unknown_sizes_groups_and_faults():
    def block(track, rel, flags, body):
        return m.write_vint(track) + struct.pack(">hB", rel, flags) + body

    unknown = b"\x01" + b"\xff" * 7
    tracks = m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, 300) + m.number(m.TRACK_TYPE, 1) + m.element(m.CODEC, b"V_X")))
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block(300, -5, 0, b"abc")) + m.number(m.BLOCK_DURATION, 40) + m.element(m.REFERENCE, b"\x01"))
    one = m.CLUSTER.to_bytes(4, "big") + unknown + m.number(m.CLUSTER_TIME, 100) + group
    two = m.CLUSTER.to_bytes(4, "big") + unknown + m.number(m.CLUSTER_TIME, 200) + m.element(m.SIMPLE_BLOCK, block(300, 7, 0x80, b"defg"))
    media = m.element(m.EBML, m.element(m.DOC_TYPE, b"webm")) + m.SEGMENT.to_bytes(4, "big") + unknown + tracks + one + two
    found = list(m.packets(media))
    assert [media[p[10] : p[10] + p[11]] for p in found] == [b"abc", b"defg"]
    assert [(p[0], p[6], p[7], p[8]) for p in found] == [(300, 95 * 10**6, 40 * 10**6, False), (300, 207 * 10**6, None, True)]
    for bad in (b"", b"RIFF....", media[:-2], b"\x00" * 9):
        with pytest.raises(m.Malformed):
            list(m.packets(bad))


def plain_walk(data):
    """The frames of a file with known sizes, by another reading of the format: bit strings and recursion."""

    def number(at, drop):
        bits = format(data[at], "08b")
        n = bits.index("1") + 1
        whole = "".join(format(b, "08b") for b in data[at : at + n])
        return int(whole[n:] if drop else whole, 2), at + n

    def elements(at, end):
        while at < end:
            ident, at = number(at, False)
            size, at = number(at, True)
            yield ident, data[at : at + size]
            at += size

    out = []
    for ident, body in elements(0, len(data)):
        if ident in (0x18538067, 0x1F43B675):
            out += plain_walk(body)
        elif ident == 0xA3:
            flags, rest = body[3], body[4:]
            if flags & 6 == 0:
                out.append(rest)
                continue
            n, rest = rest[0] + 1, rest[1:]
            sizes = []
            if flags & 6 == 4:
                sizes = [len(rest) // n] * (n - 1)
            while len(sizes) < n - 1:
                if flags & 6 == 2:
                    size = 0
                    while rest[0] == 255:
                        size, rest = size + 255, rest[1:]
                    sizes.append(size + rest[0])
                    rest = rest[1:]
                else:
                    k = format(rest[0], "08b").index("1") + 1
                    value = int("".join(format(b, "08b") for b in rest[:k])[k:], 2)
                    sizes.append(sizes[-1] + value - (2 ** (7 * k - 1) - 1) if sizes else value)
                    rest = rest[k:]
            for size in sizes:
                out.append(rest[:size])
                rest = rest[size:]
            out.append(rest)
    return out


@pytest.mark.parametrize("n", [192, 1920 * 8 * 7 + 192 * 3, 1920 * 8 * 33])
def test_against_another_reading(n):
    payload = random.Random(n).randbytes(n)
    media = m.mux_samples(payload)
    frames = plain_walk(media)
    assert b"".join(frames) == payload
    assert [media[p[10] : p[10] + p[11]] for p in m.packets(media)] == frames


def read_before_fault(data):
    out = []
    try:
        for p in m.packets(data):
            out.append(p)
    except m.Malformed:
        return out, True
    return out, False


def test_files_that_break_off():
    media = m.mux_samples(random.Random(3).randbytes(1920 * 8 * 40))
    whole = list(m.packets(media))
    r = random.Random(4)
    for cut in [1, 10, 5000, *(r.randrange(len(media) - 200) for _ in range(40))]:
        got, fault = read_before_fault(media[:-cut])
        assert fault
        # all packets of blocks that are there; cues are at the end of the file, and gone
        there = [p[:9] + (False,) + p[10:] for p in whole if max(q[10] + q[11] for q in whole if q[3] == p[3]) <= len(media) - cut]
        assert [p[:9] + (False,) + p[10:] for p in got] == there
    damaged = bytearray(media)
    at = next(p for p in whole if p[2] > 10**5)[3]
    damaged[at - 20 : at] = bytes(20)
    got, fault = read_before_fault(bytes(damaged))
    assert fault and len(got) > 50


def test_encodings_and_scales_of_tracks():
    track = m.number(m.TRACK_NUMBER, 1) + m.element(m.CODEC, b"V_X") + m.element(m.TRACK_SCALE, struct.pack(">f", 0.5)) + m.element(m.ENCODINGS, b"")
    other = m.number(m.TRACK_NUMBER, 2) + m.element(m.CODEC, b"V_Y")
    blocks = b"".join(m.element(m.SIMPLE_BLOCK, bytes([0x80 | k]) + struct.pack(">hB", 40, 0x80) + b"body") for k in (1, 2))
    media = m.element(m.EBML, b"") + m.element(m.SEGMENT, m.element(m.TRACKS, m.element(m.TRACK_ENTRY, track) + m.element(m.TRACK_ENTRY, other)) + m.element(m.CLUSTER, m.number(m.CLUSTER_TIME, 100) + blocks))
    assert [(p[0], p[6], p[12]) for p in m.packets(media)] == [(1, 120 * 10**6, True), (2, 140 * 10**6, False)]


def plain_feature(samples):
    middle = [x >= 128 for x in samples]
    return f"sum={sum(samples)};energy={sum((x - 128) ** 2 for x in samples)};crossings={sum(a != b for a, b in zip(middle, middle[1:]))};peak={max(samples)}"


def test_packet_table(spark):
    good = m.mux_samples(bytes(range(192)) * 300)
    rows = [(1, good), (2, None), (3, b"junk"), (4, good), (4, good), (5, b""), (6, good[:-10])]
    got = m.packet_table(clashing(spark.createDataFrame(rows, "doc_id long, media binary"), ["id", "start", "error"])).collect()
    per = len(list(m.packets(good)))
    by = {i: [r for r in got if r.id == str(i)] for i in range(1, 7)}
    assert [len(by[i]) for i in range(1, 7)] == [per, 0, 1, 2 * per, 1, per + 1] and by[6][-1].error
    assert by[3][0].error and by[5][0].error and all(r.error is None for r in by[1])
    assert b"".join(good[r.start : r.start + r.length] for r in by[1]) == bytes(range(192)) * 300
    empty = m.packet_table(spark.createDataFrame([], "doc_id long, media binary"))
    assert empty.count() == 0


def test_features_of_odd_rows(spark):
    docs = clashing(tricky(spark), ["media", "n_bytes", "feature"])
    got = m.media_features(docs).collect()
    want = [(r.text or "").encode() for r in docs.collect()]
    assert len(got) == len(want)
    for r, raw in zip(got, want):
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.feature == plain_feature(payload)
        assert r.media_bytes == len(m.mux_samples(payload)) and r.media_sha256 == hashlib.sha256(m.mux_samples(payload)).hexdigest()
    assert m.media_features(docs.limit(0)).count() == 0
