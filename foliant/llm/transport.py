"""Media columns as MPEG transport streams: written from texts, parsed back, described.

Writing: a text's UTF-8 bytes, zero-padded to a positive multiple of 64, are 8-bit samples at 8000 a second. Each second
is an access unit in an elementary packet with a presentation time stamp; every fourth unit, the first included, is a
random-access point, marked and given a clock reference in its adaptation field, with the program tables before it.

Reading: the association table names the map table and that names the elementary stream; table checksums and each
PID's continuity counters are checked, elementary packets are reassembled from their payloads, and of every unit its
time stamp, its place and whether it is a random-access point are kept.

Nulls: a null text counts as empty, so its payload is 64 zero bytes; a null media value is read as null results.
Repeated rows and equal texts have equal streams; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm.common import by_slices

# Fixed values of ISO/IEC 13818-1, and those chosen here (PIDs, stream type, rate).
PACKET, SYNC, CLOCK = 188, 0x47, 90_000
PID_TABLES, PID_MAP, PID_STREAM = 0x0000, 0x1000, 0x0100
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
RATE, POINT_EVERY, PAD = 8_000, 4, 64


@functools.cache
def crc_table() -> np.ndarray:
    out = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1) ^ (0x04C11DB7 if value & 0x80000000 else 0)
        out.append(value & 0xFFFFFFFF)
    return np.array(out, np.uint32)


@functools.lru_cache(64)
def crc(data: bytes) -> int:
    value, table = 0xFFFFFFFF, crc_table()
    for byte in data:
        value = (value << 8 & 0xFFFFFFFF) ^ int(table[(value >> 24) ^ byte])
    return value


def table_packet(pid: int, table_id: int, extension: int, body: bytes) -> bytes:
    """A packet with one whole section, counter 0."""
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\0\0"
    section = head + body
    section += crc(section).to_bytes(4, "big")
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


@functools.cache
def tables() -> bytes:
    association = table_packet(PID_TABLES, 0x00, 1, b"\0\1" + (0xE000 | PID_MAP).to_bytes(2, "big"))
    stream = bytes([STREAM_TYPE]) + (0xE000 | PID_STREAM).to_bytes(2, "big") + b"\xf0\0"
    return association + table_packet(PID_MAP, 0x02, 1, (0xE000 | PID_STREAM).to_bytes(2, "big") + b"\xf0\0" + stream)


class Layout(NamedTuple):
    """The packets of a unit of so many samples: all bytes that don't depend on what it holds, and where the rest goes."""

    bytes: np.ndarray
    samples: np.ndarray
    stamp: np.ndarray
    reference: np.ndarray
    packets: np.ndarray


@functools.lru_cache(maxsize=512)
def layout(samples: int, point: bool) -> Layout:
    head = b"\0\0\1" + bytes([STREAM_ID]) + (8 + samples).to_bytes(2, "big") + b"\x84\x80\x05" + b"\0" * 5
    left, out, body, reference, first = len(head) + samples, [], [], [], True
    before = PACKET * (2 if point else 0)
    while left:
        field = bytes([7, 0x50]) + b"\0" * 6 if first and point else b""
        room = PACKET - 4 - len(field)
        if left < room:  # stuffing goes into the adaptation field
            more = room - left
            if field:
                field = bytes([7 + more]) + field[1:] + b"\xff" * more
            else:
                field = bytes([more - 1]) + (b"\0" + b"\xff" * (more - 2) if more > 1 else b"")
            room = left
        at = before + len(out) * PACKET
        out.append((bytes([SYNC, (0x40 if first else 0) | PID_STREAM >> 8, PID_STREAM & 0xFF, 0x30 if field else 0x10]) + field).ljust(PACKET, b"\0"))
        if first and point:
            reference = [at + 6 + k for k in range(6)]
        body += range(at + PACKET - room, at + PACKET)
        left, first = left - room, False
    grid = np.frombuffer((tables() if point else b"") + b"".join(out), np.uint8).copy()
    body = np.array(body)
    grid[body[: len(head)]] = np.frombuffer(head, np.uint8)
    return Layout(grid, body[len(head) :], body[9:14], np.array(reference, np.int64), before + PACKET * np.arange(len(out)))


def stamp_bytes(ticks: int) -> list[int]:
    return [0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1]


def write_stream(payload: bytes) -> bytes:
    data, out, counter, point_number = np.frombuffer(payload, np.uint8), [], 0, 0
    for k, at in enumerate(range(0, len(data), RATE)):
        part, point = data[at : at + RATE], k % POINT_EVERY == 0
        plan = layout(len(part), point)
        unit = plan.bytes.copy()
        unit[plan.samples] = part
        ticks = (CLOCK + k * CLOCK) % 2**33
        unit[plan.stamp] = stamp_bytes(ticks)
        unit[plan.packets + 3] |= ((counter + np.arange(len(plan.packets))) % 16).astype(np.uint8)
        counter += len(plan.packets)
        if point:
            base = ticks - CLOCK // 10
            unit[plan.reference] = list((base << 15 | 0x7E00).to_bytes(6, "big"))
            unit[[3, PACKET + 3]] |= np.uint8(point_number % 16)
            point_number += 1
        out.append(unit.tobytes())
    return b"".join(out)


class Stream(NamedTuple):
    payload: bytes
    packets: int
    broken: int  # continuity counters that don't follow
    stamps: np.ndarray
    starts: np.ndarray  # of each unit in the payload
    points: np.ndarray  # whether a unit is a random-access point
    first_packets: np.ndarray


class Damaged(ValueError):
    pass


def section(packet: np.ndarray, table_id: int) -> bytes:
    raw = packet.tobytes()
    at = 5 + raw[4] if raw[3] & 0x20 else 4
    at += 1 + raw[at]  # the pointer field
    size = 3 + (int.from_bytes(raw[at + 1 : at + 3], "big") & 0x0FFF)
    whole = raw[at : at + size]
    if whole[0] != table_id or len(whole) != size or crc(whole[:-4]) != int.from_bytes(whole[-4:], "big"):
        raise Damaged("a program table is broken")
    return whole[8:-4]


def parsed(media: bytes) -> Stream:
    if not media or len(media) % PACKET:
        raise Damaged("not whole packets")
    grid = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (grid[:, 0] != SYNC).any():
        raise Damaged("synchronisation is lost")
    pid = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    begins, control, counter = grid[:, 1] & 0x40 > 0, grid[:, 3] & 0x30, grid[:, 3] & 0x0F
    program = next((section(grid[k], 0x00) for k in np.flatnonzero((pid == PID_TABLES) & begins)[:1]), None)
    if program is None:
        raise Damaged("no association table")
    map_pid = int.from_bytes(program[2:4], "big") & 0x1FFF
    where = np.flatnonzero((pid == map_pid) & begins)[:1]
    if not len(where):
        raise Damaged("no map table")
    listed = section(grid[where[0]], 0x02)
    stream_pid = int.from_bytes(listed[5 + (int.from_bytes(listed[2:4], "big") & 0x0FFF) :][:2], "big") & 0x1FFF
    broken = 0
    for p in (PID_TABLES, map_pid, stream_pid):
        rows = np.flatnonzero((pid == p) & (control & 0x10 > 0))
        # a packet may be sent twice, as it is and with the same counter; the second one is passed over
        twice = np.flatnonzero(counter[rows[1:]] == counter[rows[:-1]]) + 1
        rows = np.delete(rows, twice[(grid[rows[twice]] == grid[rows[twice - 1]]).all(1)])
        own = counter[rows].astype(np.int16)
        broken += int(((own[1:] - own[:-1]) % 16 != 1).sum())
    own, has_field = grid[rows], control[rows] & 0x20 > 0
    start = np.where(has_field, 5 + own[:, 4].astype(np.int64), 4)
    flags = np.where(has_field & (own[:, 4] > 0), own[:, 5], 0)
    data = own[np.arange(PACKET)[None, :] >= start[:, None]]
    at = np.cumsum(PACKET - start) - (PACKET - start)
    opening = begins[rows]
    heads = at[opening]
    if not len(heads) or heads[0]:
        raise Damaged("no elementary packet begins")
    if (data[heads] != 0).any() or (data[heads + 1] != 0).any() or (data[heads + 2] != 1).any() or (data[heads + 7] & 0x80 == 0).any():
        raise Damaged("an elementary packet has no start code or time stamp")
    sizes = data[heads + 4].astype(np.int64) << 8 | data[heads + 5]
    skip = 9 + data[heads + 8].astype(np.int64)
    t = data[heads[:, None] + np.arange(9, 14)].astype(np.int64)
    stamps = (t[:, 0] >> 1 & 7) << 30 | t[:, 1] << 22 | t[:, 2] >> 1 << 15 | t[:, 3] << 7 | t[:, 4] >> 1
    parts = [data[h + s : h + 6 + n] for h, s, n in zip(heads.tolist(), skip.tolist(), sizes.tolist(), strict=True)]
    lengths = np.array([len(p) for p in parts])
    if (lengths != sizes + 6 - skip).any():
        raise Damaged("an elementary packet is cut short")
    return Stream(np.concatenate(parts).tobytes(), len(grid), broken, stamps, np.cumsum(lengths) - lengths, flags[opening] & 0x40 > 0, rows[opening])


def read_stream(media: bytes) -> Stream:
    try:
        return parsed(media)
    except (IndexError, ValueError) as e:
        raise e if isinstance(e, Damaged) else Damaged("a packet is cut short") from e


def feature(s: Stream) -> str:
    """Packets, broken counters, units, random-access points, first and last stamp, sum of the samples, and how many are in each eighth of their range."""
    samples = np.frombuffer(s.payload, np.uint8)
    bins = np.bincount(samples >> 5, minlength=8)
    return (
        f"packets={s.packets};broken={s.broken};units={len(s.stamps)};points={int(s.points.sum())};"
        f"stamps={s.stamps[0]}-{s.stamps[-1]};sum={int(samples.sum(dtype=np.int64))};bins={','.join(map(str, bins.tolist()))}"
    )


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_bytes (of the text) and `media`, the stream."""

    def work(keys: list, texts: list[str]) -> pa.RecordBatch:
        raw = [t.encode() for t in texts]
        media = [write_stream(r.ljust(max(PAD, -(-len(r) // PAD) * PAD), b"\0")) for r in raw]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(by_slices(work), "doc_id long, n_bytes long, media binary")


def _read(batch: pa.RecordBatch, columns) -> pa.RecordBatch:
    """Streams that can't be read have null in all columns and the reason in `error`."""
    streams, errors = [], []
    for m in batch.column("media").to_pylist():
        try:
            streams.append(None if m is None else (m, read_stream(m)))
            errors.append("there is no stream" if m is None else "continuity counters are broken" if streams[-1][1].broken else None)
        except Damaged as e:
            streams.append(None)
            errors.append(str(e))
    fields = [(name, kind, [None if x is None else get(*x) for x in streams]) for name, kind, get in columns]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(v, k) for _, k, v in fields], pa.array(errors, pa.string())], names=["doc_id", "n_bytes", *[n for n, _, _ in fields], "error"])


def _mapped(media: DataFrame, columns, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield _read(batch.slice(at, 500), columns)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def units(media: DataFrame) -> DataFrame:
    """Of each stream its units: arrays of time stamps, places in the payload, first packets and random-access marks."""
    kinds = pa.list_(pa.int64())
    columns = [
        ("stamps", kinds, lambda m, s: s.stamps.tolist()),
        ("starts", kinds, lambda m, s: s.starts.tolist()),
        ("first_packets", kinds, lambda m, s: s.first_packets.tolist()),
        ("points", pa.list_(pa.bool_()), lambda m, s: s.points.tolist()),
    ]
    return _mapped(media, columns, "doc_id long, n_bytes long, stamps array<long>, starts array<long>, first_packets array<long>, points array<boolean>, error string")


def described(media: DataFrame) -> DataFrame:
    """Reads the stored streams back: digests of payload and stream, and the feature."""
    columns = [
        ("payload_bytes", pa.int64(), lambda m, s: len(s.payload)),
        ("payload_sha256", pa.string(), lambda m, s: hashlib.sha256(s.payload).hexdigest()),
        ("tail_crc32", pa.int64(), lambda m, s: zlib.crc32(s.payload[-PAD:])),
        ("media_bytes", pa.int64(), lambda m, s: len(m)),
        ("media_sha256", pa.string(), lambda m, s: hashlib.sha256(m).hexdigest()),
        ("feature", pa.string(), lambda m, s: feature(s)),
    ]
    return _mapped(media, columns, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
