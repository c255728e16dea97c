"""Media columns: MPEG transport streams, written and read back.

A payload is carried in private-data elementary packets (PES) of one program.
The stream is a program association table, a program map table, then for each
elementary packet its transport packets: the first has a random-access point
and a program clock reference, the last is filled up with adaptation-field
stuffing.  The reader trusts only the bytes: it checks every sync byte, finds
the program map through the association table and the elementary stream
through the map (both with their CRC), checks continuity counters, reassembles
the elementary packets and stores the timestamps and random-access points.

Special cases: a null text is the empty text (one unit of padding); a very long
text becomes as many elementary packets as it takes; repeated rows give repeated
results; an empty table gives an empty result; a damaged stream is read as far
as it goes and its faults are counted; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table

UNIT = 192
PACKET = 188
MAP_PID, DATA_PID = 0x1000, 0x0101
#: Payload bytes of one elementary packet; its header is 14 bytes.
ACCESS_UNIT = 65_000
TICKS = 3_600  # of the 90 kHz clock between elementary packets
FIRST_TIME = 90_000


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        r = i << 24
        for _ in range(8):
            r = (r << 1) ^ 0x04C11DB7 if r & 0x80000000 else r << 1
        out.append(r & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    r = 0xFFFFFFFF
    for b in data:
        r = ((r << 8) & 0xFFFFFFFF) ^ _CRC[(r >> 24) ^ b]
    return r


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    n = len(body) + 9
    head = bytes([table_id, 0xB0 | n >> 8, n & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0, 1, bytes([0, 1, 0xE0 | MAP_PID >> 8, MAP_PID & 0xFF]))) + _table_packet(
    MAP_PID, _section(2, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0, 0x06, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0])))


def _stamp(marker: int, t: int) -> bytes:
    return bytes([marker << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 0xFF, (t >> 15 & 0x7F) << 1 | 1, t >> 7 & 0xFF, (t & 0x7F) << 1 | 1])


def write_stream(payload: bytes, unit: int = ACCESS_UNIT) -> bytes:
    """The transport stream that carries the payload."""
    out, counter = [np.frombuffer(_TABLES, np.uint8)], 0
    for k, lo in enumerate(range(0, len(payload), unit)):
        part, t = payload[lo : lo + unit], FIRST_TIME + TICKS * k
        n = len(part) + 8
        pes = np.frombuffer(b"\x00\x00\x01\xbd" + (n.to_bytes(2, "big") if n < 65536 else b"\0\0") + b"\x84\x80\x05" + _stamp(2, t) + part, np.uint8)
        first = 176  # beside 4 bytes of header and 8 of adaptation field
        count = 1 + max(0, -(-(len(pes) - first) // 184))
        packets = np.full((count, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(count)) % 16
        counter += count
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        clock = t - TICKS // 2
        head = bytes([7, 0x50, clock >> 25 & 0xFF, clock >> 17 & 0xFF, clock >> 9 & 0xFF, clock >> 1 & 0xFF, (clock & 1) << 7 | 0x7E, 0])
        packets[0, 4:12] = np.frombuffer(head, np.uint8)
        if count == 1:
            room = first - len(pes)
            packets[0, 4] = 7 + room
            packets[0, 12 + room :] = pes
        else:
            packets[0, 12:] = pes[:first]
            whole = (len(pes) - first) // 184
            packets[1 : 1 + whole, 4:] = pes[first : first + 184 * whole].reshape(whole, 184)
            if rest := pes[first + 184 * whole :].tobytes():
                room = 184 - len(rest)  # 1 at least: the length byte
                packets[-1, 3] |= 0x20
                packets[-1, 4] = room - 1
                if room > 1:
                    packets[-1, 5] = 0
                packets[-1, 4 + room :] = np.frombuffer(rest, np.uint8)
        out.append(packets.ravel())
    return np.concatenate(out).tobytes()


@dataclass
class Stream:
    """What the reader found."""

    packets: int = 0
    programs: list[int] = field(default_factory=list)
    pids: list[int] = field(default_factory=list)
    sync_errors: int = 0
    continuity_errors: int = 0
    crc_errors: int = 0
    broken_units: int = 0
    payload: bytes = b""
    times: list[int] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # packet numbers


def _read_section(packet: np.ndarray, found: Stream) -> bytes:
    """The body of a section that starts in this packet, without its CRC."""
    b = packet.tobytes()
    at = 4 if not b[3] & 0x20 else 5 + b[4]
    at += 1 + b[at]
    n = 3 + ((b[at + 1] & 0x0F) << 8 | b[at + 2])
    section = b[at : at + n]
    if len(section) < n or n < 12 or section_crc(section):
        found.crc_errors += 1
        return b""
    return section[:-4]


def read_stream(data: bytes) -> Stream:
    found = Stream()
    raw = np.frombuffer(data, np.uint8)
    p = raw[: len(raw) // PACKET * PACKET].reshape(-1, PACKET)
    found.packets = len(p)
    good = p[:, 0] == 0x47
    found.sync_errors = int((~good).sum()) + (len(raw) % PACKET > 0)
    number = np.flatnonzero(good)
    p = p[good]
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    starts = (p[:, 1] & 0x40) > 0
    maps: dict[int, int] = {}
    for i in np.flatnonzero((pid == 0) & starts):
        s = _read_section(p[i], found)
        for at in range(8, len(s) - 3, 4):
            program = s[at] << 8 | s[at + 1]
            if program:
                maps[(s[at + 2] & 0x1F) << 8 | s[at + 3]] = program
    found.programs = sorted(maps.values())
    data_pids: list[int] = []
    for m in sorted(maps):
        for i in np.flatnonzero((pid == m) & starts):
            s = _read_section(p[i], found)
            at = 12 + ((s[10] & 0x0F) << 8 | s[11]) if s else 0
            while s and at + 5 <= len(s):
                data_pids.append((s[at + 1] & 0x1F) << 8 | s[at + 2])
                at += 5 + ((s[at + 3] & 0x0F) << 8 | s[at + 4])
    found.pids = sorted(set(data_pids))
    parts: list[bytes] = []
    for one in found.pids:
        mine = np.flatnonzero(pid == one)
        q = p[mine]
        if not len(q):
            continue
        has_payload, has_field = (q[:, 3] & 0x10) > 0, (q[:, 3] & 0x20) > 0
        counter = q[has_payload, 3] & 0x0F
        found.continuity_errors += int((((counter[1:].astype(np.int16) - counter[:-1]) & 0x0F) != 1).sum())
        size = np.where(has_field, q[:, 4].astype(np.int32) + 1, 0)
        flagged = has_field & (size > 1)
        found.random_access += number[mine[flagged & ((q[:, 5] & 0x40) > 0)]].tolist()
        for i in np.flatnonzero(flagged & ((q[:, 5] & 0x10) > 0)):
            c = q[i, 6:11].astype(np.int64)
            found.clocks.append(int(c[0] << 25 | c[1] << 17 | c[2] << 9 | c[3] << 1 | c[4] >> 7))
        q, size = q[has_payload], size[has_payload]
        keep = np.arange(4, PACKET)[None, :] >= 4 + size[:, None]
        body = q[:, 4:][keep]
        at = np.concatenate([[0], np.cumsum(np.maximum(0, 184 - size))])
        heads = np.flatnonzero((q[:, 1] & 0x40) > 0)
        bounds = [*at[heads], len(body)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            unit = body[lo:hi].tobytes()
            if len(unit) < 9 or unit[:3] != b"\0\0\1":
                found.broken_units += 1
                continue
            n = unit[4] << 8 | unit[5]
            if n and n + 6 != len(unit):
                found.broken_units += 1
            if unit[7] & 0x80 and len(unit) >= 14:
                t = unit[9:14]
                found.times.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
            parts.append(unit[9 + unit[8] : n + 6 if n else None])
    found.payload = b"".join(parts)
    return found


def padded(text: bytes, unit: int = UNIT) -> bytes:
    return text + b" " * (-len(text) % unit or (0 if text else unit))


def feature(s: Stream) -> str:
    faults = s.sync_errors + s.continuity_errors + s.crc_errors + s.broken_units
    times = f"{s.times[0]}-{s.times[-1]}" if s.times else "none"
    return f"ts packets={s.packets} programs={len(s.programs)} streams={len(s.pids)} units={len(s.times)} rap={len(s.random_access)} pts={times} faults={faults}"


def media_columns(docs: DataFrame, text: str = "text", key: str = "doc_id", with_media: bool = False) -> DataFrame:
    """Store every text as a transport stream and read it back: doc_id,
    n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, pts (array), random_access (array of packet
    numbers) and, on demand, the stream itself."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = []
                for text in batch.column(1).slice(lo, 64):
                    raw = (text.as_py() or "").encode()
                    media = write_stream(padded(raw))
                    s = read_stream(media)
                    rows.append((len(raw), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), s.times, s.random_access, *[media] * with_media))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 64), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    import pyarrow as pa

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access", *["media"] * with_media]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * with_media]
    schema = f"doc_id {dict(docs.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>" + ", media binary" * with_media
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def op7_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
