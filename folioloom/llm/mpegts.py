"""MPEG transport streams in media columns: multiplexing, and reading with checks.

``encode`` stores a payload as the elementary stream of a one-programme transport
stream: 188-byte packets, a programme association and a programme map table before
each random-access point, access units of at most ``UNIT`` bytes in packetised
elementary packets with timestamps, continuity counters on every PID, and a clock
reference with the random-access flag on the first unit of every group.

``demux`` reads any such bytes back. It checks the sync byte of each packet, parses
the tables (with their CRC), checks continuity counters, drops repeated packets,
reassembles elementary packets per stream, and lists each access unit with its
presentation and decoding time, offset, size and random-access flag. Faults are
counted and don't stop the reading: a gap's unit is kept as far as it came.

Defined results: a null or empty payload is stored as one unit of padding; null
media gives null results; bytes that are no transport stream give a row with no
streams and ``sync_errors``; repeated rows and ties have equal results; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import prepare, released, text_or_empty

PACKET = 188
BLOCK = 576
UNIT = 8 * BLOCK
GROUP = 12
TICKS = 3600
FIRST_PTS = 63000
PID_PMT, PID_ES = 0x1000, 0x0100
STREAM_TYPE = 0x06  # private data in elementary packets
STREAM_ID = 0xBD
FILL = 255

#: Bytes of a batch that the Python functions give back at a time.
_OUT = 8 << 20


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if c >> 31 else c << 1
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    """A table section with its header and CRC."""
    rest = number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    head = bytes([table_id]) + (0xB000 | len(rest) + 4).to_bytes(2, "big")
    return head + rest + crc32_mpeg(head + rest).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    body = b"\x00" + section
    return bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10]) + body + b"\xff" * (PACKET - 4 - len(body))


_PAT = _table_packet(0, _section(0, 1, b"\x00\x01" + (0xE000 | PID_PMT).to_bytes(2, "big")))
_PMT = _table_packet(PID_PMT, _section(2, 1, (0xE000 | PID_ES).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | PID_ES).to_bytes(2, "big") + b"\xf0\x00"))


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def mux(payload: bytes, unit: int = UNIT, group: int = GROUP) -> bytes:
    """A transport stream that carries ``payload`` as its one elementary stream."""
    out: list[bytes] = []
    counter = tables = 0
    for i, at in enumerate(range(0, len(payload), unit)):
        data = payload[at : at + unit]
        pts = (FIRST_PTS + i * TICKS) & (1 << 33) - 1
        access = i % group == 0
        if access:
            for packet in (_PAT, _PMT):
                out.append(packet[:3] + bytes([0x10 | tables & 15]) + packet[4:])
            tables += 1
        head = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, pts)
        pes = head + data
        field_ = b""
        if access:
            base = max(0, pts - TICKS)
            field_ = bytes([7, 0x50, base >> 25 & 255, base >> 17 & 255, base >> 9 & 255, base >> 1 & 255, (base & 1) << 7 | 0x7E, 0])
        room = PACKET - 4 - len(field_)
        first = pes[:room]
        if len(first) < room:  # one packet holds it all: stuffing
            field_, first = _stuffed(field_, room - len(first)), first
        out.append(bytes([0x47, 0x40 | PID_ES >> 8, PID_ES & 255, (0x30 if field_ else 0x10) | counter & 15]) + field_ + first)
        counter += 1
        whole, rest = divmod(len(pes) - len(first), PACKET - 4)
        if whole:
            packets = np.empty((whole, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, PID_ES >> 8, PID_ES & 255
            packets[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            packets[:, 4:] = np.frombuffer(pes, np.uint8, whole * (PACKET - 4), len(first)).reshape(whole, -1)
            out.append(packets.tobytes())
            counter += whole
        if rest:
            out.append(bytes([0x47, PID_ES >> 8, PID_ES & 255, 0x30 | counter & 15]) + _stuffed(b"", PACKET - 4 - rest) + pes[len(pes) - rest :])
            counter += 1
    return b"".join(out)


def _stuffed(field_: bytes, n: int) -> bytes:
    """An adaptation field that is ``n`` bytes longer."""
    if field_:
        return bytes([field_[0] + n]) + field_[1:] + b"\xff" * n
    return b"\x00" if n == 1 else bytes([n - 1, 0]) + b"\xff" * (n - 2)


@dataclass
class Unit:
    pts: int | None
    dts: int | None
    start: int
    size: int
    random_access: bool


@dataclass
class Stream:
    program: int
    pid: int
    stream_type: int
    data: bytes = b""
    units: list[Unit] = field(default_factory=list)


@dataclass
class Media:
    packets: int = 0
    sync_errors: int = 0
    continuity_errors: int = 0
    repeated: int = 0
    crc_errors: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: list[Stream] = field(default_factory=list)


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _sections(rows: np.ndarray, start: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """Sections of a table's PID; a section may run over several packets."""
    out, held = [], b""
    for row, s, begin in zip(rows, start, begins, strict=True):
        body = row[s:].tobytes()
        if begin and body:
            pointer = body[0]
            if held:
                out.append(held + body[1 : 1 + pointer])
            held = body[1 + pointer :]
        elif held:
            held += body
        while len(held) >= 3 and held[0] != 0xFF:
            n = 3 + ((held[1] & 15) << 8 | held[2])
            if len(held) < n:
                break
            out.append(held[:n])
            held = held[n:]
        if held[:1] == b"\xff":
            held = b""
    return [s for s in out if len(s) >= 12]


def demux(media: bytes) -> Media:
    """Programmes, streams with their bytes and access units, and fault counts of a transport stream."""
    n = len(media) // PACKET
    out = Media(packets=n)
    a = np.frombuffer(media, np.uint8, n * PACKET).reshape(n, PACKET)
    good = (a[:, 0] == 0x47) & (a[:, 1] & 0x80 == 0)
    out.sync_errors = int(n - good.sum()) + (len(media) % PACKET > 0)
    a = a[good]
    pid = (a[:, 1].astype(np.int32) & 0x1F) << 8 | a[:, 2]
    begin = a[:, 1] & 0x40 > 0
    control, counter = a[:, 3] >> 4 & 3, a[:, 3] & 15
    has_field, has_data = control & 2 > 0, control & 1 > 0
    length = np.where(has_field, a[:, 4], 0).astype(np.int32)
    flags = np.where(has_field & (length > 0), a[:, 5], 0)
    start = np.where(has_field, 5 + length, 4)
    has_data &= start <= PACKET

    def of(which: int) -> np.ndarray:
        """Rows of a PID that carry data, without repeated packets; counts counter faults."""
        at = np.flatnonzero((pid == which) & has_data)
        if len(at) < 2:
            return at
        step = (counter[at[1:]].astype(np.int16) - counter[at[:-1]]) & 15
        marked = flags[at[1:]] & 0x80 > 0
        again = np.zeros(len(at), bool)
        for i in np.flatnonzero((step == 0) & ~marked) + 1:
            again[i] = bool((a[at[i], 4:] == a[at[i - 1], 4:]).all())
        out.repeated += int(again.sum())
        out.continuity_errors += int(((step != 1) & ~marked & ~again[1:]).sum())
        return at[~again]

    def tables(which: int, table_id: int) -> list[bytes]:
        at, found = of(which), {}
        for s in _sections(a[at], start[at], begin[at]):
            if s[0] != table_id:
                continue
            if crc32_mpeg(s):
                out.crc_errors += 1
            else:
                found[s] = None
        return list(found)

    for s in tables(0, 0):
        for i in range(8, len(s) - 4, 4):
            if number := int.from_bytes(s[i : i + 2], "big"):
                out.programs[number] = int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF
    known: set[int] = set()
    for number, map_pid in out.programs.items():
        for s in tables(map_pid, 2):
            i = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while i + 5 <= len(s) - 4:
                es = int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF
                if es not in known:
                    known.add(es)
                    out.streams.append(Stream(number, es, s[i]))
                i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0xFFF)
    for stream in out.streams:
        _elementary(stream, a, of(stream.pid), start, begin, flags)
    return out


def _elementary(stream: Stream, a: np.ndarray, at: np.ndarray, start: np.ndarray, begin: np.ndarray, flags: np.ndarray) -> None:
    rows, s = a[at], start[at]
    sizes = PACKET - s
    data = rows[np.arange(PACKET) >= s[:, None]].tobytes()
    ends = np.cumsum(sizes)
    firsts = np.flatnonzero(begin[at])
    offsets = (ends - sizes)[firsts].tolist()
    access = (flags[at][firsts] & 0x40 > 0).tolist()
    parts, total = [], 0
    for i, o in enumerate(offsets):
        pes = data[o : offsets[i + 1] if i + 1 < len(offsets) else len(data)]
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
            continue
        told = int.from_bytes(pes[4:6], "big")
        if told:
            pes = pes[: 6 + told]
        body = pes[9 + pes[8] :]
        which = pes[7] >> 6
        pts = _time(pes[9:14]) if which & 2 and len(pes) >= 14 else None
        dts = _time(pes[14:19]) if which == 3 and len(pes) >= 19 else pts
        stream.units.append(Unit(pts, dts, total, len(body), access[i]))
        parts.append(body)
        total += len(body)
    stream.data = b"".join(parts)


def padded(payload: bytes, block: int = BLOCK, fill: int = FILL) -> bytes:
    """``payload`` with fill bytes up to a positive multiple of ``block``."""
    n = max(1, -(-len(payload) // block)) * block
    return payload + bytes([fill]) * (n - len(payload))


def _batches(rows, names, kinds):
    """Arrow batches of about _OUT bytes; rows gives (bytes, values)."""
    import pyarrow as pa

    held: list[list] = [[] for _ in names]
    size = 0
    for weight, values in rows:
        for column, v in zip(held, values, strict=True):
            column.append(v)
        size += weight
        if size >= _OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names=names)
            held, size = [[] for _ in names], 0
    if held[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names=names)


def _encode(batches):
    import pyarrow as pa

    for batch in released(batches):
        ids, payloads = batch.column(0), batch.column(1)
        rows = ((len(m), (k.as_py(), n, m)) for k, p in zip(ids, payloads, strict=True) for raw in (p.as_py() or b"",) for n, m in ((len(raw), mux(padded(raw))),))
        yield from _batches(rows, ["key", "n_bytes", "media"], [ids.type, pa.int64(), pa.binary()])


def encode(spark: SparkSession, df: DataFrame, key: str = "doc_id", payload: Column | None = None) -> DataFrame:
    """key, n_bytes and ``media``, the transport stream of each row's payload (UTF-8 of ``text`` if none is given)."""
    prepare(spark)
    kind = df.schema[key].dataType.simpleString()
    source = F.encode(text_or_empty(), "UTF-8") if payload is None else payload
    return df.select(F.col(key).alias("key"), source.alias("payload")).mapInArrow(_encode, f"key {kind}, n_bytes bigint, media binary").withColumnRenamed("key", key)


_STREAM = "array<struct<program:int,pid:int,stream_type:int,payload:binary,units:array<struct<pts:bigint,dts:bigint,start:bigint,size:bigint,random_access:boolean>>>>"


def _parse(batches):
    import pyarrow as pa

    units = pa.list_(pa.struct([("pts", pa.int64()), ("dts", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("random_access", pa.bool_())]))
    streams = pa.list_(pa.struct([("program", pa.int32()), ("pid", pa.int32()), ("stream_type", pa.int32()), ("payload", pa.binary()), ("units", units)]))
    names = ["key", "n_bytes", "media", "packets", "sync_errors", "continuity_errors", "repeated", "crc_errors", "streams"]

    def one(k, n, raw):
        if raw is None:
            return 0, (k, n, None, None, None, None, None, None, None)
        m = demux(raw)
        found = [{"program": s.program, "pid": s.pid, "stream_type": s.stream_type, "payload": s.data, "units": [vars(u) for u in s.units]} for s in m.streams]
        return 2 * len(raw), (k, n, raw, m.packets, m.sync_errors, m.continuity_errors, m.repeated, m.crc_errors, found)

    for batch in released(batches):
        ids, n, media = batch.columns
        rows = (one(k.as_py(), c.as_py(), m.as_py()) for k, c, m in zip(ids, n, media, strict=True))
        yield from _batches(rows, names, [ids.type, pa.int64(), pa.binary(), *[pa.int64()] * 5, streams])


def parse(spark: SparkSession, df: DataFrame, key: str = "doc_id", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """Each row's media with its fault counts and streams: payload and access units of each."""
    prepare(spark)
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes bigint, media binary, packets bigint, sync_errors bigint, continuity_errors bigint, repeated bigint, crc_errors bigint, streams {_STREAM}"
    chosen = df.select(F.col(key).alias("key"), F.col(n_bytes).alias("n_bytes"), F.col(media).alias("media"))
    return chosen.mapInArrow(_parse, schema).withColumnRenamed("key", key)
