"""Media columns: texts carried in MPEG transport streams.

A payload is cut into access units. Each travels in one PES packet with a presentation timestamp,
split over 188-byte transport packets; a program association table and a program map table come
first. Reading back parses the tables, checks continuity counters, reassembles the PES packets and
lists the units' timestamps, offsets and random-access flags.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, STREAM_PID, PROGRAM = 0, 0x1000, 0x100, 1
#: Private data in PES packets (ISO/IEC 13818-1): its stream type and its stream id.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
UNIT_BYTES = 4096
#: Every so many units one is marked as a point where reading may begin.
RANDOM_ACCESS_EVERY = 8
#: A unit lasts 1/25 s of the 90 kHz clock, and is shown 1/10 s after its packets begin.
UNIT_TICKS, DELAY_TICKS = 3600, 9000
#: Packets of this PID are stuffing.
NULL_PID = 0x1FFF
PAD = 64


def crc32_mpeg(data: bytes) -> int:
    """The CRC of program tables: polynomial 0x04C11DB7, most significant bit first."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
        crc &= 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _head(pid: int, start: bool, adapted: bool, counter: int) -> bytes:
    return bytes([SYNC, start << 6 | pid >> 8, pid & 255, (0x30 if adapted else 0x10) | counter & 15])


@cache
def program_tables() -> bytes:
    """The two packets with the program association and program map tables."""
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    stream = bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)
    return b"".join((_head(pid, True, False, 0) + b"\x00" + table).ljust(PACKET, b"\xff") for pid, table in ((PAT_PID, pat), (PMT_PID, pmt)))


def _pts(ticks: int) -> bytes:
    return bytes([0x21 | ticks >> 29 & 14, ticks >> 22 & 255, ticks >> 14 & 254 | 1, ticks >> 7 & 255, ticks << 1 & 254 | 1])


def _ticks(b: bytes) -> int:
    return (b[0] & 14) << 29 | b[1] << 22 | (b[2] & 254) << 14 | b[3] << 7 | b[4] >> 1


def _clock(ticks: int) -> bytes:
    """A program clock reference without an extension."""
    return (ticks << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    packets, counter = [program_tables()], 0
    for unit, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        data = payload[at : at + UNIT_BYTES]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _pts((unit * UNIT_TICKS + DELAY_TICKS) % 2**33) + data
        flags = 0x50 if unit % RANDOM_ACCESS_EVERY == 0 else 0x10
        done = min(176, len(pes))
        stuffing = 176 - done
        packets.append(_head(STREAM_PID, True, True, counter) + bytes([7 + stuffing, flags]) + _clock(unit * UNIT_TICKS % 2**33) + b"\xff" * stuffing + pes[:done])
        counter += 1
        while done < len(pes):
            left = len(pes) - done
            if left >= 184:
                packets.append(_head(STREAM_PID, False, False, counter) + pes[done : done + 184])
            else:
                field = 183 - left  # length of the adaptation field, which fills the packet up
                packets.append(_head(STREAM_PID, False, True, counter) + bytes([field]) + (b"\x00" + b"\xff" * (field - 1) if field else b"") + pes[done:])
            done += 184
            counter += 1
    return b"".join(packets)


class Packet(NamedTuple):
    """A transport packet's payload, whether a unit or section starts in it, and its random-access flag."""

    pid: int
    start: bool
    random: bool
    payload: bytes


def packets(stream: bytes) -> Iterator[Packet]:
    """The packets that carry something, in order; continuity counters are checked on the way.

    Stuffing packets and packets of an adaptation field alone count for nothing; a packet may be sent
    twice; a jump is allowed where the stream announces it.
    """
    if len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    last: dict[int, tuple[int, bytes | None]] = {}
    for at in range(0, len(stream), PACKET):
        if stream[at] != SYNC:
            raise ValueError("lost synchronisation")
        pid, control = (stream[at + 1] & 31) << 8 | stream[at + 2], stream[at + 3]
        if pid == NULL_PID:
            continue
        begin, flags = at + 4, 0
        if control & 0x20:
            flags = stream[begin + 1] if stream[begin] else 0
            begin += 1 + stream[begin]
        if not control & 0x10:
            continue
        counter, payload = control & 15, stream[begin : at + PACKET]
        if pid in last and not flags & 0x80:
            before, own = last[pid]
            if counter == before and payload == own:
                last[pid] = counter, None  # a second copy may follow, not a third
                continue
            if counter != (before + 1) & 15:
                raise ValueError(f"packets of PID {pid} are missing")
        last[pid] = counter, payload
        yield Packet(pid, bool(stream[at + 1] & 0x40), bool(flags & 0x40), payload)


class Sections:
    """Program table sections of one PID, which may span packets or share one."""

    def __init__(self) -> None:
        self.held: bytes | None = None

    def feed(self, packet: Packet) -> Iterator[bytes]:
        """The sections that are whole with this packet."""
        payload = packet.payload
        if packet.start:
            begin = 1 + payload[0]
            if self.held is not None:
                self.held += payload[1:begin]
                yield from self._whole()
            self.held = payload[begin:]
        elif self.held is not None:
            self.held += payload
        yield from self._whole()

    def _whole(self) -> Iterator[bytes]:
        while self.held and len(self.held) >= 3 and self.held[0] != 0xFF:
            size = 3 + ((self.held[1] & 15) << 8 | self.held[2])
            if len(self.held) < size:
                return
            section, self.held = self.held[:size], self.held[size:]
            if crc32_mpeg(section):
                raise ValueError("damaged program table")
            yield section


def _programs(section: bytes) -> dict[int, int]:
    """Program numbers and the PIDs of their maps; the network table (number 0) isn't one."""
    entries = [section[i : i + 4] for i in range(8, len(section) - 4, 4)] if section[0] == 0 else []
    return {n: (e[2] & 31) << 8 | e[3] for e in entries if (n := int.from_bytes(e[:2], "big"))}


def _streams(section: bytes) -> list[tuple[int, int]]:
    """Stream types and PIDs of a program map."""
    found, i = [], 12 + ((section[10] & 15) << 8 | section[11])
    while section[0] == 2 and i < len(section) - 4:
        found.append((section[i], (section[i + 1] & 31) << 8 | section[i + 2]))
        i += 5 + ((section[i + 3] & 15) << 8 | section[i + 4])
    return found


def _unit(pes: bytes) -> tuple[int | None, bytes]:
    """The timestamp (None without one) and the data of an elementary packet."""
    size = int.from_bytes(pes[4:6], "big")
    if pes[:3] != b"\x00\x00\x01" or (size and len(pes) != 6 + size):
        raise ValueError("damaged elementary packet")
    return _ticks(pes[9:14]) if pes[7] & 0x80 else None, pes[9 + pes[8] :]


def demux(stream: bytes, program: int | None = None, stream_type: int = STREAM_TYPE) -> tuple[bytes, list[tuple[int | None, int, bool]], dict[str, int]]:
    """Payload, (timestamp, offset, random access) of each unit, and packet statistics.

    Read are the first stream of ``stream_type`` of ``program``, or of the first program of the
    association table. Raises ValueError for lost packets (a gap in a continuity counter), damaged
    tables or elementary packets.
    """
    association, maps, map_pid, stream_pid = Sections(), Sections(), None, None
    units: list[tuple[list[bytes], bool]] = []
    for packet in packets(stream):
        if packet.pid == stream_pid:
            if packet.start:
                units.append(([], packet.random))
            if units:
                units[-1][0].append(packet.payload)
        elif packet.pid == PAT_PID:
            for section in association.feed(packet):
                known = _programs(section)
                if map_pid is None and known:
                    map_pid = known.get(program) if program is not None else next(iter(known.values()))
        elif packet.pid == map_pid and stream_pid is None:
            for section in maps.feed(packet):
                stream_pid = next((pid for kind, pid in _streams(section) if kind == stream_type), stream_pid)
    payload, index, offset = [], [], 0
    for parts, random in units:
        ticks, data = _unit(b"".join(parts))
        index.append((ticks, offset, random))
        payload.append(data)
        offset += len(data)
    return b"".join(payload), index, {"packets": len(stream) // PACKET, "units": len(units)}


def pad(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % PAD if data else PAD)


def write_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8) and media (the transport stream of the padded text).

    A null text is an empty one; repeated rows and null ids stay; an empty table gives no rows;
    other columns are ignored. The longest text is held in memory once, in the task that has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = [(x or "").encode() for x in part.column(1).to_pylist()]
                media = pa.array([mux(pad(x)) for x in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload, and the index of units (timestamp, offset, random_access) of each stream.

    One row per row of ``media``; a stream that is damaged or lacks packets raises ValueError.
    """
    units = pa.list_(pa.struct([("timestamp", pa.int64()), ("offset", pa.int64()), ("random_access", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                read = [demux(x) for x in part.column(2).to_pylist()]
                index = [[{"timestamp": t, "offset": o, "random_access": r} for t, o, r in units] for _, units, _ in read]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([x[0] for x in read], pa.binary()), pa.array(index, units)],
                    names=["doc_id", "n_bytes", "payload", "units"],
                )

    schema = "doc_id long, n_bytes long, payload binary, units array<struct<timestamp:long,offset:long,random_access:boolean>>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def _features(media: bytes) -> tuple[int, str, int, int, str, str]:
    payload, units, counts = demux(media)
    points = [t for t, _, random in units if random]
    feature = f"packets={counts['packets']};units={counts['units']};pts={units[0][0]}-{units[-1][0]};random_access={len(points)};last_point={points[-1]}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_digests(media: DataFrame) -> DataFrame:
    """Digests and features of what ``write_media`` stored, from its bytes as read back.

    Null texts were stored as 64 zero bytes; repeated rows and null ids stay; equal texts have
    equal streams, for nothing but the text enters them; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_features(x.as_py()) for x in batch.column(2)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
