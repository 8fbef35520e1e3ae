"""Media columns: MPEG transport streams in a binary column.

A payload is cut into access units, each in a packetised elementary stream (PES) packet with a
presentation time stamp, and spread over 188-byte transport packets with continuity counters.
Program tables and a clock reference stand at every random-access point. Reading goes the other way,
for streams made elsewhere too: program tables, over one packet or many, give the packet identifiers
of elementary streams of any type, counters are checked, elementary packets of stated or open length
are put together again, and time stamps are stored with the points at which a reader may start.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.arrow import with_arrow_columns

PACKET, BODY, SYNC = 188, 184, 0x47
UNIT = 192
"""Payloads are padded to a positive multiple of this many bytes."""
ACCESS_UNIT = 16 * UNIT
"""Payload bytes of one elementary packet."""
RANDOM_ACCESS_EVERY = 8
"""Every so many access units a reader may start."""
TICKS = 3003
"""Time between access units, in 90 kHz ticks."""
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x0100, 0x0101
PRIVATE_PES, PRIVATE_STREAM_1 = 0x06, 0xBD
NULL_PID = 0x1FFF
# Stream types that carry sections, not elementary packets; stream ids whose packets have no
# time stamps (program stream map, padding, private stream 2, ECM, EMM, DSM-CC, H.222.1 type E, directory).
SECTION_TYPES = {0x05, 0x0B, 0x0C, 0x0D, 0x86}
BARE_IDS = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}
PADDING = 0xBE
POINTS = "array<struct<pid:int,stream_type:int,pts:bigint,dts:bigint,packet:int,random_access:boolean,size:int>>"
CLOCKS = "array<struct<pid:int,packet:int,pcr:bigint>>"
COUNTS = ["packets", "programs", "streams", "elementary", "gaps", "broken", "discontinuities", "errors", "scrambled"]


@functools.cache
def crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        table.append(c)
    return table


@functools.lru_cache(4096)
def section_crc(section: bytes) -> int:
    """CRC of a program table section; 0 over a whole section with its own CRC."""
    c = 0xFFFFFFFF
    for byte in section:
        c = (c << 8 & 0xFFFFFFFF) ^ crc_table()[c >> 24 ^ byte]
    return c


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + section_crc(head + body).to_bytes(4, "big")


PAT = section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = section(0x02, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_PES]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0")


def time_stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E]) + (pts >> 14 & 0xFFFE | 1).to_bytes(2, "big") + (pts << 1 & 0xFFFE | 1).to_bytes(2, "big")


def read_time_stamp(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | (b[1] << 8 | b[2] & 0xFE) << 14 | (b[3] << 8 | b[4]) >> 1


def clock(pcr: int) -> bytes:
    """A program clock reference: 33 bits at 90 kHz, six reserved, nine at 27 MHz."""
    return (pcr // 300 << 15 | 0x3F << 9 | pcr % 300).to_bytes(6, "big")


def packet(pid: int, counter: int, start: bool, data: bytes, random_access: bool = False, pcr: int | None = None) -> bytes:
    """One transport packet; short data are filled up in the adaptation field."""
    room = BODY - len(data)
    if room == 0:
        adaptation = b""
    elif room == 1:
        adaptation = b"\0"
    else:
        fields = b"" if pcr is None else clock(pcr)
        adaptation = bytes([room - 1, 0x40 * random_access | 0x10 * (pcr is not None)]) + fields + b"\xff" * (room - 2 - len(fields))
    return bytes([SYNC, start << 6 | pid >> 8, pid & 0xFF, (0x30 if adaptation else 0x10) | counter & 15]) + adaptation + data


def mux(payload: bytes) -> bytes:
    """A transport stream that carries the payload."""
    out, counters = [], {PAT_PID: 0, PMT_PID: 0, DATA_PID: 0}

    def put(pid: int, start: bool, data: bytes, random_access: bool = False, pcr: int | None = None) -> None:
        out.append(packet(pid, counters[pid], start, data, random_access, pcr))
        counters[pid] += 1

    for n, at in enumerate(range(0, len(payload), ACCESS_UNIT)):
        unit = payload[at : at + ACCESS_UNIT]
        rap, ticks = n % RANDOM_ACCESS_EVERY == 0, n * TICKS & (1 << 33) - 1
        if rap:
            put(PAT_PID, True, (b"\0" + PAT).ljust(BODY, b"\xff"))
            put(PMT_PID, True, (b"\0" + PMT).ljust(BODY, b"\xff"))
        body = b"\x84\x80\x05" + time_stamp(ticks) + unit
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM_1]) + len(body).to_bytes(2, "big") + body
        first = BODY - 8 * rap
        put(DATA_PID, True, pes[:first], rap, ticks * 300 if rap else None)
        for k in range(first, len(pes), BODY):
            put(DATA_PID, False, pes[k : k + BODY])
    return b"".join(out)


class Demuxer:
    """Reads one stream: ``payload`` (of all elementary packets, stream by stream in order of their packet
    identifiers), ``points``, ``clocks`` and ``counts``.

    A gap in a counter, a broken elementary packet or section, lost synchronisation, and packets that are
    scrambled or marked as damaged are counted, never hidden. Packets sent twice, null packets and those
    of streams that no table names are passed over; a counter may jump where a discontinuity is announced.
    """

    def __init__(self, stream: bytes):
        self.counts = dict.fromkeys(COUNTS, 0)
        self.points: list[dict] = []
        self.clocks: list[dict] = []
        self.types: dict[int, int] = {}  # of elementary streams
        self.tables = {PAT_PID}
        self.partial: dict[int, bytes] = {}  # sections under way
        self.open: dict[int, list[bytes]] = {}  # elementary packets under way
        self.begun: dict[int, tuple[int, bool]] = {}
        self.data: dict[int, list[bytes]] = {}
        self.seen: dict[int, int] = {}
        self._read(stream)
        for pid in sorted(self.open):
            self._close(pid)
        self.points.sort(key=lambda p: (p["packet"], p["pid"]))
        self.counts["streams"] = len(self.types)
        self.payload = b"".join(b for pid in sorted(self.data) for b in self.data[pid])

    def _read(self, stream: bytes) -> None:
        counts, seen, at = self.counts, self.seen, 0
        while at + PACKET <= len(stream):
            if stream[at] != SYNC:
                counts["broken"] += 1
                at = stream.find(SYNC, at + 1)
                while 0 <= at and at + PACKET < len(stream) and stream[at + PACKET] != SYNC:
                    at = stream.find(SYNC, at + 1)
                if at < 0:
                    return
                continue
            number, begin, flags = counts["packets"], at, stream[at + 3]
            counts["packets"] += 1
            at += PACKET
            pid = (stream[begin + 1] & 0x1F) << 8 | stream[begin + 2]
            if stream[begin + 1] & 0x80:
                counts["errors"] += 1
                continue
            if pid == NULL_PID:
                continue
            jump = rap = False
            body = begin + 4
            if flags & 0x20:
                size = stream[body]
                if size:
                    marks = stream[body + 1]
                    jump, rap = bool(marks & 0x80), bool(marks & 0x40)
                    if marks & 0x10 and size >= 7:
                        raw = int.from_bytes(stream[body + 2 : body + 8], "big")
                        self.clocks.append({"pid": pid, "packet": number, "pcr": (raw >> 15) * 300 + (raw & 0x1FF)})
                body += 1 + size
                counts["discontinuities"] += jump
            if not flags & 0x10:
                continue
            counter = flags & 15
            if pid in seen and not jump:
                if counter == seen[pid]:
                    continue  # sent twice
                counts["gaps"] += counter != (seen[pid] + 1) & 15
            seen[pid] = counter
            if flags & 0xC0:
                counts["scrambled"] += 1
                continue
            start = bool(stream[begin + 1] & 0x40)
            if pid in self.types:
                if start:
                    self._close(pid)
                    self.open[pid], self.begun[pid] = [], (number, rap)
                if pid in self.open:  # else it begins before the first start
                    self.open[pid].append(stream[body:at])
            elif pid in self.tables:
                self._section_bytes(pid, start, stream[body:at])

    def _section_bytes(self, pid: int, start: bool, data: bytes) -> None:
        if start:
            rest = 1 + data[0] if data else 0
            if self.partial.get(pid):
                self._sections(pid, self.partial[pid] + data[1:rest])
                if self.partial.pop(pid, b""):
                    self.counts["broken"] += 1  # it never ended
            self._sections(pid, data[rest:])
        elif self.partial.get(pid):
            self._sections(pid, self.partial[pid] + data)

    def _sections(self, pid: int, data: bytes) -> None:
        """Take whole sections; what is not whole waits for the next packet."""
        at = 0
        while at < len(data) and data[at] != 0xFF:
            end = at + 3 + ((data[at + 1] & 0x0F) << 8 | data[at + 2]) if at + 3 <= len(data) else len(data) + 1
            if end > len(data):
                self.partial[pid] = data[at:]
                return
            if section_crc(data[at:end]) or end - at < 12:
                self.counts["broken"] += 1
            elif data[at + 5] & 1:  # in force now
                self._table(data[at:end])
            at = end
        self.partial.pop(pid, None)

    def _table(self, s: bytes) -> None:
        if s[0] == 0x00:
            programs = {(s[k + 2] & 0x1F) << 8 | s[k + 3] for k in range(8, len(s) - 4, 4) if s[k] or s[k + 1]}
            self.tables |= programs
            self.counts["programs"] = len(self.tables) - 1
        elif s[0] == 0x02:
            k = 12 + ((s[10] & 0x0F) << 8 | s[11])
            while k + 5 <= len(s) - 4:
                if s[k] not in SECTION_TYPES:
                    self.types.setdefault((s[k + 1] & 0x1F) << 8 | s[k + 2], s[k])
                k += 5 + ((s[k + 3] & 0x0F) << 8 | s[k + 4])

    def _close(self, pid: int) -> None:
        """End the elementary packet under way; length 0 means that it runs up to the next one's start."""
        if pid not in self.open:
            return
        pes = b"".join(self.open.pop(pid))
        size = 6 + (pes[4] << 8 | pes[5]) if len(pes) >= 6 else 0
        bare = len(pes) > 3 and pes[3] in BARE_IDS
        begin = 6 if bare else 9 + pes[8] if len(pes) > 8 else len(pes) + 1
        if pes[:3] != b"\0\0\1" or size > 6 and len(pes) != size or begin > len(pes):
            self.counts["broken"] += 1
            return
        pts = dts = None
        if not bare and pes[7] & 0x80 and begin >= 14:
            pts = dts = read_time_stamp(pes[9:14])
            if pes[7] & 0x40 and begin >= 19:
                dts = read_time_stamp(pes[14:19])
        number, rap = self.begun[pid]
        if pes[3] != PADDING:
            self.counts["elementary"] += 1
            self.data.setdefault(pid, []).append(pes[begin:])
            self.points.append({"pid": pid, "stream_type": self.types[pid], "pts": pts, "dts": dts, "packet": number, "random_access": rap, "size": len(pes) - begin})


def padded(data: bytes) -> bytes:
    """Filled with blanks up to a positive multiple of UNIT."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "media") -> DataFrame:
    """One row per input row: id, n_bytes (of the text in UTF-8), and ``out``: its transport stream.

    Null text counts as empty; repeated rows stay, no rows give no rows; a text of any length is stored
    whole; other columns are ignored. The stream depends on the text alone.
    """

    def setup() -> Callable[[list[str | None]], list[pa.Array]]:
        return lambda texts: [pa.array([mux(padded((t or "").encode())) for t in texts], pa.binary())]

    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias(text_col))
    return with_arrow_columns(rows, text_col, f"{out} binary", setup).drop(text_col)


def read_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Append payload, points (an entry for each elementary packet: its stream and type, time stamps in 90
    kHz ticks or null, transport packet, random access, size), clocks (27 MHz) and counts read from
    stored streams. Columns of these names are replaced.

    A null or empty stream has an empty payload, no points and zero counts. Repeated rows stay; no rows
    give no rows; a stream of any length is read whole.
    """

    def setup() -> Callable[[list[bytes | None]], list[pa.Array]]:
        point = pa.struct([("pid", pa.int32()), ("stream_type", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("packet", pa.int32()), ("random_access", pa.bool_()), ("size", pa.int32())])
        tick = pa.struct([("pid", pa.int32()), ("packet", pa.int32()), ("pcr", pa.int64())])

        def work(streams: list[bytes | None]) -> list[pa.Array]:
            read = [Demuxer(s or b"") for s in streams]
            return [
                pa.array([r.payload for r in read], pa.binary()),
                pa.array([r.points for r in read], pa.list_(point)),
                pa.array([r.clocks for r in read], pa.list_(tick)),
                *(pa.array([r.counts[k] for r in read], pa.int32()) for k in COUNTS),
            ]

        return work

    rows = media.drop("payload", "points", "clocks", *COUNTS)
    return with_arrow_columns(rows, media_col, f"payload binary, points {POINTS}, clocks {CLOCKS}, " + ", ".join(f"{k} int" for k in COUNTS), setup)
