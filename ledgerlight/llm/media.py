"""MPEG transport streams as media columns: bytes are multiplexed into 188-byte packets and read back.

Writing: a program association table, a program map table, then the payload as elementary data in PES packets on one
PID, each with a presentation timestamp; every ``gop``-th PES packet starts with a random-access point. The payload is
length-exact: PES headers carry their length and the last packet of each is padded by an adaptation field.

Reading: the program tables are parsed and their CRC-32/MPEG-2 checked, continuity counters are checked on every PID,
PES packets are reassembled, and timestamps are stored with their random-access flags. A packet that is lost, repeated
or out of step raises the count of discontinuities; a repeated packet is used once.

Defined results: null and empty inputs are empty payloads; very long ones only take more packets; equal bytes give
equal streams (nothing is dated or random); repeated rows and null ids are rows of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import bounded, pieces

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM, STREAM_TYPE = 0x0000, 0x1000, 0x0100, 1, 0x06
PES_DATA = 184 * 64 - 14  # elementary bytes of a full PES packet: 64 TS packets
TICKS = 3600  # of 90 kHz between PES packets
BLOCK = 64


def _mpeg_crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _mpeg_crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | ((pts >> 29) & 0x0E), (pts >> 22) & 0xFF, 0x01 | ((pts >> 14) & 0xFE), (pts >> 7) & 0xFF, 0x01 | ((pts << 1) & 0xFE)])


def _pes_packets(body: bytes, pts: int, random_access: bool, counter: int) -> np.ndarray:
    """One PES packet as rows of 188 bytes."""
    pes = b"\x00\x00\x01\xbd" + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(pts) + body
    first = 182 if random_access else 184  # a random-access flag takes an adaptation field of two bytes
    n = 1 + max(0, -(-(len(pes) - first) // 184))
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | ((counter + np.arange(n)) & 15)
    data = np.frombuffer(pes, np.uint8)
    if n > 2:
        out[1 : n - 1, 4:] = data[first : first + 184 * (n - 2)].reshape(n - 2, 184)
    for i in {0, n - 1}:  # the first and the last may hold an adaptation field
        part = data[:first] if i == 0 else data[first + 184 * (i - 1) :]
        flag = random_access and i == 0
        room = 184 - len(part)
        if room or flag:
            out[i, 3] |= 0x20
            out[i, 4] = room - 1
            if room > 1:
                out[i, 5] = 0x40 if flag else 0
        out[i, PACKET - len(part) :] = part
    return out


def encode_ts(payload: bytes, gop: int = 8) -> bytes:
    parts, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), PES_DATA)):
        rows = _pes_packets(payload[at : at + PES_DATA], k * TICKS, k % gop == 0, counter)
        counter += len(rows)
        parts.append(rows.tobytes())
    return b"".join(parts)


@dataclass
class Stream:
    """What a transport stream holds."""

    payload: bytes = b""
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # program number: PID of its map
    streams: dict[int, int] = field(default_factory=dict)  # elementary PID: stream type
    discontinuities: int = 0
    bad_tables: int = 0
    pts: list[int] = field(default_factory=list)
    pts_offset: list[int] = field(default_factory=list)  # of the PES packet's data in the payload
    random_access: list[bool] = field(default_factory=list)

    @property
    def feature(self) -> str:
        kinds = ",".join(f"{p:04x}:{t:02x}" for p, t in sorted(self.streams.items()))
        return f"packets={self.packets};programs={len(self.programs)};streams={kinds};pes={len(self.pts)};last_pts={max(self.pts, default=-1)};random_access={sum(self.random_access)};discontinuities={self.discontinuities};bad_tables={self.bad_tables}"


def _sections(data: bytes, table_id: int) -> tuple[bytes | None, bool]:
    """The body of a section with a pointer field before it, and whether it was broken."""
    s = data[1 + data[0] :] if data else b""
    if len(s) < 12 or s[0] != table_id:
        return None, True
    end = 3 + ((s[1] & 0x0F) << 8 | s[2])
    if end > len(s) or crc32_mpeg(s[:end]) != 0:
        return None, True
    return s[8 : end - 4], False


def decode_ts(media: bytes) -> Stream:
    """Reads any single-program-table stream of whole packets; broken packets are left out and counted."""
    out = Stream()
    n = len(media) // PACKET
    a = np.frombuffer(media, np.uint8, n * PACKET).reshape(n, PACKET)
    a = a[(a[:, 0] == SYNC) & (a[:, 1] & 0x80 == 0)]
    out.packets = len(a)
    out.discontinuities += n - len(a)
    pid = ((a[:, 1].astype(np.int32) & 0x1F) << 8) | a[:, 2]
    has_field, has_data = (a[:, 3] & 0x20) > 0, (a[:, 3] & 0x10) > 0
    begin = np.where(has_field, 5 + a[:, 4].astype(np.int32), 4)
    begin = np.where(has_data, np.minimum(begin, PACKET), PACKET)
    access = has_field & (a[:, 4] > 0) & ((a[:, 5] & 0x40) > 0)
    repeated = np.zeros(len(a), bool)
    for p in np.unique(pid):
        if p == 0x1FFF:
            continue
        at = np.flatnonzero((pid == p) & has_data)
        step = np.diff(a[at, 3].astype(np.int32) & 15) % 16
        repeated[at[1:][step == 0]] = True
        out.discontinuities += int((step != 1).sum())
    start = (a[:, 1] & 0x40) > 0
    use = has_data & ~repeated
    for i in np.flatnonzero((pid == PAT_PID) & start & use):
        body, broken = _sections(a[i, begin[i] :].tobytes(), 0x00)
        out.bad_tables += broken
        for k in range(0, len(body or b"") - 3, 4):
            number = body[k] << 8 | body[k + 1]
            if number:
                out.programs[number] = (body[k + 2] & 0x1F) << 8 | body[k + 3]
    for number, pmt in out.programs.items():
        for i in np.flatnonzero((pid == pmt) & start & use):
            body, broken = _sections(a[i, begin[i] :].tobytes(), 0x02)
            out.bad_tables += broken
            if body is None:
                continue
            k = 4 + ((body[2] & 0x0F) << 8 | body[3])
            while k + 5 <= len(body):
                out.streams[(body[k + 1] & 0x1F) << 8 | body[k + 2]] = body[k]
                k += 5 + ((body[k + 3] & 0x0F) << 8 | body[k + 4])
    parts, size = [], 0
    for p in sorted(out.streams):
        rows = np.flatnonzero((pid == p) & use)
        firsts = np.flatnonzero(start[rows])
        for lo, hi in zip(firsts, np.append(firsts[1:], len(rows)), strict=False):
            mine = rows[lo:hi]
            whole = a[mine]
            keep = np.arange(PACKET)[None, :] >= begin[mine][:, None]
            pes = whole[keep].tobytes()
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                out.discontinuities += 1
                continue
            length = pes[4] << 8 | pes[5]
            body = pes[9 + pes[8] : 6 + length if length else len(pes)]
            if pes[7] & 0x80:
                t = pes[9:14]
                out.pts.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
                out.pts_offset.append(size)
                out.random_access.append(bool(access[mine[0]]))
            parts.append(body)
            size += len(body)
    out.payload = b"".join(parts)
    return out


def padded(data: bytes, block: int = BLOCK) -> bytes:
    return data + b"\0" * (-len(data) % block) if data else b"\0" * block


STAMPS = pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("random_access", pa.bool_())]))


def media_columns(df: DataFrame, *, id_col: str = "doc_id", data_col: str = "text", gop: int = 8, block: int = 1) -> DataFrame:
    """(id_col, n_bytes, media, timestamps): each payload as a transport stream, with the timestamps and random-access
    points that reading it finds: each PES packet's time, the place of its data in the payload, and whether decoding can
    start there. Payloads are padded with zero bytes to a positive multiple of ``block`` (1: not at all); n_bytes is before that."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in pieces(batch, 1)):
            n, media, stamps = [], [], []
            for x in piece.column(1).to_pylist():
                data = x or b""
                stream = encode_ts(padded(data, block) if block > 1 else data, gop)
                read = decode_ts(stream)
                n.append(len(data))
                media.append(stream)
                stamps.append([{"pts": a, "offset": b, "random_access": c} for a, b, c in zip(read.pts, read.pts_offset, read.random_access, strict=True)])
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(stamps, STAMPS)], ["_id", "n_bytes", "media", "timestamps"])

    schema = f"_id {kind}, n_bytes long, media binary, timestamps array<struct<pts:bigint,offset:bigint,random_access:boolean>>"
    return df.select(F.col(id_col).alias("_id"), F.col(data_col).cast("binary").alias("_data")).mapInArrow(bounded(run), schema).withColumnRenamed("_id", id_col)


SCHEMA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(stored: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", size_col: str = "n_bytes", stamps_col: str = "timestamps") -> DataFrame:
    """(id_col, n_bytes, the columns of SCHEMA) of stored streams: digests of the payload that is read back and of the
    stream, and its features. ``stamps_ok`` in the feature tells whether the stored timestamps are those of the stream."""
    kind = stored.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in pieces(batch, 2)):
            rows = []
            for media, stamps in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True):
                read = decode_ts(media or b"")
                same = [(x["pts"], x["offset"], x["random_access"]) for x in stamps or []] == list(zip(read.pts, read.pts_offset, read.random_access, strict=True))
                back = read.payload
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media or b""), hashlib.sha256(media or b"").hexdigest(), f"{read.feature};stamps_ok={int(same)}"))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["_id", "n_bytes", *[x.split()[0] for x in SCHEMA.split(", ")]])

    rows = stored.select(F.col(id_col).alias("_id"), F.col(size_col).alias("n_bytes"), F.col(media_col).alias("_media"), F.col(stamps_col).alias("_stamps"))
    return rows.mapInArrow(bounded(run), f"_id {kind}, n_bytes long, {SCHEMA}").withColumnRenamed("_id", id_col)
