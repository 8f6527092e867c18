"""Matroska columns: packets of EBML files with their tracks, timestamps and byte ranges; and a lossless writer of sample streams."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.llm.common import documents, text_bytes

EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK, NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH, DEFAULT_NS = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
SCALE, DURATION, TIME, SIMPLE, GROUP, BLOCK, SPAN, REFERENCE = 0x2AD7B1, 0x4489, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE, CUE_TIME, CUE_TRACK, CUE_OF, CUE_AT = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
FRAME, LACED, BLOCKS_A_CLUSTER, SAMPLES_A_SECOND = 512, 6, 8, 8000
LACING = ("none", "xiph", "fixed", "ebml")


def number(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """A variable-length integer and where it ends; ``keep`` leaves the length marker in, as ids have it. All ones: -1, unknown."""
    first = data[at]
    if not first:
        raise ValueError(f"no length marker at byte {at}")
    width = 9 - first.bit_length()
    end = at + width
    if end > len(data):
        raise ValueError(f"cut off at byte {at}")
    value = int.from_bytes(data[at:end])
    if keep:
        return value, end
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), end


def coded(value: int, width: int = 0) -> bytes:
    while not width or value >= (1 << 7 * width) - 1:
        width += 1
    return (value | 1 << 7 * width).to_bytes(width)


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8) + coded(len(body)) + body


def whole(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8)))


def children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements in a range. One of unknown size ends where an element of its level or above begins."""
    while at < end:
        name, body = number(data, at, True)
        size, body = number(data, body)
        if size >= 0:
            stop = body + size
            if stop > end:
                raise ValueError(f"element {name:x} at byte {at} is longer than what holds it")
        elif name in (SEGMENT, CLUSTER):
            stop = end
            if name == CLUSTER:
                probe = body
                while probe < end:
                    inner, after = number(data, probe, True)
                    if inner in TOP or inner == CUE:
                        stop = probe
                        break
                    size, after = number(data, after)
                    if size < 0:
                        raise ValueError(f"element {inner:x} of unknown size in a cluster")
                    probe = after + size
        else:
            raise ValueError(f"element {name:x} of unknown size")
        yield name, body, stop
        at = stop


def _int(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b])


def _float(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0


def lace(data: bytes, at: int, end: int, mode: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose header ends at ``at``."""
    if mode == 0:
        return [(at, end)]
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if mode == 2:
        each, rest = divmod(end - at, count)
        if rest:
            raise ValueError("frames of fixed lacing differ in size")
        sizes = [each] * (count - 1)
    elif mode == 1:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            sizes.append(size + data[at])
            at += 1
    else:
        for k in range(count - 1):
            start = at
            value, at = number(data, at)
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << 7 * (at - start) - 1) - 1))
    out = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise ValueError("a laced frame leaves its block")
        out.append((at, at + size))
        at += size
    return [*out, (at, end)]


@dataclass
class Media:
    """What a file holds. A packet: (track, timestamp in ns, key, lacing, cluster's start, start, length)."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple[int, int, bool, int, int, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: int = 0
    blocks: int = 0


def parse(data: bytes) -> Media:
    """Reads a whole file; a malformed one raises ValueError. Cue positions become byte offsets in the file."""
    out = Media()
    try:
        for name, a, b in children(data, 0, len(data)):
            if name == SEGMENT:
                _segment(data, a, b, out)
    except (IndexError, struct.error) as e:
        raise ValueError(f"malformed: {e}") from e
    return out


def _segment(data: bytes, a: int, b: int, out: Media) -> None:
    base = a
    for name, x, y in children(data, a, b):
        if name == INFO:
            for n, p, q in children(data, x, y):
                if n == SCALE:
                    out.scale = _int(data, p, q)
                elif n == DURATION:
                    out.duration = _float(data, p, q)
        elif name == TRACKS:
            for n, p, q in children(data, x, y):
                if n == TRACK:
                    out.tracks.append(_track(data, p, q))
        elif name == CLUSTER:
            out.clusters += 1
            _cluster(data, x, y, out)
        elif name == CUES:
            for n, p, q in children(data, x, y):
                if n == CUE:
                    when = 0
                    for m, r, s in children(data, p, q):
                        if m == CUE_TIME:
                            when = _int(data, r, s)
                        elif m == CUE_TRACK:
                            f = {k: _int(data, u, v) for k, u, v in children(data, r, s)}
                            out.cues.append((when * out.scale, f.get(CUE_OF, 0), base + f.get(CUE_AT, 0)))


def _track(data: bytes, a: int, b: int) -> dict:
    t = {"number": 0, "kind": 0, "codec": "", "default_ns": 0, "rate": 0.0, "channels": 0, "depth": 0}
    for n, p, q in children(data, a, b):
        if n == NUMBER:
            t["number"] = _int(data, p, q)
        elif n == KIND:
            t["kind"] = _int(data, p, q)
        elif n == CODEC:
            t["codec"] = data[p:q].decode("ascii", "replace")
        elif n == DEFAULT_NS:
            t["default_ns"] = _int(data, p, q)
        elif n == AUDIO:
            for m, r, s in children(data, p, q):
                if m == RATE:
                    t["rate"] = _float(data, r, s)
                elif m == CHANNELS:
                    t["channels"] = _int(data, r, s)
                elif m == DEPTH:
                    t["depth"] = _int(data, r, s)
    return t


def _cluster(data: bytes, a: int, b: int, out: Media) -> None:
    time = 0
    for name, x, y in children(data, a, b):
        if name == TIME:
            time = _int(data, x, y)
        elif name == SIMPLE:
            _block(data, x, y, out, a, time, None)
        elif name == GROUP:
            inner = list(children(data, x, y))
            key = all(n != REFERENCE for n, _, _ in inner)
            for n, p, q in inner:
                if n == BLOCK:
                    _block(data, p, q, out, a, time, key)


def _block(data: bytes, a: int, b: int, out: Media, cluster: int, time: int, key: bool | None) -> None:
    track, at = number(data, a)
    offset, flags = struct.unpack_from(">hB", data, at)
    mode = flags >> 1 & 3
    own = next((t["default_ns"] for t in out.tracks if t["number"] == track), 0)
    start = (time + offset) * out.scale
    out.blocks += 1
    for k, (p, q) in enumerate(lace(data, at + 3, b, mode)):
        out.packets.append((track, start + k * own, bool(flags & 0x80) if key is None else key, mode, cluster, p, q - p))


def write(payload: bytes) -> bytes:
    """A file with one track of unsigned 8-bit samples, in frames of FRAME samples laced in turn by Xiph, EBML and fixed sizes."""
    ns = FRAME * 1_000_000_000 // SAMPLES_A_SECOND
    info = element(INFO, whole(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLES_A_SECOND)))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLES_A_SECOND)) + whole(CHANNELS, 1) + whole(DEPTH, 8))
    track = element(TRACKS, element(TRACK, whole(NUMBER, 1) + whole(UID, 1) + whole(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + whole(DEFAULT_NS, ns) + audio))
    body, cues = [info, track], []
    at = len(info) + len(track)
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    groups = [frames[i : i + LACED] for i in range(0, len(frames), LACED)]
    for c in range(0, len(groups), BLOCKS_A_CLUSTER):
        start = c * LACED * ns // 1_000_000
        blocks = [whole(TIME, start)]
        for k, group in enumerate(groups[c : c + BLOCKS_A_CLUSTER], c):
            mode = (1, 3, 2)[k % 3]
            if len(group) == 1:
                mode = 0
            elif mode == 2 and len(group[-1]) != FRAME:
                mode = 3
            head = coded(1) + struct.pack(">hB", k * LACED * ns // 1_000_000 - start, 0x80 | mode << 1)
            if mode:
                head += bytes([len(group) - 1])
            if mode == 1:
                head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in group[:-1])
            elif mode == 3:
                head += coded(len(group[0])) + b"".join(coded((1 << 6) - 1 + len(f) - len(e), 1) for e, f in zip(group, group[1:-1], strict=False))
            blocks.append(element(SIMPLE, head + b"".join(group)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE, whole(CUE_TIME, start) + element(CUE_TRACK, whole(CUE_OF, 1) + whole(CUE_AT, at))))
        at += len(cluster)
        body.append(cluster)
    body.append(element(CUES, b"".join(cues)))
    head = whole(0x4286, 1) + whole(0x42F7, 1) + whole(0x42F2, 4) + whole(0x42F3, 8) + element(0x4282, b"matroska") + whole(0x4287, 4) + whole(0x4285, 2)
    return element(EBML, head) + element(SEGMENT, b"".join(body))


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    """A track's frames, one after the other."""
    return b"".join(data[p : p + n] for t, _, _, _, _, p, n in media.packets if t == track)


PACKET = "seq bigint, track bigint, timestamp_ns bigint, key boolean, lacing string, cluster_at bigint, start bigint, length bigint"


def packet_table(files: DataFrame, data_col: str = "data") -> DataFrame:
    """``files`` to their packets: all columns but the data, inside ``_row``, then PACKET's and ``error``.

    Null and empty data give no packets; malformed data give one row with null packet columns and the reason in ``error``. Equal rows each give
    their packets. An empty table gives an empty result. Columns of any name pass through inside ``_row``.
    """
    keep = F.struct(*[files[c] for c in files.columns if c != data_col], F.lit(0).alias("_")).alias("_row")
    rows = files.select(keep, F.col(data_col).alias("data"))
    own = rows.schema["_row"].dataType.simpleString()
    made = [x.rsplit(" ", 1)[0].strip() for x in PACKET.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, cols, errors = [], [[] for _ in made], []
            for i, value in enumerate(batch.column(1)):
                data = value.as_py()
                if not data:
                    continue
                try:
                    packets, error = parse(data).packets, None
                except ValueError as e:
                    packets, error = [], str(e)
                got = [(k, t, ts, key, LACING[mode], c, p, n) for k, (t, ts, key, mode, c, p, n) in enumerate(packets)]
                for row in got or ([(None,) * len(made)] if error else []):
                    take.append(i)
                    errors.append(error)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [batch.column(0).take(pa.array(take, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)], pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["_row", *made, "error"])

    return rows.mapInArrow(run, f"_row {own}, {PACKET}, error string")


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 if data else 64)


def feature(payload: bytes, media: Media) -> str:
    """Counts of the packet table, and level, roughness and spread of the samples read back."""
    x = np.frombuffer(payload, np.uint8)
    lacing = "/".join(str(sum(1 for p in media.packets if p[3] == m)) for m in range(4))
    odds = np.bincount(x, minlength=256) / len(x)
    bits = -float(np.sum(odds[odds > 0] * np.log2(odds[odds > 0])))
    rough = float(np.abs(np.diff(x.astype(np.int16))).mean())
    last = media.packets[-1][1] // 1_000_000
    return f"tracks={len(media.tracks)};clusters={media.clusters};cues={len(media.cues)};blocks={media.blocks};packets={len(media.packets)};lacing={lacing};last_ms={last};mean={x.mean():.4f};rough={rough:.4f};bits={bits:.4f}"


def stored_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` to one row each: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The text's UTF-8 bytes, with zeros up to a positive multiple of 64, are written as a Matroska file of 8-bit samples; the file is
    parsed, and everything is computed from what its packets hold. Null and empty texts give 64 zeros. Repeated
    rows give repeated results. An empty table gives an empty result. Other columns are ignored.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                text = value.as_py()
                file = write(padded(text))
                media = parse(file)
                back = samples(file, media)
                out.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature(back, media)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(F.col(text_col)).alias("text")).mapInArrow(run, schema)


def op10_matroska(spark, sf_dir: str) -> DataFrame:
    return stored_payloads(documents(spark, sf_dir))
