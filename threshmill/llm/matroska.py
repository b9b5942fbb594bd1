"""Media columns: Matroska.

`parse` walks a file's EBML elements (variable-length ids and sizes, unknown
sizes too), its clusters, SimpleBlocks and BlockGroups, undoes Xiph, EBML and
fixed-size lacing, and gives a table of packets with track, timestamp and byte
range, along with tracks, cues and the seek check of cues against clusters.
`write` makes files with one 8-bit PCM track from bytes, used to store a
payload without loss and to test the parser. `packet_table` and
`text_media` are the Spark operators.
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

from threshmill.llm.common import lean, short_batches

#: Fixed values of the format: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that only stand at the top of a segment: they end a cluster of unknown size.
TOP_LEVEL = frozenset((INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770))
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3


class Malformed(ValueError):
    """Bytes that are no Matroska file, or one that is cut short."""


def read_id(data: bytes, at: int) -> tuple[int, int]:
    """(element id, place after it); an id keeps its length marker."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no element id at byte {at}")
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > len(data):
        raise Malformed(f"element id at byte {at} is too long")
    return int.from_bytes(data[at : at + n], "big"), at + n


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """(value, place after it) of a variable-length integer; None if the size is unknown (all ones)."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no size at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise Malformed(f"size at byte {at} is cut short")
    value = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, first byte, body's first byte, end) of the elements of one level."""
    while at < end:
        kind, body = read_id(data, at)
        size, body = read_size(data, body)
        if size is None:
            stop = end if kind == SEGMENT else _unknown_end(data, body, end)
        else:
            stop = body + size
        if stop > end:
            raise Malformed(f"element {kind:x} at byte {at} ends after its parent")
        yield kind, at, body, stop
        at = stop


def _unknown_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        kind, body = read_id(data, at)
        if kind in TOP_LEVEL:
            return at
        size, body = read_size(data, body)
        if size is None:
            raise Malformed(f"nested unknown size at byte {at}")
        at = body + size
    return end


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


@dataclass
class Packet:
    cluster: int
    track: int
    timestamp_ns: int
    duration_ns: int | None
    keyframe: bool
    offset: int
    size: int
    lacing: int


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    segment: int = 0

    def cues_hold(self) -> bool:
        """Each cue points to the first byte of a cluster."""
        starts = {at - self.segment for at in self.clusters}
        return all(position in starts for _, _, position in self.cues)


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """(sizes of the frames of a block, first byte of the first frame)."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise Malformed("a laced block without a frame count")
    n, at = data[at] + 1, at + 1
    if lacing == FIXED_LACING:
        if (end - at) % n:
            raise Malformed("fixed-size lacing doesn't divide its block")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    if lacing == XIPH_LACING:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Malformed("Xiph lacing is cut short")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    else:
        for i in range(n - 1):
            value, after = read_size(data, at)
            width, at = after - at, after
            if value is None:
                value = (1 << 7 * width) - 1
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise Malformed("laced frames are larger than their block")
    return [*sizes, last], at


def parse(data: bytes) -> Media:
    """All packets, tracks and cues of a file; raises Malformed if it isn't one."""
    media, seen = Media(), False
    for kind, at, body, end in elements(data, 0, len(data)):
        if kind == EBML:
            kinds = {k: data[b:e] for k, _, b, e in elements(data, body, end)}
            if kinds.get(DOC_TYPE, b"matroska").rstrip(b"\0") not in (b"matroska", b"webm"):
                raise Malformed("another document type")
            seen = True
        elif kind == SEGMENT:
            media.segment = body
            for k, a, b, e in elements(data, body, end):
                if k == INFO:
                    for x, _, y, z in elements(data, b, e):
                        if x == TIMESTAMP_SCALE:
                            media.scale = _uint(data, y, z)
                elif k == TRACKS:
                    for _, _, y, z in (x for x in elements(data, b, e) if x[0] == TRACK_ENTRY):
                        entry = {k2: data[y2:z2] for k2, _, y2, z2 in elements(data, y, z)}
                        number = int.from_bytes(entry.get(TRACK_NUMBER, b""), "big")
                        media.tracks[number] = {"codec": entry.get(CODEC_ID, b"").decode("ascii", "replace"), "type": int.from_bytes(entry.get(TRACK_TYPE, b""), "big"), "default_ns": int.from_bytes(entry.get(DEFAULT_DURATION, b""), "big")}
                elif k == CUES:
                    for _, _, y, z in (x for x in elements(data, b, e) if x[0] == CUE_POINT):
                        time, where = 0, []
                        for x, _, p, q in elements(data, y, z):
                            if x == CUE_TIME:
                                time = _uint(data, p, q)
                            elif x == CUE_TRACK_POSITIONS:
                                inner = {k2: _uint(data, y2, z2) for k2, _, y2, z2 in elements(data, p, q)}
                                where.append((inner.get(CUE_TRACK, 0), inner.get(CUE_CLUSTER_POSITION, 0)))
                        media.cues += [(time * media.scale, t, p) for t, p in where]
                elif k == CLUSTER:
                    media.clusters.append(a)
                    _cluster(data, b, e, media)
        if kind == SEGMENT and not seen:
            raise Malformed("no EBML header")
    if not seen:
        raise Malformed("no EBML header")
    return media


def _cluster(data: bytes, at: int, end: int, media: Media) -> None:
    base = 0
    for kind, _, body, stop in elements(data, at, end):
        if kind == TIMESTAMP:
            base = _uint(data, body, stop)
        elif kind == SIMPLE_BLOCK:
            _block(data, body, stop, base, media, None, None)
        elif kind == BLOCK_GROUP:
            inner = list(elements(data, body, stop))
            # a group that refers to no other block is a keyframe
            key = all(k != REFERENCE_BLOCK for k, *_ in inner)
            duration = next((_uint(data, b, e) for k, _, b, e in inner if k == BLOCK_DURATION), None)
            for k, _, b, e in inner:
                if k == BLOCK:
                    _block(data, b, e, base, media, key, duration)


def _block(data: bytes, at: int, end: int, base: int, media: Media, keyframe: bool | None, duration: int | None) -> None:
    """The frames of a block; a duration in ticks is shared by its frames and goes before the track's default."""
    track, at = read_size(data, at)
    if track is None or at + 3 > end:
        raise Malformed("a block's header is cut short")
    relative, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    lacing = flags >> 1 & 3
    sizes, at = lace_sizes(data, at + 3, end, lacing)
    each = media.tracks.get(track, {}).get("default_ns", 0) if duration is None else duration * media.scale // len(sizes)
    for i, size in enumerate(sizes):
        media.packets.append(Packet(len(media.clusters) - 1, track, (base + relative) * media.scale + i * each, each or None, bool(flags & 0x80) if keyframe is None else keyframe, at, size, lacing))
        at += size


def size_bytes(n: int, width: int = 0) -> bytes:
    """A variable-length integer, as short as may be or of that width."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """A block's body after its header."""
    if lacing == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == XIPH_LACING:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == EBML_LACING:
        head += size_bytes(len(frames[0]))
        for a, b in zip(frames[:-2], frames[1:-1], strict=True):
            n = len(b) - len(a)
            width = next(w for w in range(1, 9) if abs(n) < (1 << 7 * w - 1) - 1)
            head += size_bytes(n + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write(payload: bytes, frame: int = 1024, per_block: int = 8, per_cluster: int = 4, rate: int = 8000) -> bytes:
    """A file whose one track holds the payload as unsigned 8-bit mono samples.

    Frames have `frame` samples, the last one the rest. Blocks hold up to
    `per_block` frames, with each lacing in turn; clusters up to `per_cluster`
    blocks; each cluster has a cue. One tick of the timestamps is one sample.
    """
    scale = 1_000_000_000 // rate
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, scale) + element(MUXING_APP, b"threshmill") + element(WRITING_APP, b"threshmill"))
    audio = element(AUDIO, uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, frame * scale) + audio))
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    clusters: list[bytes] = []
    starts: list[int] = []
    for i in range(0, len(frames), per_block * per_cluster):
        body = [uint(TIMESTAMP, i * frame)]
        for b, j in enumerate(range(i, min(i + per_block * per_cluster, len(frames)), per_block)):
            some = frames[j : j + per_block]
            even = len(some[0]) == len(some[-1])
            lacing = NO_LACING if len(some) == 1 else ((FIXED_LACING if even else EBML_LACING), XIPH_LACING, EBML_LACING)[(len(clusters) + b) % 3]
            relative = (j - i) * frame
            body.append(element(SIMPLE_BLOCK, size_bytes(1) + relative.to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1]) + laced(some, lacing)))
        starts.append(i * frame)
        clusters.append(element(CLUSTER, b"".join(body)))
    at, points = len(info) + len(tracks), []
    for start, cluster in zip(starts, clusters, strict=True):
        points.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        at += len(cluster)
    segment = b"".join((info, tracks, *clusters, element(CUES, b"".join(points))))
    return head + element(SEGMENT, segment)


def packet_table(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per packet: id, cluster, track, timestamp_ns, duration_ns, keyframe, offset, size, lacing, codec.

    A null, empty or malformed file gives one row with its error and nulls; a
    file without packets gives none. Other columns are ignored.
    """
    columns = [("cluster", "int"), ("track", "long"), ("timestamp_ns", "long"), ("duration_ns", "long"), ("keyframe", "boolean"), ("offset", "long"), ("size", "long"), ("lacing", "int"), ("codec", "string"), ("error", "string")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            out: dict[str, list] = {c: [] for c, _ in columns}
            for i, data in enumerate(batch.column("media")):
                try:
                    got = parse(data.as_py() or b"")
                    for p in got.packets:
                        ids.append(i)
                        for c in ("cluster", "track", "timestamp_ns", "duration_ns", "keyframe", "offset", "size", "lacing"):
                            out[c].append(getattr(p, c))
                        out["codec"].append(got.tracks.get(p.track, {}).get("codec"))
                        out["error"].append(None)
                except Malformed as e:
                    ids.append(i)
                    for c, _ in columns:
                        out[c].append(str(e) if c == "error" else None)
            kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ids, pa.int64())), *(pa.array(out[c], kinds[t]) for c, t in columns)], names=["id", *out])

    source = media.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(lean(rows), ", ".join([f"id {kind}", *(f"{c} {t}" for c, t in columns)]))


def feature(media: Media, payload: bytes) -> str:
    """Tracks, clusters, packets, lacings used, duration and mean of the samples, as one string."""
    n = len(payload)
    ends = max((p.timestamp_ns + p.size * media.scale for p in media.packets), default=0)
    mean = int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64)) / n if n else 0.0
    lacings = "".join(sorted({str(p.lacing) for p in media.packets}))
    return f"tracks={len(media.tracks)};clusters={len(media.clusters)};cues={len(media.cues)};cues_hold={int(media.cues_hold())};packets={len(media.packets)};lacings={lacings};ms={ends // 1_000_000};mean={mean:.3f}"


def stored(text: str | None) -> tuple[int, bytes]:
    """(UTF-8 bytes, Matroska file) of a text, padded with bytes 0 to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), write(raw + b"\0" * (64 - len(raw) if not raw else -len(raw) % 64))


def text_media(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Each whole text stored as an audio track in a Matroska file and read back by the parser.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature and packets (the packet table as a list:
    track, timestamp, first byte and size), with the file if with_media. The payload is what the packets' byte ranges hold. A null text
    is empty (64 bytes 0). Rows stay as they are, repeated ones too; an empty
    table gives no rows; other columns are ignored.
    """
    short_batches(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            files: list[bytes] = []
            ends, packets = [0], []
            for text in batch.column("text"):
                n, data = stored(text.as_py())
                got = parse(data)
                view = memoryview(data)
                payload = b"".join(view[p.offset : p.offset + p.size] for p in got.packets)
                for x, y in zip(out, (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(got, payload)), strict=True):
                    x.append(y)
                packets += [(p.track, p.timestamp_ns, p.offset, p.size) for p in got.packets]
                ends.append(len(packets))
                if with_media:
                    files.append(data)
            arrays = [batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, kinds[1:], strict=True))]
            one = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in zip(*packets, strict=True)] if packets else [pa.array([], pa.int64())] * 4, names=["track", "timestamp_ns", "offset", "size"])
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), one))
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(files, pa.binary())] if with_media else [])], names=[*names, "packets", *(["media"] if with_media else [])])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, packets array<struct<track long, timestamp_ns long, offset long, size long>>" + (", media binary" if with_media else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(rows), schema)
