"""Media columns: ISO base media files (nested boxes) that hold a text's bytes as 8-bit samples.

`wrap` builds a container of `ftyp`, `moov` (track with sample tables) and `mdat`; `inspect` walks the nested boxes of
a container, decodes the sample tables of each of its tracks, of both versions and in movie fragments, and gives codec,
duration and the byte ranges of key frames without decoding the payload. `store`, `describe` and `tracks` apply them to
a DataFrame. Samples are of the codec `raw ` (unsigned 8-bit samples, as they are).

Defined cases: null text is empty; an empty text has one sample of 192 blanks; repeated rows give repeated rows; equal
texts give equal values; a track without samples has no ranges; a time scale of 0 gives no duration in seconds; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, slices, stored, text_chunks

#: Bytes of one sample, samples a second of the track, and samples from one key frame to the next.
SAMPLE_BYTES, TIMESCALE, GROUP = 192, 48, 16
#: Boxes that hold boxes.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf")
CODEC = b"raw "


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def wrap(payload: bytes) -> bytes:
    """A container whose one track has the payload as samples of `SAMPLE_BYTES` bytes."""
    if not payload or len(payload) % SAMPLE_BYTES:
        raise ValueError(f"a payload is a positive multiple of {SAMPLE_BYTES} bytes")
    n = len(payload) // SAMPLE_BYTES
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    keys = range(1, n + 1, GROUP)

    def moov(at: int) -> bytes:
        entry = _box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHIHH", 1, 8, 0, TIMESCALE, 0))
        tables = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
            _full(b"stsz", struct.pack(">II", SAMPLE_BYTES, n)),
            _full(b"co64", struct.pack(">IQ", 1, at)),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), tables)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"), minf)
        head = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), matrix, bytes(8), flags=7)
        movie = _full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", movie, _box(b"trak", head, mdia))

    first = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    at = len(first) + len(moov(0)) + 16
    return b"".join((first, moov(at), struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16), payload))


def boxes(data: bytes, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of kinds, first body byte, end) of every box, parents before children."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} at byte {start} ends outside its parent")
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from boxes(data, body, stop, (*path, kind))
        start = stop


class _Box:
    """Fields of one box's body, read in their order. A full box's version and flags come first."""

    def __init__(self, data: bytes, body: int, full: bool = True):
        self.data, self.at = data, body
        head = self.take("I")[0] if full else 0
        self.version, self.flags = head >> 24, head & 0xFFFFFF

    def take(self, fields: str) -> tuple:
        out = struct.unpack_from(f">{fields}", self.data, self.at)
        self.at += struct.calcsize(f">{fields}")
        return out

    def times(self, fields: str) -> tuple:
        """Fields of which T is a time: 64 bits in version 1, else 32."""
        return self.take(fields.replace("T", "Q" if self.version else "I"))

    def rows(self, fields: str) -> list[tuple]:
        """A count, and as many rows."""
        return [self.take(fields) for _ in range(self.take("I")[0])]


def _grouped(data: bytes, outer: bytes, inner: bytes) -> Iterator[tuple[int, dict[bytes, list[int]]]]:
    """(first byte of the outer box, bodies by kind) of every `inner` box in an `outer` one."""
    group: dict[bytes, list[int]] | None = None
    start = 0
    for path, body, _ in boxes(data):
        if path[-1] == outer and len(path) == 1:
            start = body - 8
        if len(path) > 1 and path[0] == outer and path[1] == inner:
            if len(path) == 2:
                if group is not None:
                    yield opened, group
                group, opened = {}, start
            else:
                group.setdefault(path[-1], []).append(body)
    if group is not None:
        yield opened, group


def _sample_table(data: bytes, at: dict[bytes, list[int]]) -> tuple[list[tuple[int, int]], list[int], int]:
    """(byte ranges, numbers of the key frames, duration) of a track's samples."""
    sizes_box = _Box(data, at[b"stsz"][0])
    fixed, n = sizes_box.take("II")
    sizes = [fixed] * n if fixed else list(sizes_box.take(f"{n}I"))
    chunks = [x[0] for x in (_Box(data, at[b"co64"][0]).rows("Q") if b"co64" in at else _Box(data, at[b"stco"][0]).rows("I"))]
    runs, ranges = _Box(data, at[b"stsc"][0]).rows("III"), []
    for i, (first, each, _) in enumerate(runs):
        last = runs[i + 1][0] if i + 1 < len(runs) else len(chunks) + 1
        for chunk in range(first, last):
            pos = chunks[chunk - 1]
            for _ in range(min(each, n - len(ranges))):
                ranges.append((pos, pos + sizes[len(ranges)]))
                pos = ranges[-1][1]
    keys = [k - 1 for k, in _Box(data, at[b"stss"][0]).rows("I")] if b"stss" in at else list(range(n))
    return ranges, keys, sum(c * d for c, d in _Box(data, at[b"stts"][0]).rows("II"))


def _fragment(data: bytes, moof: int, at: dict[bytes, list[int]], defaults: dict[int, tuple]) -> tuple[int, list[tuple[int, int]], list[bool], int]:
    """(track, byte ranges, which are key frames, duration) of a track's part in a movie fragment."""
    head = _Box(data, at[b"tfhd"][0])
    (track,) = head.take("I")
    base = head.take("Q")[0] if head.flags & 0x1 else moof
    if head.flags & 0x2:
        head.take("I")
    known = defaults.get(track, (0, 0, 0))
    duration, size, flags = (head.take("I")[0] if head.flags & bit else old for bit, old in zip((0x8, 0x10, 0x20), known, strict=True))
    ranges: list[tuple[int, int]] = []
    keys, total, pos = [], 0, base
    for body in at.get(b"trun", []):
        run = _Box(data, body)
        (n,) = run.take("I")
        if run.flags & 0x1:
            pos = base + run.take("i")[0]
        first = run.take("I")[0] if run.flags & 0x4 else None
        for i in range(n):
            own = [run.take("I")[0] if run.flags & bit else old for bit, old in zip((0x100, 0x200, 0x400), (duration, size, flags), strict=True)]
            if run.flags & 0x800:
                run.take("I")
            if i == 0 and first is not None:
                own[2] = first
            ranges.append((pos, pos + own[1]))
            keys.append(not own[2] & 0x10000)  # no flag: a sample that needs no other
            pos, total = pos + own[1], total + own[0]
    return track, ranges, keys, total


def inspect(data: bytes) -> list[dict]:
    """Track, handler, codec, time scale, duration, sample count, byte ranges of the samples and of key frames, of each track."""
    defaults = {}
    for path, body, _ in boxes(data):
        if path[-1] == b"trex":
            track, _, *own = _Box(data, body).take("IIIII")
            defaults[track] = tuple(own)
    tracks: dict[int, dict] = {}
    for _, at in _grouped(data, b"moov", b"trak"):
        track = _Box(data, at[b"tkhd"][0]).times("TTI")[2]
        _, _, scale, duration = (media := _Box(data, at[b"mdhd"][0])).times("TTIT")
        if duration == (2 ** (64 if media.version else 32)) - 1:  # not known
            duration = 0
        handler = _Box(data, at[b"hdlr"][0]).take("4s4s")[1].decode("latin1")
        entries = _Box(data, at[b"stsd"][0])
        codec = entries.take("II4s")[2].decode("latin1") if entries.data[entries.at : entries.at + 4] != bytes(4) else ""
        ranges, keys, total = _sample_table(data, at)
        tracks[track] = {"track": track, "handler": handler, "codec": codec, "timescale": scale, "duration": duration or total, "samples": len(ranges), "ranges": ranges, "keyframes": [ranges[k] for k in keys]}
    summed: dict[int, int] = {}
    for moof, at in _grouped(data, b"moof", b"traf"):
        track, ranges, keys, total = _fragment(data, moof, at, defaults)
        if track in tracks:
            t = tracks[track]
            t["ranges"] += ranges
            t["samples"] += len(ranges)
            t["keyframes"] += [r for r, k in zip(ranges, keys, strict=True) if k]
            summed[track] = summed.get(track, 0) + total
    for track, total in summed.items():
        tracks[track]["duration"] = max(tracks[track]["duration"], total)
    return list(tracks.values())


def feature_of(info: dict) -> str:
    """A compact text of what `inspect` found; the key frames' ranges are summed up by count, ends and checksum."""
    keys = info["keyframes"]
    packed = b"".join(struct.pack("<QQ", *k) for k in keys)
    ends = f"{keys[0][0]}-{keys[-1][1]}" if keys else "-"
    return f"codec={info['codec']};timescale={info['timescale']};duration={info['duration']};samples={info['samples']};keyframes={len(keys)}:{ends}:{zlib.crc32(packed):08x}"


def seconds(info: dict) -> float | None:
    return info["duration"] / info["timescale"] if info["timescale"] else None


def padded(text: str) -> tuple[int, bytes]:
    """UTF-8 length of a text, and those bytes with blanks up to a positive multiple of `SAMPLE_BYTES`."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // SAMPLE_BYTES)) * SAMPLE_BYTES, b" ")


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text in a container of its own."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            made = [padded(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([wrap(p) for _, p in made], pa.binary())], schema=schema)

    return documents(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored containers hold, read back from their bytes."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<start: long, end: long>>"
    key = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for doc_id, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (info,) = inspect(data)
                payload = b"".join(data[a:b] for a, b in info["ranges"])
                keys = [{"start": a, "end": b} for a, b in info["keyframes"]]
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(info), info["codec"], seconds(info), keys))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(key)]
            names = [x.split(" ")[0] for x in schema.split(", ")][:10] + ["keyframes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def tracks(media: DataFrame) -> DataFrame:
    """A row for each track of any containers: doc_id, track, handler, codec, duration_s, samples, keyframes (byte ranges), error.

    media: doc_id, media. What is no container that can be read has a row with the reason in `error`, and nulls besides;
    null and empty media have no row.
    """
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = {"doc_id": pa.int64(), "track": pa.int64(), "handler": pa.string(), "codec": pa.string(), "duration_s": pa.float64(), "samples": pa.int64(), "keyframes": ranges, "error": pa.string()}
    schema = "doc_id long, track long, handler string, codec string, duration_s double, samples long, keyframes array<struct<start: long, end: long>>, error string"

    def rows_of(doc_id: int, data: bytes) -> list[tuple]:
        try:
            found = inspect(data)
        except (ValueError, KeyError, IndexError, OverflowError, ZeroDivisionError, MemoryError, struct.error) as error:
            return [(doc_id, None, None, None, None, None, None, f"{type(error).__name__}: {error}")]
        if not found:
            return [(doc_id, None, None, None, None, None, None, "no track")]
        return [(doc_id, t["track"], t["handler"], t["codec"], seconds(t), t["samples"], [{"start": a, "end": b} for a, b in t["keyframes"]], None) for t in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = [r for i, data in zip(*(c.to_pylist() for c in batch.columns), strict=True) if data for r in rows_of(i, data)]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return media.select("doc_id", "media").mapInArrow(run, schema)


def media_features(docs: DataFrame) -> DataFrame:
    """Stores every text as media in a table of the shared folder, reads that table back and describes its rows."""
    return describe(stored(store(docs), "media"))
