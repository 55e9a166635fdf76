"""Media columns: ISO base media files, their boxes and sample tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._text import chunks, texts

#: Bytes of a stored sample, samples of a chunk, samples between keyframes, samples a second.
SAMPLE, PER_CHUNK, KEY_EVERY, RATE = 192, 64, 32, 125

#: Boxes that hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_media(payload: bytes) -> bytes:
    """Store ``payload``, whole samples of 192 bytes, as one track of 8-bit samples."""
    n = len(payload) // SAMPLE
    if not n or n * SAMPLE != len(payload):
        raise ValueError("the payload must be a positive multiple of the sample size")
    n_chunks = -(-n // PER_CHUNK)
    runs = [(1, PER_CHUNK)] * (n_chunks > 1 or n == PER_CHUNK)
    if n % PER_CHUNK:
        runs.append((n_chunks, n % PER_CHUNK))
    keys = range(1, n + 1, KEY_EVERY)
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE * SAMPLE << 16 & 0xFFFFFFFF))
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(first: int) -> bytes:
        at = struct.pack(f">{n_chunks}Q", *range(first, first + len(payload), PER_CHUNK * SAMPLE))
        stbl = _box(
            b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", c, k, 1) for c, k in runs)),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)), _full(b"co64", struct.pack(">I", n_chunks), at),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, n, 0x55C4, 0), version=1)
        mdia = _box(b"mdia", mdhd, _full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), matrix, bytes(8), version=1, flags=3)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, n, 1 << 16, 256), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    mdat = _box(b"mdat", payload)
    first = len(ftyp) + len(moov(0)) + len(mdat) - len(payload)
    return ftyp + moov(first) + mdat


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """The path and the body's bounds of every box, nested ones after their parent.

    Only headers are read. A box that doesn't fit its parent raises ValueError.
    """
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box's header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box's header is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError("a box is longer than its parent")
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


@dataclass
class Track:
    """What the sample tables of one track say; ranges are (start, end) in the file."""

    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: list[int] = field(default_factory=list)
    chunks: list[int] = field(default_factory=list)
    runs: list[tuple[int, int]] = field(default_factory=list)
    keys: list[int] | None = None
    deltas: list[tuple[int, int]] = field(default_factory=list)

    def sample_ranges(self) -> list[tuple[int, int]]:
        found, sample = [], 0
        for i, (first, per) in enumerate(self.runs):
            last = self.runs[i + 1][0] if i + 1 < len(self.runs) else len(self.chunks) + 1
            for c in range(first, last):
                at = self.chunks[c - 1]
                for _ in range(min(per, len(self.sizes) - sample)):
                    found.append((at, at + self.sizes[sample]))
                    at += self.sizes[sample]
                    sample += 1
        return found

    def keyframe_ranges(self) -> list[tuple[int, int]]:
        """All samples are keyframes where the track has no table of them."""
        ranges = self.sample_ranges()
        return ranges if self.keys is None else [ranges[k - 1] for k in self.keys]


def read_tracks(media: bytes) -> list[Track]:
    """Decode the sample tables of every track; payloads stay as they are."""
    data, tracks = memoryview(media), []

    def ints(form: str, at: int, n: int, stop: int) -> tuple[int, ...]:
        if at + n * struct.calcsize(">" + form) > stop:
            raise ValueError("a table is longer than its box")
        return struct.unpack_from(f">{n}{form}", data, at)

    for path, body, stop in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append(Track())
        if not tracks or b"trak" not in path:
            continue
        track = tracks[-1]
        if kind == b"mdhd":
            wide = data[body] == 1
            track.timescale, track.duration = struct.unpack_from(">IQ" if wide else ">II", data, body + (20 if wide else 12))
        elif kind == b"stsd":
            track.codec = bytes(data[body + 12 : body + 16]).decode("latin-1")
        elif kind == b"stts":
            (n,) = ints("I", body + 4, 1, stop)
            flat = ints("I", body + 8, 2 * n, stop)
            track.deltas = list(zip(flat[::2], flat[1::2]))
        elif kind == b"stsz":
            same, n = ints("I", body + 4, 2, stop)
            track.sizes = [same] * n if same else list(ints("I", body + 12, n, stop))
        elif kind in (b"stco", b"co64"):
            (n,) = ints("I", body + 4, 1, stop)
            track.chunks = list(ints("Q" if kind == b"co64" else "I", body + 8, n, stop))
        elif kind == b"stsc":
            (n,) = ints("I", body + 4, 1, stop)
            flat = ints("I", body + 8, 3 * n, stop)
            track.runs = list(zip(flat[::3], flat[1::3]))
        elif kind == b"stss":
            (n,) = ints("I", body + 4, 1, stop)
            track.keys = list(ints("I", body + 8, n, stop))
    return tracks


_FILES = "doc_id long, n_bytes long, media binary"
_ABOUT = (
    "codec string, timescale long, duration long, n_samples long, keyframes array<struct<start:long,end:long>>, "
    "media_bytes long, payload_bytes long, media_sha256 string, payload_sha256 string, tail_crc32 long, problem string"
)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        n, files = [], []
        for text in texts(batch, "text").cast(pa.large_binary()):
            raw = text.as_py()
            n.append(len(raw))
            files.append(write_media(raw + b" " * (-len(raw) % SAMPLE or SAMPLE * (not raw))))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])


def describe(media: bytes | None) -> dict:
    """The columns of one file; an unreadable file has only digests of itself and its ``problem``."""
    media = media or b""
    out: dict = {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "problem": None}
    try:
        (track, *_) = read_tracks(media) or [None]
        if track is None:
            raise ValueError("no track")
        ranges = track.sample_ranges()
        payload, tail, n = hashlib.sha256(), b"", 0
        i = 0
        while i < len(ranges):  # runs of adjoining samples are read at once
            j = i
            while j + 1 < len(ranges) and ranges[j + 1][0] == ranges[j][1]:
                j += 1
            part = media[ranges[i][0] : ranges[j][1]]
            if len(part) < ranges[j][1] - ranges[i][0]:
                raise ValueError("a sample lies outside the file")
            payload.update(part)
            tail, n, i = (tail + part)[-16:], n + len(part), j + 1
        keys = [{"start": a, "end": b} for a, b in track.keyframe_ranges()]
        out |= {
            "codec": track.codec, "timescale": track.timescale, "duration": track.duration, "n_samples": len(ranges), "keyframes": keys,
            "payload_bytes": n, "payload_sha256": payload.hexdigest(), "tail_crc32": zlib.crc32(tail),
        }
    except (ValueError, struct.error, IndexError) as e:
        out["problem"] = str(e)
    return out


def _describe(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {
            "codec": pa.string(), "timescale": pa.int64(), "duration": pa.int64(), "n_samples": pa.int64(),
            "keyframes": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "media_bytes": pa.int64(), "payload_bytes": pa.int64(),
            "media_sha256": pa.string(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "problem": pa.string(),
        }
        for batch in chunks(batches, "media"):
            found = [describe(x.as_py()) for x in batch.column("media")]
            more = [pa.array([x.get(k) for x in found], kind) for k, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *more], names=[*columns, *kinds])

    return run


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each row's text as a media file.

    The UTF-8 text, padded with spaces to a positive multiple of 192 bytes, becomes
    8-bit samples. A null text is empty. Each row is its own; equal texts give equal
    files; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_store, _FILES)


def media_columns(files: DataFrame) -> DataFrame:
    """Add codec, duration, keyframe ranges and digests to files (doc_id, n_bytes, media).

    Boxes are walked and sample tables decoded; payload bytes are only copied into
    digests. A null or damaged file keeps its row and gets a ``problem``.
    """
    rows = files.select("doc_id", "n_bytes", "media")
    return rows.mapInArrow(_describe(["doc_id", "n_bytes"]), "doc_id long, n_bytes long, " + _ABOUT)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = media_columns(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    spans = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("-", k["start"].cast("string"), k["end"].cast("string"))), ",")
    feature = F.concat_ws(
        ";", F.concat(F.lit("codec="), F.trim("codec")), F.concat(F.lit("duration="), F.col("duration").cast("string"), F.lit("/"), F.col("timescale").cast("string")),
        F.concat(F.lit("samples="), F.col("n_samples").cast("string")), F.concat(F.lit("keyframes="), F.size("keyframes").cast("string")),
        F.concat(F.lit("first="), F.element_at(F.split(spans, ","), 1)), F.concat(F.lit("last="), F.element_at(F.split(spans, ","), -1)),
        F.concat(F.lit("ranges="), F.sha2(spans, 256)),
    )
    return about.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
