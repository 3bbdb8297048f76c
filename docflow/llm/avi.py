"""AVI motion-JPEG columns: containers, frame decoding, shot detection and timed clips.

A container is read by its RIFF chunks and its idx1 index (or, without an index, by walking the
movi list). Frames are decoded one by one; the luma histogram of each is compared with that of
the frame before, and a shot ends where the difference stands out from those of its own shot.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm import jpeg
from docflow.llm.arrow import map_rows, utf8

#: Frames of stored texts: units across and down, frames a second.
COLUMNS, ROWS, RATE = 8, 4, 25


class AviError(ValueError):
    """The bytes are not an AVI container that can be read."""


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def write_avi(frames: list[bytes], width: int, height: int, rate: int = RATE) -> bytes:
    """A container of one motion-JPEG stream with an idx1 index."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    movie, index, place = [], [], 4
    for frame in frames:
        movie.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, place, len(frame)))
        place += len(movie[-1])
    return _chunk(b"RIFF", b"AVI " + head + _list(b"movi", b"".join(movie)) + _chunk(b"idx1", b"".join(index)))


def chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, body's start, body's end) of the chunks in data[start:end]."""
    while start + 8 <= end:
        size = struct.unpack_from("<I", data, start + 4)[0]
        if start + 8 + size > end:
            raise AviError("a chunk runs over its list")
        yield data[start : start + 4], start + 8, start + 8 + size
        start += 8 + size + size % 2


@dataclass
class Movie:
    """rate: frames a second; frames: (start, end) of each in the data."""

    rate: float
    width: int
    height: int
    frames: list[tuple[int, int]]


def movie_frames(data: bytes, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Frames of a movi list in order, those in its 'rec ' lists too."""
    lists = [chunks(data, start, end)]
    while lists:
        for name, a, b in lists[-1]:
            if name == b"LIST" and data[a : a + 4] == b"rec ":
                lists.append(chunks(data, a + 4, b))
                break
            if name[2:] in (b"dc", b"db") and b > a:
                yield a, b
        else:
            lists.pop()


def further_frames(data: bytes, place: int) -> Iterator[tuple[int, int]]:
    """Frames of the AVIX segments (OpenDML) that follow the first RIFF chunk."""
    while data[place : place + 4] == b"RIFF":
        end = place + 8 + struct.unpack_from("<I", data, place + 4)[0]
        if end > len(data):
            raise AviError("a RIFF chunk runs over the data")
        if data[place + 8 : place + 12] == b"AVIX":
            for name, a, b in chunks(data, place + 12, end):
                if name == b"LIST" and data[a : a + 4] == b"movi":
                    yield from movie_frames(data, a + 4, b)
        place = end + end % 2


def read_avi(data: bytes) -> Movie:
    """Header and frame places of a container; frames by index, else by walking movi, then those of AVIX segments."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise AviError("no AVI container")
    rate, width, height, movi, index, codec = 0.0, 0, 0, None, None, b""
    end = min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    for name, a, b in chunks(data, 12, end):
        if name == b"LIST" and data[a : a + 4] == b"movi":
            movi = (a, b)
        elif name == b"idx1":
            index = (a, b)
        elif name == b"LIST" and data[a : a + 4] == b"hdrl":
            for inner, c, d in chunks(data, a + 4, b):
                if inner == b"avih":
                    per_frame = struct.unpack_from("<I", data, c)[0]
                    rate = 1e6 / per_frame if per_frame else 0.0
                    width, height = struct.unpack_from("<II", data, c + 32)
                elif inner == b"LIST" and data[c : c + 4] == b"strl":
                    for part, e, _ in chunks(data, c + 4, d):
                        if part == b"strh" and data[e : e + 4] == b"vids" and not codec:
                            codec = data[e + 4 : e + 8]
                            scale, per = struct.unpack_from("<II", data, e + 20)
                            rate = per / scale if scale and per else rate
    if movi is None or codec.upper() != b"MJPG":
        raise AviError("no motion-JPEG stream")
    frames: list[tuple[int, int]] = []
    if index:
        for a in range(index[0], index[1] - 15, 16):
            name, _, offset, size = struct.unpack_from("<4sIII", data, a)
            if name[2:] in (b"dc", b"db") and size:
                # Offsets count from the list's kind; some writers count from the file's start.
                place = movi[0] + offset if data[movi[0] + offset : movi[0] + offset + 4] == name else offset
                frames.append((place + 8, place + 8 + size))
    else:
        frames = list(movie_frames(data, movi[0] + 4, movi[1]))
    frames += further_frames(data, end + end % 2)
    if any(b > len(data) for _, b in frames):
        raise AviError("an index entry runs over the data")
    return Movie(rate or float(RATE), width, height, frames)


@dataclass(frozen=True)
class ShotParams:
    """A cut: a difference over ``floor`` and over mean + ``spread`` deviations of its shot so far."""

    bins: int = 16
    floor: float = 0.12
    spread: float = 3.0
    warm: int = 2


@dataclass
class Clip:
    start_frame: int
    end_frame: int
    start_s: float
    end_s: float
    luma: float
    change: float


def histogram(luma: np.ndarray, bins: int) -> np.ndarray:
    return np.bincount(luma.ravel().astype(np.int64) * bins >> 8, minlength=bins) / max(1, luma.size)


def find_clips(histograms: list[np.ndarray], lumas: list[float], rate: float, params: ShotParams = ShotParams()) -> list[Clip]:
    """Clips of consecutive frames; mean and deviation of the differences start anew in each shot."""
    clips: list[Clip] = []
    start, seen, total, squares, most = 0, 0, 0.0, 0.0, 0.0

    def close(end: int) -> None:
        clips.append(Clip(start, end, start / rate, end / rate, float(np.mean(lumas[start:end])), most))

    for i in range(1, len(histograms)):
        change = float(np.abs(histograms[i] - histograms[i - 1]).sum() / 2)
        mean = total / seen if seen else 0.0
        deviation = max(0.0, squares / seen - mean * mean) ** 0.5 if seen else 0.0
        if seen >= params.warm and change > max(params.floor, mean + params.spread * deviation) or seen < params.warm and change > 4 * params.floor:
            close(i)
            start, seen, total, squares, most = i, 0, 0.0, 0.0, 0.0
            continue
        seen, total, squares, most = seen + 1, total + change, squares + change * change, max(most, change)
    if histograms:
        close(len(histograms))
    return clips


def analyse(data: bytes, params: ShotParams = ShotParams(), with_payload: bool = False) -> tuple[Movie, list[Clip], bytes]:
    """Movie, clips and, if asked for, the bytes stored in the frames; one frame in memory at a time."""
    movie = read_avi(data)
    histograms, lumas, payload = [], [], []
    for a, b in movie.frames:
        frame = jpeg.decode(data[a:b])
        luma = frame.luma()
        histograms.append(histogram(luma, params.bins))
        lumas.append(float(luma.mean()))
        if with_payload:
            payload.append(frame.payload())
    return movie, find_clips(histograms, lumas, movie.rate, params), b"".join(payload)


def avi_clips(media: DataFrame, params: ShotParams = ShotParams()) -> DataFrame:
    """(id long, avi binary) -> timed clip rows: id, clip, start_frame, end_frame, start_s, end_s, luma, change, error.

    A null, empty or unreadable container gives one row with null clip columns and the error; a
    container without frames gives none. Repeated rows give repeated clips.
    """
    fields = [("id", pa.int64()), ("clip", pa.int32()), ("start_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("luma", pa.float64()), ("change", pa.float64()), ("error", pa.string())]
    out = pa.schema(fields)

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        rows: list[tuple] = []
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                _, clips, _ = analyse(value.as_py() or b"", params)
                rows += [(key, k, c.start_frame, c.end_frame, c.start_s, c.end_s, c.luma, c.change, None) for k, c in enumerate(clips)]
            except (AviError, jpeg.JpegError, struct.error, IndexError) as error:
                rows.append((key, *[None] * 7, str(error)[:200] or type(error).__name__))
        return {name: [r[k] for r in rows] for k, (name, _) in enumerate(fields)}

    schema = "id long, clip int, start_frame int, end_frame int, start_s double, end_s double, luma double, change double, error string"
    return map_rows(media, ["id", "avi"], schema, work, out)


def pad(text: bytes) -> bytes:
    """The text and spaces up to a positive multiple of a unit."""
    return text + b" " * (-len(text) % jpeg.UNIT if text else jpeg.UNIT)


def store_text(text: bytes) -> bytes:
    """A container whose frames hold the padded text losslessly in their coefficients."""
    payload, size = pad(text), COLUMNS * ROWS * jpeg.UNIT
    frames = [jpeg.store(payload[i : i + size], COLUMNS, ROWS) for i in range(0, len(payload), size)]
    return write_avi(frames, 8 * COLUMNS, 8 * ROWS)


def store_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, text) -> (id, avi): every whole text (null: empty) as a container."""
    out = pa.schema([("id", pa.int64()), ("avi", pa.binary())])

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        return {"id": batch.column(0), "avi": [store_text(t or b"") for t in utf8(batch.column(1))]}

    return map_rows(documents.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], "id long, avi binary", work, out)


def feature(movie: Movie, clips: list[Clip]) -> str:
    """Frames, clips, their ends in seconds (16 at most, then the number left), luma and a digest of all ends, as text."""
    ends = ",".join(f"{c.end_s:.2f}" for c in clips[:16]) + (f",+{len(clips) - 16}" if len(clips) > 16 else "")
    luma = sum(c.luma * (c.end_frame - c.start_frame) for c in clips) / max(1, len(movie.frames))
    every = hashlib.sha256(",".join(str(c.end_frame) for c in clips).encode()).hexdigest()[:16]
    return f"frames={len(movie.frames)};clips={len(clips)};ends={ends};luma={luma:.3f};all_ends={every}"


def op4_avi_media(documents: DataFrame) -> DataFrame:
    """Every whole text stored as a motion-JPEG container, read back and cut into clips.

    doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 of the bytes read back,
    media_bytes, media_sha256, feature, n_clips. Null and empty texts are a unit of spaces.
    The container is made in memory and parsed from its bytes there; `store_documents` and
    `avi_clips` are the two halves with a column of containers, or files, between them, the latter
    with a row for each timed clip. Nothing is shuffled; memory holds one batch of texts, one
    container and one frame.
    """
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips long"
    out = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            media = store_text(text or b"")
            movie, clips, payload = analyse(media, with_payload=True)
            rows.append((key, len(text or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(movie, clips), len(clips)))
        return {name: [r[k] for r in rows] for k, name in enumerate(out.names)}

    return map_rows(documents.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], schema, work, out)
