"""Notes of MIDI files: the public format of standard MIDI files, read in Arrow batches."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTES = "file string, onset bigint, duration bigint, pitch int, velocity int, channel int, track int, resolution int"
#: Data bytes that follow a channel message, by its kind.
_DATA = {0x8: 2, 0x9: 2, 0xA: 2, 0xB: 2, 0xC: 1, 0xD: 1, 0xE: 2}


class NotMidi(ValueError):
    pass


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of variable length and the place after it."""
    value = 0
    while True:
        byte = data[at]
        at += 1
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            return value, at


def _track(data: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """``(onset, duration, pitch, velocity, channel)`` of a track; a note that never ends ends with the track."""
    at = now = status = 0
    sounding: dict[tuple[int, int], deque] = defaultdict(deque)
    while at < len(data):
        wait, at = _number(data, at)
        now += wait
        if data[at] >= 0x80:
            status = data[at]
            at += 1
        if status == 0xFF:
            kind = data[at]
            size, at = _number(data, at + 1)
            at += size
            if kind == 0x2F:
                break
            continue
        if status in (0xF0, 0xF7):
            size, at = _number(data, at)
            at += size
            continue
        if status >> 4 not in _DATA:
            raise NotMidi(f"status {status}")
        kind, channel = status >> 4, status & 15
        first, second = data[at], data[at + 1] if _DATA[kind] == 2 else 0
        at += _DATA[kind]
        if kind == 9 and second:
            sounding[channel, first].append((now, second))
        elif kind in (8, 9) and sounding[channel, first]:
            onset, velocity = sounding[channel, first].popleft()
            yield onset, now - onset, first, velocity, channel
    for (channel, pitch), left in sounding.items():
        for onset, velocity in left:
            yield onset, now - onset, pitch, velocity, channel


def notes_of(data: bytes) -> tuple[int, list[tuple[int, int, int, int, int, int]]]:
    """Ticks a quarter note and ``(onset, duration, pitch, velocity, channel, track)`` of a file, in order of onset."""
    try:
        if data[:4] != b"MThd" or len(data) < 14:
            raise NotMidi("no header")
        resolution = int.from_bytes(data[12:14], "big")
        if not 0 < resolution < 0x8000:
            raise NotMidi("time is not given in parts of a quarter")
        at, found, number = 8 + int.from_bytes(data[4:8], "big"), [], 0
        while at + 8 <= len(data):
            size = int.from_bytes(data[at + 4 : at + 8], "big")
            if data[at : at + 4] == b"MTrk":
                found += [(*n, number) for n in _track(data[at + 8 : at + 8 + size])]
                number += 1
            at += 8 + size
    except IndexError:
        raise NotMidi("cut off") from None
    return resolution, sorted(found)


def notes(files: DataFrame, file: str = "path", content: str = "content") -> DataFrame:
    """``NOTES`` of all files; null contents and what is no MIDI file have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, data in zip(b["file"].to_pylist(), b["content"].to_pylist(), strict=True):
                try:
                    resolution, found = notes_of(data)
                except NotMidi:
                    continue
                rows += [(name, *n, resolution) for n in found]
            kinds = (pa.string(), pa.int64(), pa.int64(), *[pa.int32()] * 5)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split(" ")[0] for f in NOTES.split(", ")])

    return files.where(F.col(content).isNotNull()).select(F.col(file).alias("file"), F.col(content).alias("content")).mapInArrow(run, NOTES)
