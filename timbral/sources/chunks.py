"""A data source of waveform chunks, to read as a table or a stream, and a sink of waveform files.

Register WaveformChunks with spark.dataSource.register(); then spark.read / spark.readStream with
format("waveform_chunks") and load(folder) give one row per chunk, and write / writeStream to it
store one file per row. Tasks open files by path: the folder must be one that the driver and all
executors share (a mounted file system); anything else is to be read with sources.wav.
"""

from __future__ import annotations

import os
import uuid
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from timbral.sources.wav import decode_wav, encode_wav

SCHEMA = "file string, chunk long, start_s double, sr int, samples array<double>"
#: Chunks that one task reads at most, so that a long file is read by many.
SPAN = 4096


@dataclass
class Span(InputPartition):
    """Chunks first to last - 1 of a file."""

    file: str
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    """(temporary path, path) of the files of a task."""

    files: tuple[tuple[str, str], ...]


def _folder(options: dict) -> str:
    path = options.get("path", "")
    if "://" in path or not path:
        path = path.removeprefix("file://")
        if not path or "://" in path:
            raise ValueError("load() a folder that all machines share, by its path")
    return path.removeprefix("file:") if path.startswith("file:") else path


def _names(folder: str) -> list[str]:
    """Waveform files in the order of their names; those whose name starts with . or _ are not there yet."""
    return sorted(n for n in os.listdir(folder) if n.endswith(".wav") and n[0] not in "._")


def _chunks(path: str, size: int) -> int:
    try:
        with wave.open(path, "rb") as f:
            return -(-f.getnframes() // size)
    except (wave.Error, EOFError):
        return 0


class _Chunks:
    """What the table reader and the stream reader share."""

    def __init__(self, options: dict) -> None:
        self.folder, self.size = _folder(options), int(options.get("chunk", 2048))

    def spans(self, file: str, first: int, last: int) -> list[Span]:
        return [Span(file, a, min(a + SPAN, last)) for a in range(first, last, SPAN)]

    def read(self, partition: Span) -> Iterator[tuple]:
        """The chunks of a span; the last one of a file may be shorter. Channels are averaged."""
        with wave.open(os.path.join(self.folder, partition.file), "rb") as f:
            rate, channels, width = f.getframerate(), f.getnchannels(), f.getsampwidth()
            f.setpos(partition.first * self.size)
            for k in range(partition.first, partition.last):
                raw = f.readframes(self.size)
                head = b"RIFF" + (36 + len(raw)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little")
                head += channels.to_bytes(2, "little") + rate.to_bytes(4, "little") + (rate * channels * width).to_bytes(4, "little")
                head += (channels * width).to_bytes(2, "little") + (8 * width).to_bytes(2, "little") + b"data" + len(raw).to_bytes(4, "little")
                _, _, x = decode_wav(head + raw)
                yield partition.file, k, k * self.size / rate, rate, x.astype(float).tolist()


class _TableReader(_Chunks, DataSourceReader):
    def partitions(self) -> list[Span]:
        return [s for n in _names(self.folder) for s in self.spans(n, 0, _chunks(os.path.join(self.folder, n), self.size))]


class _StreamReader(_Chunks, DataSourceStreamReader):
    """An offset is a file and how many of its chunks are done, with all files before it in the
    order of names. So it is of one size whatever has been read, and a restart goes on behind the
    last committed batch: no chunk is lost or read twice. New files must sort behind those there."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "chunks": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        names = _names(self.folder)
        return {"file": names[-1], "chunks": _chunks(os.path.join(self.folder, names[-1]), self.size)} if names else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Span]:
        found = []
        for n in _names(self.folder):
            if start["file"] <= n <= end["file"]:
                first = start["chunks"] if n == start["file"] else 0
                last = end["chunks"] if n == end["file"] else _chunks(os.path.join(self.folder, n), self.size)
                found += self.spans(n, first, last)
        return found

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        """Nothing is held open between batches; what was not read is read by the next start."""


class _Sink:
    """A task writes its files under names that no reader lists; the commit gives them theirs.
    A task that fails or runs twice leaves nothing to be read, and a batch that is committed twice
    replaces its files by the same ones."""

    def __init__(self, options: dict) -> None:
        self.folder = _folder(options)

    def write(self, iterator: Iterator) -> Written:
        files = []
        os.makedirs(self.folder, exist_ok=True)
        for row in iterator:
            name = os.path.basename(str(row["file"]))
            name = name if name.endswith(".wav") else f"{name}.wav"
            temporary = os.path.join(self.folder, f"_{uuid.uuid4().hex}-{name}")
            with open(temporary, "wb") as out:
                samples = [0.0 if v is None else v for v in row["samples"] or []]
                out.write(encode_wav(np.array(samples, float), int(row["sr"])))
            files.append((temporary, os.path.join(self.folder, name)))
        return Written(tuple(files))

    def _commit(self, messages: list) -> None:
        for message in messages:
            for temporary, path in message.files if message else ():
                if os.path.exists(temporary):
                    os.replace(temporary, path)

    def _abort(self, messages: list) -> None:
        for message in messages:
            for temporary, _ in message.files if message else ():
                if os.path.exists(temporary):
                    os.remove(temporary)


class _TableWriter(_Sink, DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        super().__init__(options)
        self.overwrite = overwrite

    def commit(self, messages: list) -> None:
        new = {path for m in messages if m for _, path in m.files}
        if self.overwrite:
            for name in _names(self.folder) if os.path.isdir(self.folder) else []:
                if os.path.join(self.folder, name) not in new:
                    os.remove(os.path.join(self.folder, name))
        self._commit(messages)

    def abort(self, messages: list) -> None:
        self._abort(messages)


class _StreamWriter(_Sink, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._commit(messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._abort(messages)


class WaveformChunks(DataSource):
    """Rows (file, chunk, start_s, sr, samples from -1 to 1), `chunk` samples each (option,
    2,048). S02: rows with file, sr and samples are written as 16-bit files; values beyond -1 and 1
    are clipped, null samples are 0, a null array is an empty file. Files that are no waveforms
    have no chunks."""

    @classmethod
    def name(cls) -> str:
        return "waveform_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TableReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _TableWriter(self.options, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _StreamWriter(self.options)
