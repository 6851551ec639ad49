"""Folders of numbered images as frames, batch or stream."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FRAMES = "session string, frame bigint, ts timestamp, path string, content binary"
SCHEMA = pa.schema([("session", pa.string()), ("frame", pa.int64()), ("ts", pa.timestamp("us", tz="UTC")), ("path", pa.string()), ("content", pa.binary())])
EXTENSIONS = "jpg,jpeg,png,bmp,webp"


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (pyarrow.fs.LocalFileSystem(), path)


class Frames(InputPartition):
    def __init__(self, rows: list[tuple[str, int, str]]):
        self.rows = rows


class Folder:
    """Files <number>.<extension> of a folder (session '') and of folders in it (a session each); the last number in a name counts. Others, and those whose names begin with a dot or an underscore, are passed over."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("give a path to load")
        get = lambda name, default: options.get(name, options.get(name.lower(), default))
        self.path, self.rate = options["path"], float(get("framesPerSecond", 25))
        self.most, self.at_once = int(get("framesPerTrigger", 1 << 31)), int(get("framesPerPartition", 256))
        self.kinds = tuple(k.strip().lower() for k in get("extensions", EXTENSIONS).split(","))

    def found(self) -> dict[str, list[tuple[int, str]]]:
        """Frames of each session by number; of equal numbers the first by name."""
        where, path = opened(self.path)
        out: dict[str, dict[int, str]] = {}
        for f in sorted(where.get_file_info(pyarrow.fs.FileSelector(path, recursive=True, allow_not_found=True)), key=lambda f: f.path):
            inside = f.path[len(path) :].strip("/").split("/")
            number = re.search(r"(\d+)[^\d]*\.\w+$", inside[-1])
            if f.type == pyarrow.fs.FileType.File and len(inside) <= 2 and number and f.extension.lower() in self.kinds and inside[-1][0] not in "._":
                out.setdefault(inside[0] if len(inside) == 2 else "", {}).setdefault(int(number[1]), f.path)
        return {s: sorted(own.items()) for s, own in out.items()}

    def parts(self, rows: list[tuple[str, int, str]]) -> list[Frames]:
        return [Frames(rows[i : i + self.at_once]) for i in range(0, len(rows), self.at_once)] or [Frames([])]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        where = opened(self.path)[0]
        for session, number, path in partition.rows:
            with where.open_input_stream(path) as source:
                row = (session, number, datetime.fromtimestamp(number / self.rate, UTC), path, source.read())
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row, SCHEMA.types, strict=True)], schema=SCHEMA)


class FrameReader(Folder, DataSourceReader):
    def partitions(self) -> list[Frames]:
        return self.parts([(s, n, p) for s, own in sorted(self.found().items()) for n, p in own])


class FrameStream(Folder, DataSourceStreamReader):
    """An offset is the last number of each session. Frames come in order: what is written with a lower number later on is not read."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        done = getattr(self, "done", {})
        self.done = {s: (fresh[min(len(fresh), self.most) - 1] if (fresh := [n for n, _ in own if n > done.get(s, -1)]) else done[s]) for s, own in self.found().items() if own}
        self.done = done | self.done
        return self.done

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        self.done = {s: max(n, getattr(self, "done", {}).get(s, -1)) for s, n in end.items()}
        return self.parts([(s, n, p) for s, own in sorted(self.found().items()) for n, p in own if start.get(s, -1) < n <= end.get(s, -1)])

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    """spark.read or readStream.format("frames").load(folder): session, frame, ts (event time: number / framesPerSecond), path, content. Options: extensions, framesPerSecond, framesPerPartition, framesPerTrigger (of a session)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))

    def streamReader(self, schema) -> FrameStream:
        return FrameStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)


def write_frames(rows: DataFrame, folder: str, extension: str = "png") -> int:
    """Write rows (session, frame, content) as <session>/<frame>.<extension>; how many. A file takes its name when it is whole. A task that is run again writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = opened(folder)
        for batch in batches:
            for session, frame, content in zip(*batch.columns, strict=True):
                place = f"{path}/{session.as_py()}"
                where.create_dir(place)
                with where.open_output_stream(f"{place}/.{frame.as_py()}.{extension}") as out:
                    out.write(content.as_buffer())
                where.move(f"{place}/.{frame.as_py()}.{extension}", f"{place}/{frame.as_py()}.{extension}")
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select(F.col("session").cast("string"), F.col("frame").cast("long"), F.col("content").cast("binary")).mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
