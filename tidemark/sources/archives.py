"""A Spark data source for quarterly accounting archives: a partition for each archive and range of bytes of a member."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The members of an accounting archive.
MEMBERS = ("sub", "num", "tag", "pre")
ROWS = 10_000


class Range(InputPartition):
    def __init__(self, file: str, year: int | None, quarter: int | None, start: int, end: int) -> None:
        self.file, self.year, self.quarter, self.start, self.end = file, year, quarter, start, end


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ArchiveSource(DataSource):
    """Options: path, member, range_bytes, years, quarters (comma-joined). The schema names the columns to read besides source_file, fsds_year and fsds_quarter."""

    @classmethod
    def name(cls) -> str:
        return "quarterly_archive"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(schema, self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields[:-3]]
        self.path, self.member, self.step = options["path"], options["member"], int(options["range_bytes"])
        self.years, self.quarters = ({int(x) for x in options.get(k, "").split(",") if x} for k in ("years", "quarters"))

    def partitions(self) -> list[Range]:
        """The directory of each archive tells its members and their sizes; their contents aren't read here."""
        system, root = _store(self.path)
        out = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            if not info.path.lower().endswith(".zip"):
                continue
            label = re.search(r"(\d{4})q([1-4])", info.base_name.lower())
            year, quarter = (int(label[1]), int(label[2])) if label else (None, None)
            if (self.years and year not in self.years) or (self.quarters and quarter not in self.quarters):
                continue
            with system.open_input_file(info.path) as f, zipfile.ZipFile(f) as z:
                sizes = {x.filename: x.file_size for x in z.infolist()}
            if missing := {f"{m}.txt" for m in MEMBERS} - set(sizes):
                raise ValueError(f"{info.path} lacks {sorted(missing)}")
            size = sizes[f"{self.member}.txt"]
            out += [Range(info.path, year, quarter, at, min(at + self.step, size)) for at in range(0, max(size, 1), self.step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """Lines that start in the range. What lies before is unpacked and passed over, as a packed stream has no other way in."""
        system, _ = _store(self.path)
        with system.open_input_file(part.file) as f, zipfile.ZipFile(f) as z, z.open(f"{self.member}.txt") as member:
            lines = io.BufferedReader(member, 1 << 20)
            header = lines.readline()
            at, place = len(header), {c: k for k, c in enumerate(header.decode("utf-8-sig").rstrip("\r\n").split("\t"))}
            while at < part.start and (line := lines.readline()):
                at += len(line)
            held: list[list[str]] = []
            while at < part.end and (line := lines.readline()):
                at += len(line)
                if text := line.decode("utf-8", "replace").rstrip("\r\n"):
                    held.append(text.split("\t"))
                if len(held) == ROWS:
                    yield self._batch(held, place, part)
                    held = []
            if held:
                yield self._batch(held, place, part)

    def _batch(self, rows: list[list[str]], place: dict[str, int], part: Range) -> pa.RecordBatch:
        arrays = []
        for name, kind in self.columns:
            k = place.get(name)
            values = [(r[k] if k is not None and k < len(r) else "") or None for r in rows]
            arrays.append(pa.array(values, pa.string()) if kind == "string" else pa.array([_number(v, kind) for v in values], {"int": pa.int32(), "double": pa.float64()}[kind]))
        n = len(rows)
        arrays += [pa.array([part.file] * n, pa.string()), pa.array([part.year] * n, pa.int32()), pa.array([part.quarter] * n, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, [*(c for c, _ in self.columns), "source_file", "fsds_year", "fsds_quarter"])


def _number(text: str | None, kind: str) -> float | int | None:
    try:
        value = float(text) if text is not None and "_" not in text else None
    except ValueError:
        return None
    if value is None or value != value or abs(value) == float("inf"):
        return None
    if kind == "double":
        return value
    return int(value) if value == int(value) and abs(value) < 2**31 else None
