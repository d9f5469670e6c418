"""Archives of big-endian 32-bit records as a data source: ``spark.read.format("gridarchive")``.

A file holds the records of one time, each a padded image; a record's name and level come from the option ``records`` or
from the text file beside it. Files may be members of tar and zip archives. What is picked by name, level and day is given as options
and as filters, which the scan takes over: files of other days aren't opened, and of the others only the bytes of the
records picked are read.

Other filters are left to Spark. It keeps one state for each loaded table, so filters that the reader took from one use of the table
would hold for another, as in a union of two selections; picks are the table's own, so they are the same in every use.
"""

from __future__ import annotations

import functools
import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual
from pyspark.sql.types import StructType

from .binary import FILL, record_words

FORMAT = "gridarchive"
COLUMNS = "path string, day date, name string, level double, parts long, y long, x long, value double"
SCHEMA = pa.schema([("path", pa.string()), ("day", pa.date32()), ("name", pa.string()), ("level", pa.float64()), ("parts", pa.int64()), ("y", pa.int64()), ("x", pa.int64()), ("value", pa.float64())])
#: A day in a file's name, as year and day of year or as year, month and day; a year in an archive's.
DAY_OF_YEAR, DAY_OF_MONTH, YEAR = re.compile(r"(\d{4})_(\d{3})(?!\d)"), re.compile(r"(?<!\d)(\d{8})(?:\d\d)?(?!\d)"), re.compile(r"(?<!\d)(\d{4})(?!\d)")

@dataclass(frozen=True)
class Picks:
    """The names, and the ranges of levels and of days, ends included, that are read; None is any."""

    names: tuple[str, ...] | None = None
    levels: tuple[float | None, float | None] = (None, None)
    days: tuple[date | None, date | None] = (None, None)

    @classmethod
    def of(cls, options: dict[str, str]) -> Picks:
        level, day = (lambda k: float(options[k]) if k in options else None), (lambda k: date.fromisoformat(options[k]) if k in options else None)
        names = tuple(n.strip() for n in options["names"].split(",")) if "names" in options else None
        return cls(names, (level("least_level"), level("most_level")), (day("first_day"), day("last_day")))

    def options(self) -> dict[str, str]:
        given = {"names": self.names and ",".join(self.names), "least_level": self.levels[0], "most_level": self.levels[1], "first_day": self.days[0], "last_day": self.days[1]}
        return {k: str(v) for k, v in given.items() if v is not None}

    def filters(self) -> list[Filter]:
        """The same as filters."""
        out: list[Filter] = [] if self.names is None else [In(("name",), self.names) if len(self.names) > 1 else EqualTo(("name",), self.names[0])]
        for column, ends in (("level", self.levels), ("day", self.days)):
            out += [kind((column,), end) for kind, end in zip((GreaterThanOrEqual, LessThanOrEqual), ends, strict=True) if end is not None]
        return out

    def columns(self) -> list[Column]:
        """The same as conditions on a table's columns."""
        out = [] if self.names is None else [F.col("name").isin(*self.names)]
        for column, (least, most) in (("level", self.levels), ("day", self.days)):
            out += [F.col(column) >= F.lit(least)] * (least is not None) + [F.col(column) <= F.lit(most)] * (most is not None)
        return out

    def record(self, name: str, level: float | None) -> bool:
        return (self.names is None or name in self.names) and _between(level, self.levels)

    def day(self, day: date | None) -> bool:
        return _between(day, self.days)

    def year(self, year: int) -> bool:
        """Whether a day of the year may be among the days."""
        first, last = self.days
        return (first is None or first <= date(year, 12, 31)) and (last is None or last >= date(year, 1, 1))


def _between(value, ends: tuple) -> bool:
    """Whether a value lies between ends; none does if there are any."""
    least, most = ends
    return value is not None and (least is None or value >= least) and (most is None or value <= most) if ends != (None, None) else True


@dataclass(frozen=True)
class Record:
    """A record's name, level (none for a surface) and of how many times it is the mean, if that is known."""

    name: str
    level: float | None = None
    parts: int | None = None


def records_of(text: str) -> list[Record]:
    """Records in a file's order, as in "temp:0,temp:100,ssh"."""
    return [Record(n, float(z) if z else None) for n, _, z in (r.strip().partition(":") for r in text.split(",") if r.strip())]


def described(text: str) -> list[Record]:
    """Records from the text file beside an archive: lines of a name, "=", the number of times averaged and, for a layer, its level."""
    out = []
    for line in text.splitlines():
        name, equals, rest = line.partition("=")
        if equals and (values := rest.split()):
            out.append(Record(name.strip(), float(values[1]) if len(values) > 1 else None, int(values[0])))
    return out


def day_in(name: str) -> date | None:
    """The day that a file's name tells."""
    if m := DAY_OF_YEAR.search(name):
        return date(int(m[1]), 1, 1) + timedelta(int(m[2]) - 1)
    return datetime.strptime(m[1], "%Y%m%d").date() if (m := DAY_OF_MONTH.search(name)) else None


def store(path: str) -> tuple[files.FileSystem, str]:
    """The file system of a path and the path in it."""
    if ":" not in path.split("/")[0]:
        return files.LocalFileSystem(), path
    return files.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


@dataclass(frozen=True)
class File:
    """A file or an archive of files to read, its day and its size."""

    path: str
    day: date | None
    size: int


@dataclass
class Files(InputPartition):
    """What a task reads, one after the other."""

    files: list[File]


#: So many files have a task each; of more, a task takes neighbours of so many bytes, an open file counting as some.
ALONE, TASK_BYTES, OPEN_BYTES = 256, 8 << 20, 1 << 16


def dealt(files: list[File]) -> list[Files]:
    """Files as tasks, whose number grows with the bytes, not with how many files hold them."""
    if len(files) <= ALONE:
        return [Files([f]) for f in files]
    weight = np.array([f.size + OPEN_BYTES for f in files], float)
    tasks = min(len(files), max(ALONE, -(-int(weight.sum()) // TASK_BYTES)))
    task = np.floor((weight.cumsum() - weight / 2) / weight.sum() * tasks).astype(int)
    ends = [*(np.flatnonzero(np.diff(task)) + 1).tolist(), len(files)]
    return [Files(files[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.stride = options["path"], int(options.get("stride", "1"))
        self.shape = tuple(int(n) for n in options["shape"].split(","))
        self.records = records_of(options["records"]) if "records" in options else None
        self.picks = Picks.of(options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes over those that say the same as the picks; none of the others is kept."""
        own = self.picks.filters()
        for f in filters:
            if not any(f == p or isinstance(f, In) and isinstance(p, In) and f.attribute == p.attribute and set(f.value) == set(p.value) for p in own):
                yield f

    def partitions(self) -> list[Files]:
        """The files that may hold what is asked for, from names alone, dealt to tasks."""
        system, path = store(self.path)
        found = system.get_file_info(files.FileSelector(path, recursive=True)) if system.get_file_info(path).type == files.FileType.Directory else system.get_file_info([path])
        out = []
        for name, size in sorted((i.path, i.size or 0) for i in found if i.type == files.FileType.File):
            last = name.rpartition("/")[2]
            if is_archive(last):
                if not (m := YEAR.search(last)) or self.picks.year(int(m[1])):
                    out.append(File(name, None, size))
            elif last.endswith(".a") and self.picks.day(day_in(last)) and (self.records is None or any(self.picks.record(r.name, r.level) for r in self.records)):
                out.append(File(name, day_in(last), size))
        return dealt(out)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for file in partition.files:
            yield from self.read_file(file)

    def read_file(self, file: File) -> Iterator[pa.RecordBatch]:
        system, _ = store(self.path)
        with system.open_input_file(file.path) as f:
            if not is_archive(file.path):
                text = None
                if self.records is None:
                    with system.open_input_stream(file.path.removesuffix(".a") + ".b") as b:
                        text = b.read().decode()
                yield from self.decoded(file.path, file.day, f, f.size(), text)
                return
            with members(file.path, f) as (names, opened):
                for name in names:
                    day = day_in(name.rpartition("/")[2])
                    if name.endswith(".a") and self.picks.day(day):
                        beside = name.removesuffix(".a") + ".b"
                        content = opened(name)
                        yield from self.decoded(f"{file.path}!{name}", day, io.BytesIO(content), len(content), opened(beside).decode() if self.records is None else None)

    def decoded(self, path: str, day: date | None, f, size: int, text: str | None) -> Iterator[pa.RecordBatch]:
        """A batch for each record asked for; only its bytes are read. A file of another length is an error."""
        records = self.records if text is None else described(text)
        words, (ny, nx) = record_words(self.shape), self.shape
        if size != 4 * words * len(records):
            raise ValueError(f"{path} has {size} bytes: {size / 4 / words:g} records, not {len(records)}")
        y, x = (a.ravel() for a in np.meshgrid(np.arange(0, ny, self.stride), np.arange(0, nx, self.stride), indexing="ij"))
        for k, r in enumerate(records):
            if self.picks.record(r.name, r.level):
                f.seek(4 * words * k)
                v = np.frombuffer(f.read(4 * ny * nx), ">f4").reshape(ny, nx)[:: self.stride, :: self.stride].ravel().astype(float)
                n = len(v)
                columns = [[path] * n, [day] * n, [r.name] * n, [r.level] * n, [r.parts] * n, y, x]
                arrays = [pa.array(c, t.type) for c, t in zip(columns, SCHEMA, strict=False)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(v, mask=~(np.abs(v) < FILL))], schema=SCHEMA)


def is_archive(name: str) -> bool:
    return name.endswith((".tar", ".tar.gz", ".tgz", ".zip"))


class members:
    """The names of an archive's members, and a function that gives one's bytes."""

    def __init__(self, path: str, f):
        self.held = zipfile.ZipFile(f) if path.endswith(".zip") else tarfile.open(fileobj=f)  # noqa: SIM115

    def __enter__(self) -> tuple[list[str], Callable[[str], bytes]]:
        if isinstance(self.held, zipfile.ZipFile):
            return self.held.namelist(), self.held.read
        return self.held.getnames(), lambda name: self.held.extractfile(name).read()

    def __exit__(self, *_: object) -> None:
        self.held.close()


class GridArchive(DataSource):
    """Options: path (a file or a folder), shape ("rows,columns"), records (else the text file beside each file), stride, names, least_level, most_level, first_day, last_day."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, which pushes filters down to it."""
    spark.dataSource.register(GridArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_archive(spark: SparkSession, path: str, shape: tuple[int, int], records: str | None = None, stride: int = 1, picks: Picks = Picks()) -> DataFrame:
    """(path, day, name, level, parts, y, x, value) of what is picked of an archive; fills are null."""
    register(spark)
    reader = spark.read.format(FORMAT).option("shape", f"{shape[0]},{shape[1]}").option("stride", stride).options(**picks.options())
    rows = (reader if records is None else reader.option("records", records)).load(path)
    return functools.reduce(DataFrame.where, picks.columns(), rows)


def write_archive(df: DataFrame, folder: str, shape: tuple[int, int], records: list[Record], file: Callable[[tuple], str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(path, files, bytes) of what a job wrote from ``df`` (by..., day, name, level, y, x, value): a file for each day, or with ``file`` an archive for each group of ``by``.

    ``file`` gives an archive's name from the group's key. Records that know of how many times they are the mean get a
    text file beside them. A file is written under another name and moved when it is whole, so a task may run twice.
    """
    words, (ny, nx) = record_words(shape), shape
    place = {(r.name, r.level): k for k, r in enumerate(records)}
    told = "".join(f"{r.name} = {r.parts}{'' if r.level is None else f' {r.level:g}'}\n" for r in records) if records[0].parts is not None else None
    by = by or ["day"]

    def image(p: pd.DataFrame) -> bytes:
        out = np.full((len(records), words), 2 * FILL, ">f4")  # what has no row is a fill
        at = [place[n, None if pd.isna(z) else z] for n, z in zip(p["name"], p["level"], strict=True)]
        out[at, p["y"].to_numpy() * nx + p["x"].to_numpy()] = p["value"].fillna(2 * FILL).to_numpy()
        return out.tobytes()

    def write(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        made = [(f"a.{d:%Y_%j}_00", image(rows)) for d, rows in p.groupby("day")]
        if file is None:
            contents = [(f"{made[0][0]}.a", made[0][1])] + ([(f"{made[0][0]}.b", told.encode())] if told else [])
        else:
            buffer, name = io.BytesIO(), file(key)
            entries = [(f"{n}.a", b) for n, b in made] + [(f"{n}.b", told.encode()) for n, _ in made if told]
            if name.endswith(".zip"):
                with zipfile.ZipFile(buffer, "w") as z:
                    for n, b in entries:
                        z.writestr(n, b)
            else:
                with tarfile.open(fileobj=buffer, mode="w") as t:
                    for n, b in entries:
                        info = tarfile.TarInfo(n)
                        info.size = len(b)
                        t.addfile(info, io.BytesIO(b))
            contents = [(name, buffer.getvalue())]
        system, path = store(folder)
        for name, content in contents:
            full, part = f"{path}/{name}", f"{path}/.{name.replace('/', '.')}.part"
            system.create_dir(full.rpartition("/")[0], recursive=True)
            with system.open_output_stream(part) as out:
                out.write(content)
            system.move(part, full)
        return pd.DataFrame({"path": [f"{path}/{contents[0][0]}"], "files": [len(made)], "bytes": [sum(len(c) for _, c in contents)]})

    return df.select(*by, *(c for c in ("day", "name", "level", "y", "x", "value") if c not in by)).groupBy(*by).applyInPandas(write, "path string, files long, bytes long")


def expected(found: DataFrame, wanted: list[str]) -> DataFrame:
    """``found`` (path...), or an error that names the wanted files that are not among them."""
    there = {r[0] for r in found.select("path").distinct().collect()}
    if missing := [w for w in wanted if not any(p.endswith(w) for p in there)]:
        raise FileNotFoundError(f"not in the archive: {', '.join(missing)}")
    return found

