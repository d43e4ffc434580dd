"""A data source over landed files, one partition a file.

    spark.read.format("weftline").schema(..).option("path", root).option("source", id).load()

Files lie as ``<root>/<source>/<landed day>/<name>``, as JSON (an array, or values on lines),
JSON lines, CSV (UTF-8, else the fallback encoding) or RSS by their ending.  They are read
piece by piece, so a task holds a record and a batch, not a file.  Every record becomes a row of
the schema's columns; fields it lacks are null, values that do not fit too.  Columns
``_file`` and ``_landed`` say where a row comes from.  The options ``since``, ``until``
(days, both inclusive) and ``file`` leave out whole files before any is opened.  They are
options, not pushed filters: Spark 4.1 keeps a Python source's pushed filters with the
DataFrame, so a second query on it would miss what only the first one left out.  Roots may
be any that pyarrow's file systems know.

What a source's records have to hold is what its mapping reads: ``raw_schema`` learns it
by analysing the mapping on an empty table, so the two cannot drift apart.
"""

from __future__ import annotations

import codecs
import csv
import inspect
import io
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO, TextIO

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

FORMAT = "weftline"
OWN = ("_file", "_landed")
ROWS = 1000


@dataclass
class LandedFile(InputPartition):
    path: str
    file: str
    landed: str


def _plain(x, kind: T.DataType):
    """A value as its column's type wants it, or None."""
    if x is None:
        return None
    if isinstance(kind, T.StringType):
        return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    if isinstance(kind, T.ArrayType):
        return [_plain(y, kind.elementType) for y in x] if isinstance(x, list) else None
    if isinstance(kind, T.StructType):
        return {f.name: _plain(x.get(f.name), f.dataType) for f in kind} if isinstance(x, dict) else None
    try:
        return bool(x) if isinstance(kind, T.BooleanType) else int(x) if isinstance(kind, (T.IntegerType, T.LongType)) else float(x)
    except (TypeError, ValueError):
        return None


CHUNK = 1 << 16


def _json_values(f: TextIO) -> Iterator:
    """The values of a JSON text that is read piece by piece: one, or one after the other on lines; arrays give their elements."""
    decoder, text, at, ended = json.JSONDecoder(), "", 0, False

    def more() -> None:
        nonlocal text, at, ended
        # as much again as is left, so that a long value is read a few times only
        new = f.read(max(CHUNK, len(text) - at))
        text, at, ended = text[at:] + new, 0, not new

    def blank() -> str:
        """White space up to the next character, which stays unread; none of it is left at the end."""
        nonlocal at
        passed = ""
        while True:
            m = _BLANK.match(text, at)
            passed += m[0]
            at = m.end()
            if at < len(text) or ended:
                return passed
            more()

    def value():
        nonlocal at
        while True:
            try:
                found, end = decoder.raw_decode(text, at)
            except json.JSONDecodeError:
                if ended:
                    raise
            else:
                if end < len(text) or ended:  # a number may go on
                    at = end
                    return found
            more()

    def expect(chars: str) -> str:
        nonlocal at
        blank()
        c = text[at : at + 1]
        if not c or c not in chars:
            raise json.JSONDecodeError(f"Expecting one of {chars}", text, at)
        at += 1
        return c

    blank()
    while at < len(text):
        if text[at] == "[":
            at += 1
            blank()
            if text[at : at + 1] == "]":
                at += 1
            else:
                while True:
                    blank()
                    yield value()
                    if expect(",]") == "]":
                        break
        else:
            yield value()
        if "\n" not in blank() and at < len(text):
            raise json.JSONDecodeError("Extra data", text, at)


_BLANK = re.compile(r"[ \t\n\r]*")


def _items(f: TextIO) -> Iterator[dict]:
    """The items of RSS that is read piece by piece."""
    text, done = "", 0
    while True:
        new = f.read(max(CHUNK, len(text)))
        text += new
        for m in re.finditer(r"(?is)<item[^>]*>(.*?)</item>", text):
            yield {k: re.sub(r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", r"\1", v).strip() for k, v in re.findall(r"(?is)<([\w:]+)[^>]*>(.*?)</\1>", m[1])}
            done = m.end()
        if not new:
            return
        begun = re.search(r"(?i)<item", text[done:])
        text, done = text[done + begun.start() :] if begun else text[max(done, len(text) - 8) :], 0


def encoding_of(f: BinaryIO, fallback: str) -> str:
    """UTF-8 if all bytes of a file are, else the fallback."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        while piece := f.read(CHUNK):
            decoder.decode(piece)
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return fallback
    return "utf-8-sig"


def records(f: BinaryIO, name: str, encoding: str) -> Iterator[dict]:
    """The records of a file, by its ending, read piece by piece: no file is held whole.  What is no record is left out."""
    end = name.rsplit(".", 1)[-1].lower()
    text = io.TextIOWrapper(f, encoding, "strict" if encoding == "utf-8-sig" else "replace", newline="" if end == "csv" else "\n")
    if end == "csv":
        yield from ({(k or "").strip(): v or "" for k, v in row.items() if isinstance(v, str) or v is None} for row in csv.DictReader(text) if any(isinstance(v, str) and v.strip() for v in row.values()))
    elif end in ("ndjson", "jsonl"):
        for line in text:
            if line.strip():
                yield json.loads(line)
    elif end in ("xml", "rss"):
        yield from _items(text)
    else:
        yield from _json_values(text)


class LandedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, dict(options)

    def _kept(self, part: LandedFile) -> bool:
        since, until, file = (self.options.get(k) for k in ("since", "until", "file"))
        return (not since or part.landed >= since) and (not until or part.landed <= until) and (not file or part.file == file)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(self.options["path"])
        found = where.get_file_info(fs.FileSelector(f"{root.rstrip('/')}/{self.options['source']}", recursive=True, allow_not_found=True))
        files = [LandedFile(i.path, i.base_name, i.path.rsplit("/", 2)[-2]) for i in sorted(found, key=lambda i: i.path) if i.is_file and i.base_name[0] not in "._"]
        kept = [p for p in files if self._kept(p)]
        return kept or [LandedFile("", "", "")]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        from pyarrow import fs

        where, _ = fs.FileSystem.from_uri(self.options["path"])
        # two passes over the bytes, the first for the encoding alone
        with where.open_input_stream(part.path) as f:
            encoding = encoding_of(f, self.options.get("fallback", "cp950"))
        arrow = to_arrow_schema(self.schema)
        held: list[dict] = []

        def batch() -> pa.RecordBatch:
            own = {"_file": part.file, "_landed": part.landed}
            columns = [[own[f.name]] * len(held) if f.name in own else [_plain(r.get(f.name), f.dataType) for r in held] for f in self.schema]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

        with where.open_input_stream(part.path) as f:
            for r in records(f, part.file, encoding):
                if isinstance(r, dict):
                    held.append(r)
                if len(held) == ROWS:
                    yield batch()
                    held = []
        if held:
            yield batch()


class Landed(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise ValueError("give the source's schema: .schema(raw_schema(spark, source))")

    def reader(self, schema: T.StructType) -> LandedReader:
        return LandedReader(schema, self.options)


#: Columns that are not text, where a source has them.
NESTED = {
    "teamxports-centers": "week array<string>, avaliableCount int, excludedDate array<struct<date:string,note:string>>, courtTitles array<string>, capacityMax int, price double",
    "changjia-centers": "weekDays array<int>, capacity int, enrolled int",
    "taichung-cc": "capacity int, enrolled int",
    "hualien-cc": "capacity int, enrolled int",
    "taipei-cc": "dayInWeekId array<string>",
    "penghu-cc-portal": "slotsText array<struct<weekdayText:string,timeText:string>>",
}
#: Dimensions that some mappings join, as their columns.
DIMENSIONS = {"schools": "school_id string, region_name string", "sites": "_site string, venueName string, city string, district string, host string"}


def raw_schema(spark: SparkSession, source: str, mapping: Callable[..., DataFrame] | None = None, nested: str | None = None) -> T.StructType:
    """The columns that a source's mapping reads, text unless ``NESTED`` says otherwise, and where a row comes from."""
    from .catalogue import NORMALIZERS

    mapping = mapping or NORMALIZERS[source]
    kinds = {f.name: f for f in spark.createDataFrame([], nested or NESTED.get(source, "_none string")).schema}
    takes = [p for p in inspect.signature(mapping).parameters if p in DIMENSIONS]
    dims = {p: spark.createDataFrame([], DIMENSIONS[p]) for p in takes}
    fields: list[T.StructField] = []
    while True:
        try:
            mapping(spark.createDataFrame([], T.StructType(fields or [T.StructField("_none", T.StringType())])), fetched_at="2000-01-01T00:00:00Z", **dims)
            own = [T.StructField(c, T.StringType()) for c in OWN if c not in {f.name for f in fields}]
            return T.StructType(fields + own)
        except AnalysisException as e:
            name = (e.getMessageParameters() or {}).get("objectName", "").strip("`").replace("``", "`")
            if "UNRESOLVED_COLUMN" not in (e.getCondition() or "") or not name or name in {f.name for f in fields}:
                raise
            fields.append(kinds.get(name, T.StructField(name, T.StringType())))


def landed(spark: SparkSession, path: str, source: str, schema: T.StructType | None = None, since: str | None = None, until: str | None = None, file: str | None = None) -> DataFrame:
    """A source's raw records out of its landed files of some days; files outside are not opened."""
    spark.dataSource.register(Landed)
    reader = spark.read.format(FORMAT).schema(schema or raw_schema(spark, source)).option("path", path).option("source", source)
    for name, value in (("since", since), ("until", until), ("file", file)):
        if value:
            reader = reader.option(name, value)
    return reader.load()


def observed(spark: SparkSession, path: str, source: str, fetched_at: str, since: str | None = None, **dimensions: DataFrame) -> DataFrame:
    """A source's listings out of its landed files: read by day, mapped."""
    from .catalogue import NORMALIZERS

    return NORMALIZERS[source](landed(spark, path, source, since=since), fetched_at=fetched_at, **dimensions)
