"""Large files as byte ranges: a data source of ranges with halos, and carving over them as over whole files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from doclens.sources.tables import written

RANGES = "path STRING, length BIGINT, start BIGINT, size BIGINT, before BIGINT, content BINARY"
#: Bytes of a range; bytes read beyond it on either side, which hold any mark and any bounded string that starts in it.
RANGE_BYTES, HALO = 8 << 20, 1024
#: Bytes that one task reads, in whole ranges.
TASK_BYTES = 32 << 20


@dataclass
class FileRanges(InputPartition):
    """Ranges (path, length, start, size) that one task reads."""

    ranges: list[tuple[str, int, int, int]]


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes") or options.get("rangeBytes") or RANGE_BYTES)
        self.halo = int(options.get("halo") or HALO)
        self.task_bytes = int(options.get("taskbytes") or options.get("taskBytes") or TASK_BYTES)

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[FileRanges]:
        system, top = self._system()
        info = system.get_file_info(top)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(top, recursive=True))
        tasks, size = [FileRanges([])], 0
        for f in sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            for start in range(0, f.size, self.range_bytes):
                n = min(self.range_bytes, f.size - start)
                if size and size + n > self.task_bytes:
                    tasks.append(FileRanges([]))
                    size = 0
                tasks[-1].ranges.append((f.path, f.size, start, n))
                size += n
        return tasks

    def read(self, partition: FileRanges) -> Iterator[tuple]:
        system, _ = self._system()
        for path, length, start, size in partition.ranges:
            before = min(self.halo, start)
            with system.open_input_file(path) as f:
                content = f.read_at(min(before + size + self.halo, length - start + before), start - before)
            yield path, length, start, size, before, content


class ArtifactRanges(DataSource):
    """S1 for files of any size: rows (path, length, start, size, before, content).

    A range is size bytes from start; content has them with before bytes of halo ahead and as many
    behind as the option halo and the file allow. Options: path (any URI that Arrow opens), rangeBytes,
    halo, taskBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "artifact_ranges"

    def schema(self) -> str:
        return RANGES

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def scan_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, halo: int = HALO) -> DataFrame:
    spark.dataSource.register(ArtifactRanges)
    return spark.read.format("artifact_ranges").option("rangeBytes", range_bytes).option("halo", halo).load(path)


@dataclass(frozen=True)
class Kind:
    """What to carve: matches of pattern, all of which lie within runs of run, a set of characters.

    longest bounds a match; without it a match may be a whole run. So matches of a run
    depend on where the run starts and on nothing before it.
    """

    name: str
    run: bytes
    pattern: bytes
    longest: int | None = None


KINDS = {
    k.name: k
    for k in (
        Kind("ascii", rb"[\x20-\x7e]+", rb"[\x20-\x7e]{10,1000}", 1000),
        Kind("wide", rb"[\x20-\x7e\x00]+", rb"(?:[\x20-\x7e]\x00){5,}"),
        Kind("printable", rb"[\x20-\x7e\t\n\r\x0b\x0c]+", rb"[\x20-\x7e\t\n\r\x0b\x0c]{7,}"),
        Kind("base64", rb"[A-Za-z0-9+/=]+", rb"(?:[A-Za-z0-9+/]{4}){13,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?"),
    )
}
FOUND = "path string, kind string, offset bigint, value binary"
PIECES = FOUND + ", run_end bigint, tail binary"


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


#: Bytes of rows, about, that a step hands on at a time.
OUT_BYTES = 4 << 20


def _per_row(schema: str, of_row: Callable[[dict], list[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow step that turns each row into rows, one row's at a time; they are handed on in batches of about OUT_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                more = of_row(batch.slice(k, 1).to_pylist()[0])
                rows += more
                size += sum(64 + sum(len(v) for v in r if isinstance(v, bytes)) for r in more)
                if size >= OUT_BYTES:
                    yield _rows(schema, rows)
                    rows, size = [], 0
        if rows:
            yield _rows(schema, rows)

    return run


def _borders(kind: Kind, r: dict, own: bytes) -> tuple[int, int]:
    """How much of a range belongs to a run that touches its start, and from where on to one that touches its end."""
    head = re.match(kind.run, own) if r["start"] > 0 else None
    last = re.match(kind.run, own[::-1]) if r["start"] + r["size"] < r["length"] else None  # a run is a set of characters either way
    return (head.end() if head else 0), len(own) - (last.end() if last else 0)


def _inside_of(kinds: list[Kind]) -> Callable[[dict], list[tuple]]:
    """Matches of the runs inside a range. As none leaves its run, they are those of the stretch between the border runs."""

    def of_row(r: dict) -> list[tuple]:
        own, out = r["content"][r["before"] : r["before"] + r["size"]], []
        for kind in kinds:
            low, high = _borders(kind, r, own)
            out += [(r["path"], kind.name, r["start"] + m.start(), m[0]) for m in re.compile(kind.pattern).finditer(own, low, max(low, high))]
        return out

    return of_row


def _pieces_of(kinds: list[Kind]) -> Callable[[dict], list[tuple]]:
    """The pieces of runs that touch a range's ends, for stitching."""

    def of_row(r: dict) -> list[tuple]:
        own = r["content"][r["before"] : r["before"] + r["size"]]
        after = r["content"][r["before"] + r["size"] :]
        out = []
        for kind in kinds:
            low, high = _borders(kind, r, own)
            for begin, end in [(0, len(own))] if low > high else [(0, low), (high, len(own))]:
                if begin < end:
                    more = re.match(kind.run, after[: kind.longest]) if kind.longest and end == len(own) else None
                    out.append((r["path"], kind.name, r["start"] + begin, own[begin:end], r["start"] + end, more[0] if more else b""))
        return out

    return of_row


def _stitched(kinds: dict[str, Kind]) -> Callable[[dict], list[tuple]]:
    """Matches of a piece, or of a run put together, by the place where its run started."""

    def of_row(r: dict) -> list[tuple]:
        kind, first = kinds[r["kind"]], 0
        if kind.longest:  # the piece's own matches start at whole lengths from the run's start
            first = -(r["offset"] - r["run_start"]) % kind.longest
        matches = re.compile(kind.pattern).finditer(r["value"] + r["tail"], first)
        return [(r["path"], r["kind"], r["offset"] + m.start(), m[0]) for m in matches if m.start() < len(r["value"])]

    return of_row


def carve_range_strings(ranges: DataFrame, kinds: tuple[str, ...] = ("ascii", "wide", "printable", "base64")) -> DataFrame:
    """G1 to G4 over ranges: (path, kind, offset, value), the matches of each whole file, whatever the ranges.

    A run of characters belongs to the range where it starts. One that touches a range's end is
    stitched: where it started follows from the ends of the pieces before, which are two small
    rows a range. Matches of bounded length are then found piece by piece, so that a file that
    is one long run stays spread; others are put together, as the value is one row in any case
    (and below 2 GiB). The halo must be as long as the longest bounded match.
    """
    own = {k: KINDS[k] for k in kinds}
    whole = ranges.mapInArrow(_per_row(FOUND, _inside_of(list(own.values()))), FOUND)
    pieces = written(ranges.mapInArrow(_per_row(PIECES, _pieces_of(list(own.values()))), PIECES), "range-pieces")
    order = W.partitionBy("path", "kind").orderBy("offset")
    ends = pieces.select("path", "kind", "offset", "run_end")
    starts = ends.withColumn("fresh", F.when(F.coalesce(F.lag("run_end").over(order), F.lit(-1)) != F.col("offset"), F.col("offset")))
    starts = starts.withColumn("run_start", F.last("fresh", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    placed = pieces.join(starts.select("path", "kind", "offset", "run_start"), ["path", "kind", "offset"])
    bounded = F.col("kind").isin([k for k, v in own.items() if v.longest])
    joined = F.array_sort(F.collect_list(F.struct("offset", "value")))
    glued = placed.where(~bounded).groupBy("path", "kind", "run_start").agg(joined.alias("all"))
    glued = glued.select("path", "kind", F.col("run_start").alias("offset"), F.array_join(F.transform("all", lambda x: F.hex(x["value"])), "").alias("digits"), "run_start")
    glued = glued.select("path", "kind", "offset", F.unhex("digits").alias("value"), F.lit(b"").alias("tail"), "run_start")
    stitched = placed.where(bounded).select("path", "kind", "offset", "value", "tail", "run_start").unionByName(glued)
    return whole.unionByName(stitched.mapInArrow(_per_row(FOUND, _stitched(own)), FOUND)).select("path", "kind", "offset", "value")


_OBJECT_START, _OBJECT_END = rb"\d+ \d+ obj", rb"endobj"
MARKS = "path string, start bigint, kind string, offset bigint, stop bigint"


def _marks_of(r: dict) -> list[tuple]:
    """Starts (by the place of their keyword) and ends of objects in a range, and where the range ends."""
    low, high, base = r["before"], r["before"] + r["size"], r["start"] - r["before"]
    out = []
    for m in re.finditer(_OBJECT_START, r["content"]):
        if low <= m.end() - 3 < high:
            out.append((r["path"], r["start"], "start", base + m.start(), base + m.end()))
    for m in re.finditer(_OBJECT_END, r["content"]):
        if low <= m.start() < high:
            out.append((r["path"], r["start"], "end", base + m.start(), base + m.end()))
    return out + [(r["path"], r["start"], "range", r["start"], r["start"])]


def object_places(ranges: DataFrame) -> DataFrame:
    """G11 over ranges: (path, begin, stop) of the objects of each whole file.

    An object goes from the first start since the last end to the next end. Inside a range that
    is a matter of its own marks; across ranges it needs one row a range: the first start after
    the range's last end, or any start if it has none.
    """
    marks = ranges.select("path", "start", "size", "before", "content").mapInArrow(_per_row(MARKS, _marks_of), MARKS)
    order = W.partitionBy("path", "start").orderBy("offset", "kind")
    # A start's group is the number of ends of its range before it; the first group of a range is open to what came before.
    numbered = marks.withColumn("group", F.count_if(F.col("kind") == "end").over(order) - F.when(F.col("kind") == "end", 1).otherwise(0))
    groups = numbered.groupBy("path", "start", "group").agg(
        F.min(F.when(F.col("kind") == "start", F.col("offset"))).alias("first_start"), F.min(F.when(F.col("kind") == "end", F.col("stop"))).alias("stop")
    )
    of_range = groups.groupBy("path", "start").agg(F.bool_or(F.col("stop").isNotNull()).alias("ends"), F.max_by(F.when(F.col("stop").isNull(), F.col("first_start")), "group").alias("left_open"))
    by_file = W.partitionBy("path").orderBy("start")
    # Stretches of ranges without an end between them: the first start that is open in one stays open in all after it.
    stretch = of_range.withColumn("stretch", F.count_if("ends").over(by_file))
    held = W.partitionBy("path", "stretch").orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    carried = stretch.withColumn("open", F.min("left_open").over(held))
    carried = carried.select("path", "start", F.lag("open").over(by_file).alias("open_before"))
    found = groups.where("stop is not null").join(carried, ["path", "start"])
    begin = F.when(F.col("group") == 0, F.coalesce("open_before", "first_start")).otherwise(F.col("first_start"))
    return found.select("path", begin.alias("begin"), "stop").where("begin is not null")


def range_pieces(ranges: DataFrame, places: DataFrame) -> DataFrame:
    """(path, begin, stop, value): the bytes of places (path, begin, stop), put together from the ranges that they cross."""
    size = F.max("size").over(W.partitionBy("path"))
    step = ranges.select("path", "start", "size").withColumn("step", size).select("path", "step").distinct()
    dealt = places.join(step, "path").withColumn("k", F.explode(F.sequence(F.expr("begin div step"), F.expr("(stop - 1) div step"))))
    dealt = dealt.select("path", "begin", "stop", (F.col("k") * F.col("step")).alias("start"))
    joined = dealt.join(ranges.select("path", "start", "size", "before", "content"), ["path", "start"])
    at = F.greatest("begin", "start")
    upto = F.least(F.col("stop"), F.col("start") + F.col("size"))
    piece = F.substring("content", (at - F.col("start") + F.col("before") + 1).cast("int"), (upto - at).cast("int"))
    pieces = joined.select("path", "begin", "stop", "start", piece.alias("piece"))
    glued = pieces.groupBy("path", "begin", "stop").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("all"))
    value = F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x["piece"])), ""))
    return glued.select("path", "begin", "stop", value.alias("value"))


_BOF = rb"\x09\x08[\x00-\xff]{2}\x00[\x05\x06][\x05\x10\x40]\x00[\x00-\xff]{4}"
RECORDS = "path string, offset bigint, value binary, reach bigint"


def _records_of(r: dict) -> list[tuple]:
    """Every place of a range where a BOF record may start, also inside another."""
    low, high, base = r["before"], r["before"] + r["size"], r["start"] - r["before"]
    places = (m.start() for m in re.finditer(rb"(?=" + _BOF + rb")", r["content"]))
    return [(r["path"], base + p, r["content"][p : p + 12], base + p + 12) for p in places if low <= p < high]


def carve_range_bof(ranges: DataFrame) -> DataFrame:
    """G13 over ranges: (path, offset, value) of BOF records; of records that overlap, the first and what follows its end."""
    found = ranges.mapInArrow(_per_row(RECORDS, _records_of), RECORDS)
    # Records that overlap form a cluster, nearly always of one; a cluster is settled from its first on.
    order = W.partitionBy("path").orderBy("offset")
    clustered = found.withColumn("fresh", F.when(F.coalesce(F.lag("reach").over(order), F.lit(-1)) <= F.col("offset"), F.col("offset")))
    clustered = clustered.withColumn("cluster", F.last("fresh", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    listed = clustered.groupBy("path", "cluster").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("all"))

    def settle(acc, x):
        free = F.coalesce(F.element_at(F.transform(acc, lambda y: y["offset"]), -1) + 12, F.lit(-1).cast("bigint"))
        return F.when(x["offset"] >= free, F.concat(acc, F.array(x))).otherwise(acc)

    one = F.size("all") == 1
    kept = F.when(one, F.col("all")).otherwise(F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(settle(acc, x))))
    return listed.select("path", F.explode(kept).alias("x")).select("path", "x.*")
