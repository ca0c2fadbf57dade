"""Carving over byte ranges against carving whole files, for ranges of several sizes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from doclens.functions.lens import lens
from doclens.operators import carve
from doclens.sources import artifacts, ranges


def some_file(seed):
    rng = random.Random(seed)
    words = [
        lambda: bytes(rng.choice(b"abc XYZ09+/=\n") for _ in range(rng.randint(1, 40))),
        lambda: "".join(c + "\0" for c in "wide words here"[: rng.randint(1, 15)]).encode(),
        lambda: bytes(rng.choice([0, 1, 9, 8, 200]) for _ in range(rng.randint(1, 9))),
        lambda: b"A" * rng.choice([9, 51, 52, 55, 70, 1003, 2500]) + b"=" * rng.randint(0, 3),
        lambda: b"%d 0 obj <<x>> " % rng.randint(1, 2000),
        lambda: b" endobj ",
        lambda: b"\x09\x08" + bytes([16, 0, 0, 6, rng.choice([5, 16, 64]), 0]) + bytes(rng.choice([1, 9, 8, 0]) for _ in range(4)),
        lambda: b"\x09\x08\x10\x00\x00\x06\x05\x00\x09\x08\x10\x00\x00\x06\x10\x00\x01\x02\x03\x04",
    ]
    return b"".join(rng.choice(words)() for _ in range(150))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    (top / "deep").mkdir()
    contents = {f"f{k}": some_file(k) for k in range(5)} | {"empty": b"", "one": b"x", "deep/all": b"run of text " * 700, "none": bytes(3000)}
    for name, data in contents.items():
        (top / name).write_bytes(data)
    return str(top), {f"{top}/{name}": data for name, data in contents.items()}


def test_ranges_cover_files(spark, files):
    top, contents = files
    for size in (100, 10**6):
        rows = ranges.scan_ranges(spark, top, size, 50).collect()
        for path, data in contents.items():
            own = sorted((r for r in rows if r.path == path), key=lambda r: r.start)
            assert b"".join(bytes(r.content[r.before : r.before + r.size]) for r in own) == data
            assert all(bytes(r.content) == data[r.start - r.before : r.start + r.size + 50] for r in own)


def test_strings_over_ranges(spark, files):
    top, contents = files
    wanted = {(path, k.name, m.start(), m[0]) for path, data in contents.items() for k in ranges.KINDS.values() for m in re.finditer(k.pattern, data)}
    assert {w[1] for w in wanted} == set(ranges.KINDS)
    for size in (61, 4096):
        found = ranges.carve_range_strings(ranges.scan_ranges(spark, f"file://{top}", size)).collect()
        assert len(found) == len(wanted) and {(r.path, r.kind, r.offset, bytes(r.value)) for r in found} == wanted
    # The same values as the whole-file operators find.
    whole = artifacts.scan_artifacts(spark, f"file://{top}")
    for kind, carved in (("ascii", carve.carve_ascii), ("wide", carve.carve_wide), ("printable", carve.carve_printable)):
        values = sorted(r.value for r in carved(whole).collect())
        assert values == sorted(w[3].decode("latin-1").replace("\0", "") for w in wanted if w[1] == kind)


def test_objects_over_ranges(spark, files):
    top, contents = files
    whole = spark.createDataFrame([(k, bytearray(data)) for k, data in enumerate(contents.values())], "artifact_id long, content binary")
    wanted = sorted(r.body for r in carve.carve_pdf_objects(whole.select("artifact_id", lens("content").alias("t"))).collect())
    assert len(wanted) > 20
    for size in (40, 10**6):
        read = ranges.scan_ranges(spark, top, size)
        places = ranges.object_places(read)
        found = ranges.range_pieces(read, places).select(F.decode("value", "ISO-8859-1").alias("v")).collect()
        assert sorted(r.v for r in found) == wanted


def test_records_over_ranges(spark, files):
    top, contents = files
    wanted = {(path, m.start(), m[0]) for path, data in contents.items() for m in re.finditer(ranges._BOF, data)}
    assert len(wanted) > 20
    for size in (5, 10**6):
        found = ranges.carve_range_bof(ranges.scan_ranges(spark, top, size)).collect()
        assert len(found) == len(wanted) and {(r.path, r.offset, bytes(r.value)) for r in found} == wanted


def test_ranges_are_read_once_beside_their_borders(spark, files):
    """What touches the ranges' ends comes from its own table; no other step carves the ranges again."""
    top, _ = files
    found = ranges.carve_range_strings(ranges.scan_ranges(spark, top, 4096))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("artifact_ranges") == 1 and plan.count("MapInArrow") == 2
