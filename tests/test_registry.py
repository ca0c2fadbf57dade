"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import math
import uuid

import duckdb
import pytest

from doclens.operators import signatures
from doclens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "conversations", "labels", "benchmark", "events"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def plain(v):
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else str(v)

    return sorted([[plain(r[k]) for k in order] for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert found == rows_of(names, cursor.fetchall())
    assert found


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert registry.FLAGSHIP in entry.queries()


def test_streams_hold_whole_texts(spark):
    found = registry.pdf.expand_pdf_streams(registry._deflated_objects(spark, SF)).select("artifact_id", "content").collect()
    texts = {r.artifact_id: r.t for r in registry.docs(spark, SF).collect()}
    assert max(map(len, texts.values())) > 2000
    whole = {k: (["{\\rtf1 ", "var x; ", ""][k % 3] + t).encode() for k, t in texts.items()}
    assert {r.artifact_id: bytes(r.content) for r in found} == whole


def test_signatures_of_many_class_ids(spark):
    planted = {
        "00021401-0000-0000-C000-000000000046": "shortcut",
        "06290BD3-48AA-11D2-8432-006008C3FBFC": "moniker",
        "3050F4D8-98B5-11CF-BB82-00AA00BDCE0B": "HTML application",
        "C08AFD90-F2A1-11D1-8455-00A0C91F3880": "browser window",
        "44F9A03B-A3EC-4F3B-9364-08E0007F21DF": "task symbol",
        "6E182020-F460-11CE-9BCD-00AA00608E01": "frame",
        "02CE0200-0000-0000-C000-000000000046": "equation: editor",
    }
    orders = [(uid, getattr(uuid.UUID(uid), order)) for uid in planted for order in ("bytes", "bytes_le")]
    parts = spark.createDataFrame([(k, "x" * 60 + b.decode("latin-1") + "y") for k, (_, b) in enumerate(orders)], "artifact_id long, t string")
    found = registry.findings.match_signatures(parts, signatures.table(spark)).collect()
    assert sorted(found) == sorted(signatures.labels(parts).collect())
    assert sorted(r.artifact_id for r in found) == list(range(len(orders)))
    assert all(planted[orders[r.artifact_id][0]] in r.label for r in found)
    assert len({sig for sig, _ in signatures.signature_rows()}) == len(signatures.signature_rows()) == 90
