from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestar.indexes.keys import DuplicateKey
from lodestar.sources.tables import TableError, Tables
from lodestar.types import ValueProblem, column

EMP = ["id INT PRIMARY KEY", "name CHAR(8)", "salary FLOAT"]


def test_values():
    i, f, c = column("a INT"), column("b FLOAT"), column("c CHAR(5)")
    assert i.value(5.0) == 5 and f.value(3) == 3.0 and str(f.value(-0.0)) == "0.0" and c.value("ññña") == "ññ"
    for bad in (5.5, "5", True, 2**31, None, float("nan")):
        with pytest.raises(ValueProblem):
            i.value(bad)
    p, v = column("p POINT"), column("v VECTOR(2)")
    assert p.value("(1.5, -2)") == p.value((1.5, -2)) == {"lon": 1.5, "lat": -2.0} and v.value("[1, 2e0]") == [1.0, 2.0]
    for bad in ("1", (1, 2, 3), (1, float("inf")), 7):
        with pytest.raises(ValueProblem):
            p.value(bad)
    with pytest.raises(ValueProblem):
        v.value((1e39, 0))
    for bad in ("x CHAR(0)", "x CHAR(4001)", "x VECTOR(1001)", "x POINT PRIMARY KEY", "x BLOB", "x"):
        with pytest.raises(ValueError):
            column(bad)


def test_tables_follow_a_dict(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/db")
    t = tables.create("emp", EMP, sequential=True)
    model, r = {}, random.Random(30)
    for step in range(8):
        batch = [(r.randrange(60), f"n{step}", float(r.randrange(100))) for _ in range(8)]
        for k, row in enumerate(batch):
            if row[0] in model or row[0] in {x[0] for x in batch[:k]}:
                with pytest.raises(DuplicateKey):
                    t.insert(batch)
                batch = batch[:k]
                break
        else:
            t.insert(batch)
        model |= {x[0]: x for x in batch}
        if step % 3 == 2:
            low = r.randrange(60)
            gone = [k for k in model if low <= k < low + 15]
            assert t.delete((F.col("id") >= low) & (F.col("id") < low + 15)) == len(gone)
            for k in gone:
                del model[k]
        t = tables.open("emp")
        assert [tuple(x) for x in t.ordered().collect()] == [model[k] for k in sorted(model)]
    t.compact()
    assert t.info()["rows"] == len(model) and len(t.folders) <= 1 and tables.names() == ["emp"]
    assert t.delete() == len(model) and t.rows().count() == 0
    tables.drop("emp")
    with pytest.raises(TableError):
        tables.open("emp")


def test_rows_before_a_bad_one_stay(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/db").create("emp", EMP)
    with pytest.raises(ValueProblem):
        t.insert([(1, "a", 1), (2, "b", "x"), (3, "c", 3)])
    assert [r["id"] for r in t.ordered().collect()] == [1]
    t.insert([(1, "again", 2)])  # a key is only checked where asked
    assert t.rows().count() == 2


def test_csv(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/db")
    path = tmp_path / "a.csv"
    path.write_text("ID, name ,salary\n 7 ,  x  ,1.5\n\n8,verylongname,2\n")
    t = tables.create("emp", EMP)
    t.copy_csv(f"file://{path}")
    assert [tuple(r) for r in t.ordered().collect()] == [(7, "  x  ", 1.5), (8, "verylong", 2.0)]
    for bad in ("1,a\n", "1,a,b\n", "5.0,a,1\n", "1,a,1,2\n"):
        path.write_text(bad)
        with pytest.raises(Exception, match="bad line"):
            t.copy_csv(f"file://{path}")
    assert t.rows().count() == 2
    s = tables.create("other", EMP, sequential=True)
    path.write_text("3,a,1\n1,b,2\n")
    s.copy_csv(f"file://{path}")
    assert [r["id"] for r in s.ordered().collect()] == [1, 3]
    with pytest.raises(DuplicateKey):
        s.copy_csv(f"file://{path}")
    with pytest.raises(TableError):
        tables.create("other", EMP)
    with pytest.raises(TableError):
        tables.create("third", ["a INT"], sequential=True)


def test_streamed_windows(spark, tmp_path):
    from lodestar.streaming import events as ev

    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, "view" if i % 2 else "buy", float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(f"file://{tmp_path}/events")
    stream = ev.read_events(spark, f"file://{tmp_path}/events", 1)
    out = ev.windowed(ev.first_of_each(stream, "2 hours"), "10 minutes", delay=None).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/check").start()
    out.processAllAvailable()
    out.stop()
    got = sorted(map(tuple, spark.table("windows").collect()))
    assert got == sorted(map(tuple, ev.windowed(df, "10 minutes").collect())) and sum(r[3] for r in got) == 120
    assert ev.windowed(df, "10 minutes", "5 minutes").count() > len(got)
    assert ev.sessions(df, "5 minutes").agg(F.sum("n")).first()[0] == 120
