"""Readers on small files in each source's format."""

import datetime as dt

from pyspark.sql import functions as F

from tidewright.sources import loaders as L


def save(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_csv_sources(spark, tmp_path):
    p = save(tmp_path, "a.csv", "Date;Time;C6H6(GT)\n10/03/2004;18.00.00;11,9\n10/03/2004;19.00.00;-200\n;;\n")
    assert [(r.ts.hour, r.value) for r in L.air_quality(spark, p).orderBy("ts").collect()] == [(18, 11.9), (19, None)]
    p = save(tmp_path, "h.txt", "Date;Time;Global_active_power\n" + "".join(f"16/12/2006;{10 + m // 60}:{m % 60:02d}:00;{'?' if m == 60 else m}\n" for m in range(121)))
    assert [r.value for r in L.household_power(spark, p).orderBy("ts").collect()] == [0.0, None, 120.0]
    p = save(tmp_path, "b.csv", "dteday,hr,cnt\n2011-01-01,5,16\n")
    assert L.bike_sharing(spark, p).first().ts == dt.datetime(2011, 1, 1, 5)
    p = save(tmp_path, "c.csv", "year,month,day,hour,PM2.5\n2013,3,1,7,4\n2013,3,1,8,NA\n")
    assert [(r.ts.hour, r.value) for r in L.beijing_air(spark, p).orderBy("ts").collect()] == [(7, 4.0), (8, None)]
    p = save(tmp_path, "u.csv", "time,v\nUTC,m\n2020-01-01T00:00:00Z,1\n")
    assert L.with_units_row(spark, p).count() == 1


def test_windows_and_flags(spark, tmp_path):
    p = save(tmp_path, "n.csv", "timestamp,value\n2014-01-01 00:00:00,1\n2014-01-01 01:00:00,x\n2014-01-01 02:00:00,3\n")
    w = save(tmp_path, "w.json", '{"real/n.csv": [["2014-01-01 01:00:00", "2014-01-01 01:30:00"], ["2014-01-01 00:59:00", "2014-01-01 01:10:00"]]}')
    rows = L.inside_windows(L.timestamped(spark, p), L.label_windows(spark, w)).orderBy("ts").collect()
    assert [(r.label, r.value) for r in rows] == [(0, 1.0), (1, None), (0, 3.0)]
    p = save(tmp_path, "l.json", '{"data": [{"t": "2020-01-01 00:00", "v": "1.5", "s": "0", "f": "0,1,0,0", "q": "p"}, {"t": "2020-01-01 00:06", "v": "", "s": "", "f": "", "q": "v"}]}')
    levels = L.water_levels(spark, p)
    assert [(r.value, r.label) for r in levels.orderBy("ts").collect()] == [(1.5, 1), (None, 0)] and L.flag_counts(levels).first().counts == '{"p":1,"v":1}'
    p = save(tmp_path, "m.csv", "t0,t1,variable,flag,comment\n#2020-01-01,2020-01-02,a,x,y\n2020-01-01T00:00:00,2020-01-01T06:00:00,t_u p_u,CHECKME,sensor Stuck\n")
    r = L.manual_flags(spark, p).first()
    assert r.hours == 6.0 and r.kind == "explicit_repeated_value_or_zero" and r.variables == ["t_u", "p_u"]


def test_text_sources(spark, tmp_path):
    p = save(tmp_path, "batch3.dat", "1 1:15596.16 2:1.8\n2 2:4\n")
    assert [(r.batch, r.label, r.value) for r in L.gas_drift(spark, p).collect()] == [(3, "1", 15596.16)]
    p = save(tmp_path, "d.cdl", "netcdf x {\ndimensions:\n\ttime = 3 ;\n\tflag = 2 ;\nvariables:\n\tdouble t(time) ;\ndata:\n\n t = 1.5, _, 3 ;\n\n q = 0, 5 ;\n}\n")
    assert [(r.variable, r.place, r.value) for r in L.cdl(spark, p).orderBy("variable", "place").collect()] == [("q", 0, 0.0), ("q", 1, 5.0), ("t", 0, 1.5), ("t", 1, None), ("t", 2, 3.0)]
    assert {(r.dimension, r["size"]) for r in L.dimensions(spark, p).collect()} == {("time", 3), ("flag", 2)}
    p = save(tmp_path, "codes.txt", "# tests\nDUP=duplicate = check\nFVF = frequent values\n")
    assert {(r.code, r.description) for r in L.codes(spark, p).collect()} == {("DUP", "duplicate = check"), ("FVF", "frequent values")}
    sizes = spark.createDataFrame([("512K",), ("3.5M",), ("1 G",), ("1048576",)], "s string").select(L.size_mb(F.col("s")).alias("m"))
    assert [r.m for r in sizes.collect()] == [0.5, 3.5, 1024.0, 1.0]
    assert L.inventory(spark, str(tmp_path)).where("bytes > 0").count() == 3


def test_backfill_and_csv(spark, tmp_path):
    months = spark.createDataFrame([(dt.date(2020, m, 1), n) for m, n in ((1, 80), (2, 50), (3, 60), (4, 10))], "month date, n long")
    assert sorted(r.month.month for r in L.backfill(months, "2020-04-01").collect()) == [2, 3]
    L.write_csv(months, str(tmp_path / "out"), ["n", "month"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["n", "month"]


def test_registry_settings_results_and_documents(spark, tmp_path):
    import json

    (tmp_path / "hour.csv").write_text("dteday,hr,cnt\n2011-01-01,0,16\n2011-01-01,1,40\n")
    rows = L.streams(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.series_id, r.value) for r in rows] == [("bike_sharing", 16.0), ("bike_sharing", 40.0)]
    assert L.streams(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "c.json").write_text('{"a": {"n": 1, "name": "x"}, "list": [1, 2]}')
    spark.conf.set("tidewright.a.n", "7")
    try:
        assert L.config(spark, str(tmp_path / "c.json")) == {"a.n": 7, "a.name": "x", "list": [1, 2]}
    finally:
        spark.conf.unset("tidewright.a.n")
    runs = spark.createDataFrame([("m", 0.5, None), ("k", None, 3)], "method string, auprc double, n int")
    L.write_csv(runs, str(tmp_path / "runs"), ["n", "method", "auprc"])
    back = L.read_results(spark, str(tmp_path / "runs"), "method string, auprc double, n int")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, runs.collect()), key=str)
    L.write_document(runs.where("method = 'k'"), str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in (tmp_path / "doc").glob("part-*"))
    assert json.loads(text) == {"method": "k", "auprc": None, "n": 3}


def test_documents_of_windows_are_few(spark, tmp_path, monkeypatch):
    """A document lists many users, so that files don't grow as users do."""
    from tidewright.plans import source_queries

    rows = spark.range(3072).selectExpr("id as event_id", "timestamp '2024-01-05 00:30:00' as ts", "id as user_id", "'view' as event_type", "1.0D as value", "'{}' as props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(source_queries, "folder", lambda spark, name: str(tmp_path / name))
    found = source_queries.inside_windows(spark, str(tmp_path))
    assert found.count() == 3072 and found.where("inside = 1").count() == 1024
    assert len(list((tmp_path / "windows").glob("part-*"))) == 3
