import bz2
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quire.functions import dates as T
from quire.functions.hours import hour_code, hour_visits, visits_of_day
from quire.operators import views as W
from quire.sinks import visits as K
from quire.sources.views import parse_views, read_views, view_date


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_hour_codes(spark):
    assert [tuple(x) for x in one(spark, hour_visits(F.col("c")), c="C1P3")] == [(2, 1), (15, 3)]
    whole = "".join(f"{chr(65 + h)}{h + 1}" for h in range(24))
    assert [tuple(x) for x in one(spark, hour_visits(F.col("c")), c=whole)] == [(h, h + 1) for h in range(24)]
    assert one(spark, hour_visits(F.col("c")), c="Y1Z2") == [] and one(spark, hour_visits(F.col("c")), c="") == []
    assert one(spark, hour_code(hour_visits(F.col("c"))), c="P3C1") == "C1P3"


def test_current_format(spark):
    df = parse_views(lines(spark, "en.wikipedia A_b null desktop 30 A10B20", "en.wikipedia Category:X 12 mobile-web 5 C5", "en.wikipedia Alien:_c 1 desktop 2 A2", "# en.wikipedia A null desktop 1 A1", "en.m.wikipedia A null desktop 1 A1", "ceb.wikipedia A null desktop 1 A1", "en.wiktionary A null desktop 1 A1", "junk"))
    rows = sorted((r.languageCode, r.title, r.namespace, r.source, r.dailyVisits) for r in df.collect())
    assert rows == [("en", "A", 0, "desktop", 1), ("en", "A_b", 0, "desktop", 30), ("en", "Alien:_c", -1, "desktop", 2), ("en", "Category:X", 14, "mobile-web", 5)]
    kept = parse_views(lines(spark, "en.wiktionary A null desktop 1 A1", "fr.wikipedia B null desktop 1 A1"), project="wikipedia", languages=["fr"])
    assert [r.title for r in kept.collect()] == ["B"]
    assert [r.title for r in parse_views(lines(spark, "en.wikipedia Category:X 12 d 5 C5"), strip_namespace=True).collect()] == ["X"]


def test_legacy_format(spark):
    df = parse_views(lines(spark, "en.z A 30 A10B20", "en.z Category:X 5 C5", "en.z Book:Y 5 C5", "en.z File:Z 5 C5", "en.b Q 1 A1", "en.zz R 1 A1", "en.z %41 1 A1", "en.z %41b 1 A1"), legacy=True)
    assert sorted((r.title, r.namespace, r.source) for r in df.collect()) == [("%41b", 0, "web"), ("A", 0, "web"), ("A", 0, "web"), ("Q", 0, "web"), ("X", 14, "web")]
    assert [r.title for r in parse_views(lines(spark, "en.z %41b 1 A1"), legacy=True, decode_titles=True).collect()] == ["Ab"]


def test_merge_adds_access_methods(spark):
    views = parse_views(lines(spark, "en.wikipedia A null desktop 60 A50B10", "en.wikipedia A null mobile-web 60 B20C40", "en.wikipedia B null desktop 100 A100"))
    assert [tuple(r) for r in W.merge_views(views, 100).select("title", "source", "dailyVisits", "hourlyVisits").collect()] == [("A", "web", 120, "A50B30C40")]


def test_daily_or_hourly(spark):
    day = F.to_date(F.lit("2020-12-01"))
    views = parse_views(lines(spark, "en.wikipedia A null desktop 174 A100B74", "en.wikipedia B null desktop 390 A1X389", "en.wikipedia C null desktop 21 A21"))
    rows = {r.title: r.visits for r in W.page_visits(views, 100, 200, day).collect()}
    assert set(rows) == {"A", "B"}
    assert [(v.time, v["count"], v.timeResolution) for v in rows["A"]] == [(datetime(2020, 12, 1), 174, "Day")]
    assert [(v.time.hour, v["count"], v.timeResolution) for v in rows["B"]] == [(0, 1, "Hour"), (23, 389, "Hour")]
    assert one(spark, F.size(visits_of_day(F.lit(5), F.col("c"), day, 5)), c="A2B3") == 2


def test_rows_of_known_pages(spark):
    views = parse_views(lines(spark, "en.wikipedia A null desktop 5 A2B3", "en.wikipedia R null desktop 5 A5", "en.wikipedia missing null desktop 5 A5"))
    pages = spark.createDataFrame([(1, "A", 0, False, "en"), (2, "R", 0, True, "en"), (3, "A", 0, False, "fr")], "id int, title string, namespace int, isRedirect boolean, languageCode string")
    visits = W.page_visits(views, 0, 0, F.to_date(F.lit("2020-12-01")))
    rows = W.visit_rows(pages, visits)
    assert rows.columns == ["languageCode", "page_id", "visit_time", "count"]
    assert sorted((r.page_id, r.visit_time.hour, r["count"]) for r in rows.collect()) == [(1, 0, 2), (1, 1, 3)]
    assert W.visit_rows(pages, visits, keep_redirects=True).count() == 3


def test_dates(spark):
    assert len(T.date_range(date(2018, 8, 1), date(2018, 8, 10))) == 10
    assert len(T.date_range(date(2017, 8, 1), date(2017, 9, 1))) == 32
    with pytest.raises(ValueError):
        T.date_range(date(2018, 8, 2), date(2018, 8, 1))
    now, day = F.lit(datetime(2018, 8, 5)), F.lit(date(2018, 8, 4))
    assert one(spark, T.earliest(now, day), c="") == datetime(2018, 8, 4)
    assert one(spark, T.latest(now, day), c="") == datetime(2018, 8, 5)
    assert one(spark, T.latest(now, F.lit(date(2018, 8, 9))), c="") == datetime(2018, 8, 10)
    assert T.period_hours(date(2018, 8, 1), date(2018, 8, 2)) == 48
    assert T.history_start(date(2018, 8, 1), date(2018, 8, 31)) == date(2018, 7, 2)
    assert T.history_start(date(2018, 8, 1), date(2018, 10, 1)) == date(2018, 8, 1)
    assert T.history_start(date(2018, 8, 1), date(2018, 8, 31), whole=True) == date(2018, 7, 1)
    assert T.history_start(date(2018, 8, 20), date(2018, 9, 10)) == date(2018, 7, 30)
    assert T.views_file("/d", date(2018, 8, 1), True) == "/d/pagecounts-2018-08-01.bz2"
    assert T.views_file("/d", date(2018, 8, 1), False) == "/d/pageviews-20180801-user.bz2"
    for name in ("pagecounts-2018-08-01.bz2", "x/pageviews-20180801-user.bz2"):
        assert one(spark, view_date(F.col("c")), c=name) == date(2018, 8, 1)


def test_coverage_joins_adjacent_periods(spark):
    meta = spark.createDataFrame([(datetime(2018, 9, 1), datetime(2018, 9, 30)), (datetime(2018, 10, 1), datetime(2018, 10, 31))], "start_time timestamp, end_time timestamp")
    ask = lambda m, a, b: T.covered(m, a, b).first()[0]
    assert ask(meta, date(2018, 9, 1), date(2018, 10, 31)) and ask(meta, date(2018, 9, 20), date(2018, 10, 5))
    assert not ask(meta, date(2018, 8, 31), date(2018, 9, 5)) and not ask(meta, date(2018, 10, 20), date(2018, 11, 1))
    assert not ask(meta.limit(0), date(2018, 9, 1), date(2018, 9, 1))
    with pytest.raises(T.UnavailableVisitsError):
        T.check_available(meta, date(2018, 8, 1), date(2018, 8, 2))


def test_store_and_job(spark, tmp_path):
    from quire.plans import config, page_views

    for day, n in (("20200101", 300), ("20200102", 90)):
        with bz2.open(tmp_path / f"pageviews-{day}-user.bz2", "wt") as f:
            f.write(f"en.wikipedia A null desktop {n} A{n}\n")
    assert read_views(spark, str(tmp_path), T.date_range(date(2020, 1, 1), date(2020, 1, 2))).count() == 2
    pages = spark.createDataFrame([(1, 0, "A", False, "en")], "id int, namespace int, title string, isRedirect boolean, languageCode string")
    full = pages.select("id", "namespace", "title", F.lit("").alias("restriction"), "isRedirect", F.lit(False).alias("isNew"), F.lit(0.5).alias("random"), F.lit(None).cast("timestamp").alias("touched"), F.lit("").alias("linksUpdated"), F.lit(1).alias("latest"), F.lit(1).alias("len"), F.lit("").alias("contentModel"), "languageCode")
    full.write.parquet(str(tmp_path / "pages"))
    store = K.open_store(spark, str(tmp_path / "store"))
    page_views.run(spark, store, str(tmp_path), str(tmp_path / "pages"), date(2020, 1, 1), date(2020, 1, 2), ["en"], False, config.load(None))
    rows = K.load_period(store, date(2020, 1, 1), date(2020, 1, 2), "en").collect()
    assert [(r.page_id, r["count"]) for r in rows] == [(1, 300)]
    assert K.load_series(store, date(2020, 1, 1), date(2020, 1, 2), "en").count() == 1
    with pytest.raises(T.UnavailableVisitsError):
        K.load_period(store, date(2020, 1, 1), date(2020, 1, 3))
    assert isinstance(K.open_store(spark, None), K.CassandraVisitStore)
    with pytest.raises(RuntimeError, match="connector"):
        K.open_store(spark, None).visits()


def test_stream(spark, tmp_path):
    from quire.streaming.views import append_visits, stream_views

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "pageviews-20200101-user.txt").write_text("en.wikipedia A null desktop 300 A100B200\n")
    pages = spark.createDataFrame([(1, "A", 0, False, "en")], "id int, title string, namespace int, isRedirect boolean, languageCode string")
    store = K.ParquetVisitStore(spark, str(tmp_path / "store"))
    append_visits(stream_views(spark, str(tmp_path / "in")), pages, store, str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r["count"] for r in K.load_period(store, date(2020, 1, 1), date(2020, 1, 1)).collect()) == [100, 200]


def test_replayed_batches_replace_themselves(spark, tmp_path):
    import shutil

    from quire.streaming.views import append_visits, stream_views

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "pageviews-20200101-user.txt").write_text("en.wikipedia A null desktop 300 A100B200\n")
    pages = spark.createDataFrame([(1, "A", 0, False, "en")], "id int, title string, namespace int, isRedirect boolean, languageCode string")
    store = K.ParquetVisitStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        # Without the record of what was done, the first batch runs again.
        append_visits(stream_views(spark, str(tmp_path / "in")), pages, store, str(tmp_path / "ck")).awaitTermination(60)
        shutil.rmtree(tmp_path / "ck")
    assert sorted(r["count"] for r in store.visits().collect()) == [100, 200] and store.meta().count() == 1
    store.append(store.visits().where("count = 100"))
    assert store.visits().count() == 3


def test_periods_read_their_days_alone(spark, tmp_path):
    store = K.ParquetVisitStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("en", 1, datetime(2020, 1, d, 5), d) for d in range(1, 20)], "languageCode string, page_id long, visit_time timestamp, count int")
    K.save(store, rows, date(2020, 1, 1), date(2020, 1, 19))
    found = K.load_period(store, date(2020, 1, 3), date(2020, 1, 4), "en")
    assert found.columns == rows.columns and sorted(r["count"] for r in found.collect()) == [3, 4]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(visit_date" in plan or "visit_date" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_scratch(spark, tmp_path):
    from quire import scratch

    table = scratch.written(spark.range(3), "t")
    assert table.count() == 3 and scratch.scratch_dir(spark).startswith(scratch.shared_dir(spark))
    scratch.clean(spark)
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        scratch.written(spark.range(3), "t").unionByName(table).count()


def test_a_cluster_needs_a_shared_folder():
    from quire import scratch

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_dir(Session)
    Session.conf["spark.checkpoint.dir"] = "hdfs:///x/"
    assert scratch.shared_dir(Session) == "hdfs:///x"
