"""Day statistics: any period from its days, new days without the old ones."""

import shutil
from datetime import date, datetime, timedelta

import numpy as np
import pytest

from quire.operators import days as Y
from quire.operators import peaks as P
from quire.operators import visits as V
from quire.plans import config, peak_graph
from quire.sinks.day_stats import DayStatsStore
from quire.sinks.visits import ParquetVisitStore, save

FIRST = date(2020, 1, 1)


def day(n):
    return FIRST + timedelta(days=n)


def visits(spark, seed=1, languages=("en",)):
    """Twelve days; some pages burst, hours may have several entries, some pages have few days."""
    rng, rows = np.random.default_rng(seed), []
    for language in languages:
        for page in range(30):
            for h in range(24 * 12):
                if page % 5 or h % 24 < 3:
                    if (n := int(rng.poisson(1.5))) or page % 7 == 0:
                        rows.append((language, page, h, n))
            rows += [(language, page, int(h), 40 + page) for h in rng.integers(0, 24 * 12, page % 6)]
    rows = [(x, p, datetime(2020, 1, 1) + timedelta(hours=h, minutes=int(rng.integers(0, 60))), n) for x, p, h, n in rows]
    return spark.createDataFrame(rows, "languageCode string, page_id long, visit_time timestamp, count int")


def got(df):
    return sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize(("start", "end"), [(0, 11), (3, 3), (2, 7), (11, 11)])
def test_any_period_is_the_sum_of_its_days(spark, tmp_path, start, end):
    v, store = visits(spark).cache(), DayStatsStore(spark, str(tmp_path / "days"))
    for a, b in ((0, 4), (5, 5), (6, 11), (4, 6)):  # the last goes over days that are there
        store.append(v, day(a), day(b))
    table = store.read(FIRST, day(11))
    own = V.in_period(v, day(start), day(end))
    assert got(Y.stats(table, day(start), day(end))) == got(V.stats(own, day(start), day(end)))
    assert got(Y.daily_maximum(table, day(start), day(end))) == got(V.daily_maximum(own, day(start), day(end)))
    for rate, count in ((1.0, 0), (3.0, 1), (5.0, 2), (0.0, 20)):
        want = got(P.burst_pages(v, FIRST, day(start), day(end), rate, count))
        assert got(Y.burst_pages(v, table, FIRST, day(start), day(end), rate, count)) == want
    active = spark.range(0, 30, 2).withColumnRenamed("id", "page_id")
    assert got(P.active_series(v, active, day(start), day(end), 60, table)) == got(P.active_series(v, active, day(start), day(end), 60))


def test_a_new_day_reads_one_day_of_visits(spark, tmp_path):
    v = visits(spark).cache()
    stored, store = ParquetVisitStore(spark, str(tmp_path / "visits")), DayStatsStore(spark, str(tmp_path / "days"))
    save(stored, v, FIRST, day(11))
    want = got(V.stats(v, FIRST, day(11)))
    store.append(stored.visits(FIRST, day(10)), FIRST, day(10))
    for folder in (tmp_path / "visits").glob("pg_count/*/visit_date=*"):
        if not folder.name.endswith(str(day(11))):
            shutil.rmtree(folder)  # the history of visits is gone: nothing below can read it
    spark.catalog.clearCache()
    store.append(stored.visits(day(11), day(11)), day(11), day(11))
    assert got(Y.stats(store.read(FIRST, day(11)), FIRST, day(11))) == want


def test_bursts_look_at_few_days(spark, tmp_path):
    v, store = visits(spark), DayStatsStore(spark, str(tmp_path / "days"))
    store.append(v, FIRST, day(11))
    table = store.read(FIRST, day(11))
    high = Y.burst_days(table, FIRST, FIRST, day(11), 5.0, 1).count()
    assert 0 < high < table.count() / 4


def test_languages_and_replays(spark, tmp_path):
    v, store = visits(spark, 2, ("en", "fr")), DayStatsStore(spark, str(tmp_path / "days"))
    store.append(v, FIRST, day(11))
    before = got(store.read(FIRST, day(11)))
    store.append(v, day(3), day(5))
    assert got(store.read(FIRST, day(11))) == before and got(store.read(day(3), day(5))) == [r for r in before if day(3) <= r[6] <= day(5)]
    for x in ("en", "fr"):
        own = v.where(f"languageCode = '{x}'")
        assert got(Y.stats(store.read(FIRST, day(11), x), FIRST, day(11))) == got(V.stats(own, FIRST, day(11)))
    store.append(v.limit(0), FIRST, day(11))  # nothing counted, nothing replaced
    assert got(store.read(FIRST, day(11))) == before


def test_the_job_is_the_same_from_day_statistics(spark, tmp_path):
    v = visits(spark, 3)
    stored, store = ParquetVisitStore(spark, str(tmp_path / "visits")), DayStatsStore(spark, str(tmp_path / "days"))
    save(stored, v, FIRST, day(11))
    store.append(stored.visits(), FIRST, day(11))
    pages = spark.createDataFrame([(i, 0, f"P{i}") for i in range(30)], "id long, namespace int, title string")
    links = spark.createDataFrame([(i, j) for i in range(30) for j in range(i)], "`from` long, dest long")
    cfg = config.parse("peaks { burstRate = 2, burstCount = 1, pearsonCorrelation = true, minEdgeWeight = 0.0, dailyMinThreshold = 10 }")
    plain = peak_graph.find(stored, pages, links, day(6), day(11), "en", cfg)
    quick = peak_graph.find(stored, pages, links, day(6), day(11), "en", cfg, days=store)
    assert [got(x) for x in plain] == [got(x) for x in quick] and plain[1].count() > 5
