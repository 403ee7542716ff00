"""A stream of pieces of days against the batch job."""

import os
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from quire.operators.views import page_visits, visit_rows
from quire.sinks.visits import SnapshotVisitStore
from quire.sources.views import parse_views
from quire.streaming.views import append_page_days

DAYS = [date(2020, 1, d) for d in range(1, 6)]


def day_lines(rng, legacy=False):
    """Lines of some pages by access method, some below the least number of visits, some of two projects with equal counts."""
    out = {}
    for d in DAYS:
        lines = ["# a comment"]
        for page in range(12):
            for source in ("desktop", "mobile-web") if not legacy else ("",):
                hours = sorted(rng.sample(range(24), 3))
                code = "".join(f"{chr(65 + h)}{20 + page}" for h in hours)
                total = 3 * (20 + page)
                lines.append(f"en.z P{page} {total} {code}" if legacy else f"en.wikipedia P{page} null {source} {total} {code}")
            if not legacy and page % 4 == 0:
                lines.append(f"en.wikibooks P{page} null desktop {total} {code}")
        out[d] = lines
    return out


def batch_result(spark, lines, pages, legacy):
    rows = spark.createDataFrame([(x, d) for d, some in lines.items() for x in some], "value string, day date")
    return got(visit_rows(pages, page_visits(parse_views(rows, legacy), 70, 0, F.col("day"), merged=not legacy)))


def got(df):
    return sorted((r.languageCode, r.page_id, r.visit_time, r["count"]) for r in df.collect())


def pages_of(spark):
    return spark.createDataFrame([(i, f"P{i}", 0, i == 3, "en") for i in range(11)], "id int, title string, namespace int, isRedirect boolean, languageCode string")


def put(folder, order, name, lines):
    path = folder / name
    path.write_text("\n".join(lines) + "\n")
    os.utime(path, (1_600_000_000 + 10 * order,) * 2)  # the stream takes files by age


@pytest.mark.parametrize("legacy", [False, True])
def test_split_out_of_order_and_repeated(spark, tmp_path, legacy):
    rng = random.Random(5)
    lines, folder, pages = day_lines(rng, legacy), tmp_path / "in", pages_of(spark)
    folder.mkdir()
    pieces = []
    for n, d in enumerate(DAYS):
        some = [*lines[d], *rng.sample(lines[d], 4)]
        rng.shuffle(some)
        cut = sorted(rng.sample(range(1, len(some)), 3))
        # A piece comes up to two days late; one comes twice.
        for k, (a, b) in enumerate(zip([0, *cut], [*cut, len(some)], strict=True)):
            pieces += [(n + rng.random() * 2, d, f"{k}", some[a:b])] * (1 + (k == 1))
    kind = "pagecounts" if legacy else "pageviews"
    for order, (_, d, k, some) in enumerate(sorted(pieces, key=lambda p: p[0])):
        put(folder, order, f"{kind}-{d:%Y%m%d}-{order:03d}-{k}.txt", some)
    store = SnapshotVisitStore(spark, str(tmp_path / "store"))
    run = lambda: append_page_days(spark, str(folder), pages, store, str(tmp_path / "ck"), lateness_days=3, min_daily=70, legacy=legacy, files_per_batch=2)
    first = run()
    assert first.awaitTermination(300)
    part = got(store.visits())
    want = batch_result(spark, lines, pages, legacy)
    assert part == [r for r in want if r[2].date() <= date(2020, 1, 2)]  # the other days are not closed
    # The state outlives the query; a comment of a later day closes what is left.
    put(folder, 1000, f"{kind}-20200120-end.txt", ["# end"])
    second = run()
    assert second.awaitTermination(300)
    assert got(store.visits()) == want and len(want) > 100
    assert sorted(r.start_time.date() for r in store.meta().collect()) == DAYS


def test_lines_of_a_closed_day_are_counted_as_late(spark, tmp_path):
    folder, pages = tmp_path / "in", pages_of(spark)
    folder.mkdir()
    line = "en.wikipedia P1 null desktop 300 A300"
    for order, (d, text) in enumerate([("20200101", line), ("20200110", "# end"), ("20200111", "# more"), ("20200101", line.replace("A", "B")), ("20200120", "# end")]):
        put(folder, order, f"pageviews-{d}-{order}.txt", [text])
    store = SnapshotVisitStore(spark, str(tmp_path / "store"))
    query = append_page_days(spark, str(folder), pages, store, str(tmp_path / "ck"), files_per_batch=1)
    assert query.awaitTermination(300)
    assert [r["count"] for r in store.visits().collect()] == [300] and store.visits().first().visit_time.hour == 0
    assert sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]) == 1
