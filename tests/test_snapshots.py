"""The visit store's snapshots: whole commits, replays, compaction, few folders to list."""

import json
from datetime import date, datetime, timedelta

import pytest

from quire.functions.dates import UnavailableVisitsError
from quire.sinks.files import put_text_file, read_text_file
from quire.sinks.visits import ParquetVisitStore, SnapshotVisitStore, load_period, open_store, save

FIRST = date(2020, 1, 1)


def day(n):
    return FIRST + timedelta(days=n)


def visits(spark, *rows):
    return spark.createDataFrame([("en" if p % 2 else "fr", p, datetime(2020, 1, 1 + d, 5), n) for p, d, n in rows], "languageCode string, page_id long, visit_time timestamp, count int")


def got(df):
    return sorted((r.page_id, r.visit_time.day - 1, r["count"]) for r in df.collect())


def test_rows_and_coverage_come_together(spark, tmp_path):
    store = SnapshotVisitStore(spark, str(tmp_path / "s"))
    assert store.visits().count() == 0 and store.meta().count() == 0 and store.snapshot()["version"] == 0
    rows = [(1, 0, 5), (2, 0, 6), (1, 1, 7)]
    save(store, visits(spark, *rows), day(0), day(1))
    assert store.snapshot()["version"] == 1 and got(load_period(store, day(0), day(1))) == rows[:1] + [(1, 1, 7), (2, 0, 6)]
    assert got(load_period(store, day(1), day(1), "en")) == [(1, 1, 7)]
    with pytest.raises(UnavailableVisitsError):
        load_period(store, day(0), day(2))
    # A write that fails half way leaves nothing that a reader sees.
    broken = visits(spark, (3, 2, 1)).selectExpr("languageCode", "page_id", "visit_time", "CAST(raise_error('stop') AS int) AS count")
    with pytest.raises(Exception, match="stop"):
        save(store, broken, day(2), day(2))
    assert store.snapshot()["version"] == 1 and store.visits().count() == 3 and store.meta().count() == 1


def test_a_reader_during_a_replay_sees_old_or_new_whole(spark, tmp_path):
    store = SnapshotVisitStore(spark, str(tmp_path / "s"))
    store.commit(visits(spark, (1, 0, 5), (2, 1, 6)), [(day(0), day(1))], "a")
    store.commit(visits(spark, (3, 0, 9)), [(day(0), day(0))], "b")
    old = store.visits()
    store.commit(visits(spark, (1, 0, 50), (2, 2, 60)), [(day(0), day(2))], "a")
    assert got(old) == [(1, 0, 5), (2, 1, 6), (3, 0, 9)]  # as it was when it began
    assert got(store.visits()) == [(1, 0, 50), (2, 2, 60), (3, 0, 9)] and store.meta().count() == 2
    assert got(store.visits(version=1)) == [(1, 0, 5), (2, 1, 6)] and store.visits(version=0).count() == 0
    with pytest.raises(ValueError):
        store.visits(version=9)


def test_compaction_keeps_rows_and_replays(spark, tmp_path):
    store = SnapshotVisitStore(spark, str(tmp_path / "s"))
    for k in range(8):
        store.commit(visits(spark, (k, 0, k), (k, 1 + k % 2, 10 + k)), [(day(0), day(2))], f"b{k}")
    before = got(store.visits())
    assert len(store.paths()) == 16 and len(store.paths(day(0), day(0))) == 8
    store.compact(pieces=5)  # day 0 alone lies in so many parts
    assert got(store.visits()) == before and len(store.paths(day(0), day(0))) == 1 and len(store.paths()) == 9
    store.compact(pieces=2)
    assert got(store.visits()) == before and len(store.paths()) <= 3 and store.compact(pieces=2) == store.snapshot()
    # A batch inside compacted parts is replaced like any other.
    store.commit(visits(spark, (3, 0, 300)), [(day(0), day(0))], "b3")
    want = sorted([r for r in before if r[0] != 3] + [(3, 0, 300)])
    assert got(store.visits()) == want
    store.compact(pieces=2)
    assert got(store.visits()) == want and store.vacuum(keep=1) > 3
    assert got(store.visits()) == want and len(list((tmp_path / "s" / "data").glob("commit=*"))) == len({p["commit"] for p in store.snapshot()["parts"]})


def test_a_replay_while_days_are_put_together(spark, tmp_path, monkeypatch):
    store = SnapshotVisitStore(spark, str(tmp_path / "s"))
    for k in range(4):
        store.commit(visits(spark, (k, 0, k), (k, 1, k)), [], f"b{k}")
    other, plain = SnapshotVisitStore(spark, str(tmp_path / "s")), store._commit

    def late(change):
        monkeypatch.setattr(store, "_commit", plain)
        other.commit(visits(spark, (2, 0, 222)), [], "b2")
        other.commit(visits(spark, (9, 0, 9)), [], "new")
        return plain(change)

    monkeypatch.setattr(store, "_commit", late)
    store.compact(pieces=2)
    assert got(store.visits()) == [(0, 0, 0), (0, 1, 0), (1, 0, 1), (1, 1, 1), (2, 0, 222), (3, 0, 3), (3, 1, 3), (9, 0, 9)]


def test_commits_do_not_lose_each_other(spark, tmp_path, monkeypatch):
    one, two = (SnapshotVisitStore(spark, str(tmp_path / "s")) for _ in range(2))
    plain, seen = one.snapshot, []

    def first_look(version=None):
        found = plain(version)
        if not seen:
            seen.append(1)
            two.commit(visits(spark, (2, 0, 2)), [(day(0), day(0))], "two")  # between the look and the write
        return found

    monkeypatch.setattr(one, "snapshot", first_look)
    one.commit(visits(spark, (1, 0, 1)), [(day(0), day(0))], "one")
    assert got(two.visits()) == [(1, 0, 1), (2, 0, 2)] and two.snapshot()["version"] == 2
    # A pointer that lags behind, or is not there, hides nothing.
    put_text_file(spark, str(tmp_path / "s" / "current"), "1", replace=True)
    assert two.snapshot()["version"] == 2
    (tmp_path / "s" / "current").unlink()
    assert two.snapshot()["version"] == 2
    assert not put_text_file(spark, str(tmp_path / "s" / "manifests" / "000000000001.json"), "x", replace=False)
    assert json.loads(read_text_file(spark, str(tmp_path / "s" / "manifests" / "000000000001.json")))["version"] == 1


def test_a_thousand_writes_are_not_a_thousand_listings(spark, tmp_path):
    """As many small writes as a year's, all but the first few entered as what the first ones wrote."""
    store = SnapshotVisitStore(spark, str(tmp_path / "s"))
    for k in range(3):
        store.commit(visits(spark, (k, k, k)), [(day(k), day(k))], f"b{k}")
    parts = store.snapshot()["parts"]
    many = [p | {"batches": [f"x{i}"], "days": {str(FIRST + timedelta(days=100 + i)): 1}} for i, p in enumerate(parts * 340)]
    store._commit(lambda m: m | {"parts": m["parts"] + many})
    assert len(store.snapshot()["parts"]) > 1000
    assert len(store.paths(day(0), day(1))) == 2 and got(store.visits(day(0), day(1))) == [(0, 0, 0), (1, 1, 1)]


def test_the_older_layout_is_still_opened(spark, tmp_path):
    save(ParquetVisitStore(spark, str(tmp_path / "old")), visits(spark, (1, 0, 5)), day(0), day(0))
    assert isinstance(open_store(spark, str(tmp_path / "old")), ParquetVisitStore)
    store = open_store(spark, str(tmp_path / "new"))
    assert isinstance(store, SnapshotVisitStore)
    store.append(visits(spark, (1, 0, 5)))
    store.append_meta(day(0), day(0))
    assert got(load_period(store, day(0), day(0))) == [(1, 0, 5)]
