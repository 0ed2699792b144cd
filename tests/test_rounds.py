"""A table worked off in rounds: admission, resuming after a stop and after a failure."""

import time

import pytest

from millrace.streaming import rounds


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(95).selectExpr("95 - id AS id", "concat('t', id) AS text")
    folder = str(tmp_path / "numbered")
    return rows.schema, folder, rounds.numbered(rows, ["id"], folder, 20)


def start(spark, tmp_path, table, seen, **options):
    schema, folder, total = table

    def work(rows, first, stop):
        seen.append((first, stop, [r.id for r in rows.orderBy("rank").collect()]))

    return rounds.run_rounds(spark, folder, schema, total, work, str(tmp_path / "state"), ranks_a_part=20, **options)


def test_each_row_once_and_rounds_of_one_start(spark, tmp_path, table):
    seen = []
    for _ in range(3):
        q = start(spark, tmp_path, table, seen, limit=15, max_rounds=3)
        q.processAllAvailable()
        q.stop()
    assert [s[:2] for s in seen] == [(0, 15), (15, 30), (30, 45), (45, 60), (60, 75), (75, 90), (90, 95)]
    assert [i for s in seen for i in s[2]] == list(range(1, 96))


def test_a_failed_round_is_run_again(spark, tmp_path, table):
    schema, folder, total = table
    seen = []

    def work(rows, first, stop):
        seen.append((first, rows.count()))
        if len(seen) == 2:
            raise RuntimeError("lost")

    for _ in range(2):
        q = rounds.run_rounds(spark, folder, schema, total, work, str(tmp_path / "state"), limit=40, ranks_a_part=20)
        try:
            q.processAllAvailable()
        except Exception as e:
            assert "lost" in str(e)
        q.stop()
    assert seen == [(0, 40), (40, 40), (40, 40), (80, 15)]


def test_window_and_cooldown(spark, tmp_path, table, monkeypatch):
    options = {"total": "10", "limit": "4", "cooldown": "100", "window_end": "6", "max_rounds": "0"}
    now = [time.mktime((2024, 1, 1, 5, 0, 0, 0, 0, -1))]
    monkeypatch.setattr(rounds.time, "time", lambda: now[0])
    real = time.localtime
    monkeypatch.setattr(rounds.time, "localtime", lambda: real(now[0]))
    reader = rounds._Rounds(options)
    take = lambda at: (lambda rows, end: (list(rows), end["next"]))(*reader.read({"next": at}))
    assert take(0) == ([(0, 4)], 4)
    assert take(4) == ([], 4)
    now[0] += 100
    assert take(4) == ([(4, 8)], 8)
    now[0] += 3600
    assert take(8) == ([], 8)
    fresh = rounds._Rounds(options | {"window_end": "0"})
    assert list(fresh.read({"next": 8})[0]) == [(8, 10)] and list(fresh.read({"next": 10})[0]) == []


def test_empty_table_and_clashing_names(spark, tmp_path):
    none = spark.range(0).selectExpr("id")
    assert rounds.numbered(none, ["id"], str(tmp_path / "none")) == 0
    with pytest.raises(ValueError):
        rounds.numbered(spark.range(3).selectExpr("id", "id AS rank"), ["id"], str(tmp_path / "x"))
