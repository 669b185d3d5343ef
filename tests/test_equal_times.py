"""Polls and frames of equal times, against the SQL where it has one answer on so small a table."""

from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import same

from spanwright import queries as Q
from spanwright.operators import states

#: An event's second is an hour of its time.
BEGIN = datetime(2024, 1, 1)


@pytest.fixture
def tables(tmp_path):
    """Writes events (event_id, second, user_id, event_type) and gives their folder; the other tables are not read."""

    def write(rows):
        ids, seconds, users, kinds = zip(*rows, strict=True)
        columns = {"event_id": pa.array(ids, pa.int64()), "ts": pa.array([BEGIN + timedelta(hours=s) for s in seconds], pa.timestamp("us")), "user_id": pa.array(users, pa.int64())}
        columns |= {"event_type": pa.array(kinds), "value": pa.array([1.0] * len(ids)), "props": pa.array(["{}"] * len(ids))}
        pq.write_table(pa.table(columns), tmp_path / "events.parquet")
        return str(tmp_path)

    return write


def sql(folder, name):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return c.sql(Q.SQL[name]).df()


#: Two known states at the first and at the last time of each clip, in both orders.
ENDS = [(0, 10, 1, "purchase"), (1, 10, 1, "click"), (2, 100, 1, "signup"), (4, 100, 1, "view"), (5, 10, 2, "click"), (7, 10, 2, "signup"), (8, 100, 2, "click"), (10, 100, 2, "signup"), (11, 100, 2, "error")]


def test_boundaries_of_equal_times(spark, tables):
    folder = tables(ENDS)
    same(Q.QUERIES["state_boundaries"](spark, folder).toPandas(), sql(folder, "state_boundaries"))


def test_equal_stays_are_as_many_events(spark):
    """Polls of one time that go to and fro make stays with the same ends."""
    states_told = ["closed", "open", "closed", "open", "closed", "open", "closed"]
    polls = spark.createDataFrame([(1, k, 10.0, s, s) for k, s in enumerate(states_told)] + [(1, 9, 12.0, "open", "on")], "video long, event_id long, t double, state string, text string")
    media = spark.createDataFrame([(1, 20.0)], "video long, duration_s double")
    got = states.state_events(polls, media, ["video"], "open").orderBy("start_s").collect()
    assert [(r.start_s, r.end_s) for r in got] == [(10.0, 10.0)] * 3 + [(11.0, 20.0)]
    assert states.state_spans(polls, media, ["video"], "open").count() == 4


def test_stream_takes_polls_from_time_0_and_before(spark, tables):
    folder = tables([(0, -3, 1, "click"), (1, 0, 1, "purchase"), (2, 0, 2, "view"), (3, 2, 1, "view"), (4, 7, 2, "signup"), (5, 90, 3, "view")])
    want = sql(folder, "streamed_transitions")
    assert len(want) == 3
    same(Q.QUERIES["streamed_transitions"](spark, folder).toPandas(), want)


#: Equal last times; the labels are far from wherever the changes there may lie.
TALLIED = [(0, 10, 1, "purchase"), (1, 100, 1, "signup"), (2, 100, 1, "click"), (3, 10, 2, "click"), (4, 100, 2, "purchase"), (5, 100, 2, "view")]


def test_tally_of_equal_last_times(spark, tables):
    folder = tables(TALLIED)
    same(Q.QUERIES["transition_tally"](spark, folder).toPandas(), sql(folder, "transition_tally"))
