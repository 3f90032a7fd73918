"""Commits to stored tables: retried, interrupted, in conflict, and read at any version."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.sources import snapshots

SCHEMA = "k long, a string, b string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def state(df):
    return sorted((tuple(r) for r in df.select("k", "a", "b").collect()), key=str)


def test_commits_against_a_dictionary(spark, tmp_path):
    rng = np.random.default_rng(3)
    table, want, states = snapshots.Table(spark, str(tmp_path / "t"), "k", 8), {}, {}
    for n in range(6):
        rows = {int(k): (int(k), f"a{n}", f"b{n}") for k in rng.integers(0, 60, 12)}
        batch = frame(spark, list(rows.values()))
        if n % 3 == 2:
            table.replace(f"batch{n}", batch)
            want |= rows
        else:
            table.upsert(f"batch{n}", batch, ["a"])
            want |= {k: (k, v[1], want[k][2] if k in want else v[2]) for k, v in rows.items()}
        states[table.version()] = sorted(want.values(), key=str)
        assert state(table.read()) == states[table.version()]
        assert table.upsert(f"batch{n}", batch.withColumn("a", F.lit("nochmals")), ["a"]) == n + 1  # a retried batch changes nothing
    assert all(state(table.read(v)) == s for v, s in states.items())
    assert table.vacuum(2) > 0 and table.versions() == [5, 6] and state(table.read(5)) == states[5] and state(table.read()) == states[6]


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = snapshots.Table(spark, str(tmp_path / "t"), "k", 16)
    table.upsert("all", frame(spark, [(i, "x", "y") for i in range(200)]), ["a"])
    before = table._manifest(1)["folders"]
    table.upsert("one", frame(spark, [(7, "neu", "y")]), ["a"])
    after = table._manifest(2)["folders"]
    assert sum(before[b] != after[b] for b in before) == 1 and set(before) == set(after)
    assert snapshots.Table(spark, str(tmp_path / "t"), "k", 99).buckets == 16  # as it was made


def test_an_interrupted_commit_leaves_no_trace(spark, tmp_path, monkeypatch):
    table = snapshots.Table(spark, str(tmp_path / "t"), "k", 4)
    table.upsert("first", frame(spark, [(1, "a", "b"), (None, "n", "n")]), ["a"])

    def fails(*_):
        raise OSError("abgebrochen")

    with monkeypatch.context() as m:
        m.setattr(snapshots.Table, "_publish", fails)
        with pytest.raises(OSError):
            table.upsert("second", frame(spark, [(1, "neu", "b"), (2, "c", "d")]), ["a"])
    assert table.version() == 1 and state(table.read()) == [(1, "a", "b"), (None, "n", "n")]
    table.upsert("second", frame(spark, [(1, "neu", "b"), (2, "c", "d")]), ["a"])
    assert state(table.read()) == [(1, "neu", "b"), (2, "c", "d"), (None, "n", "n")]
    assert len(os.listdir(tmp_path / "t" / "data")) == 3 and table.vacuum() >= 1 and state(table.read()) == [(1, "neu", "b"), (2, "c", "d"), (None, "n", "n")]


def test_conflicts_empty_batches_and_wrong_keys(spark, tmp_path, monkeypatch):
    one = snapshots.Table(spark, str(tmp_path / "t"), "k", 4)
    with pytest.raises(ValueError):
        one.read()
    one.upsert("none", frame(spark, []), ["a"])
    assert state(one.read()) == []
    one.upsert("first", frame(spark, [(1, "a", "b")]), ["a"])
    other = snapshots.Table(spark, str(tmp_path / "t"), "k")
    with monkeypatch.context() as m:
        m.setattr(other, "version", lambda: 1)  # has read before the last commit
        with pytest.raises(snapshots.Conflict):
            other.upsert("late", frame(spark, [(1, "x", "b")]), ["a"])
    assert state(one.read()) == [(1, "a", "b")]
    with pytest.raises(ValueError):
        one.commit("wrong", frame(spark, [(1, "a", "b")]), lambda old, new: new.unionByName(frame(spark, [(i, "z", "z") for i in range(20)])))
    assert state(one.read()) == [(1, "a", "b")]
