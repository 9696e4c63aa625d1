"""A load that stops after any step leaves the old or the new state, never half."""

from datetime import datetime

import pytest

from rosterloom.operators import history as hs
from rosterloom.session import run_dir
from rosterloom.sources import commit

SCHEMA = "id bigint, owner string, v string"
RUN = "run_name string, inserted bigint, updated bigint, skipped bigint, status string"
AT = datetime(2024, 5, 31, 12)


class Stop(Exception):
    pass


def table(spark, path, rows):
    return rows(commit.read_owners(spark, path, SCHEMA), "id", "owner", "v"), rows(commit.runs(spark, path), "run_name")


@pytest.fixture()
def loaded(spark):
    path = run_dir(spark, "commit-test")
    first = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "y"), (4, None, "n")], SCHEMA)
    commit.replace_owners(first, path, "owner", spark.createDataFrame([("first", 4, 0, 0, "APPLIED")], RUN))
    new = spark.createDataFrame([(5, "b", "new"), (6, "c", "new")], SCHEMA)
    return path, new, spark.createDataFrame([("second", 2, 0, 0, "APPLIED")], RUN)


OLD = ([(1, "a", "x"), (2, "b", "x"), (3, "b", "y"), (4, None, "n")], [("first",)])
NEW = ([(1, "a", "x"), (4, None, "n"), (5, "b", "new"), (6, "c", "new")], [("first",), ("second",)])


@pytest.mark.parametrize("step", ["stage", "_listed", "publish", "after"])
def test_a_stopped_load_is_old_or_new(spark, rows, loaded, monkeypatch, step):
    path, new, run = loaded
    assert table(spark, path, rows) == OLD

    def stopping(whole):
        def call(*a, **k):
            out = whole(*a, **k) if step in ("stage", "after") else None
            raise Stop(out)

        return call

    with monkeypatch.context() as m:
        name = "publish" if step == "after" else step
        if name == "_listed":  # after the rows are written, before their folders are read
            m.setattr(commit, "latest", lambda *a: 1)
        m.setattr(commit, name, stopping(getattr(commit, name)))
        with pytest.raises(Stop):
            commit.replace_owners(new, path, "owner", run)
    assert table(spark, path, rows) == (NEW if step == "after" else OLD)
    if step != "after":  # the stopped load blocks nothing
        commit.replace_owners(new, path, "owner", run)
        assert table(spark, path, rows) == NEW


def test_a_draft_that_was_never_renamed_is_not_read(spark, rows, loaded, monkeypatch):
    path, new, run = loaded
    whole = commit._hadoop

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == "getUri":
                raise Stop
            return getattr(self.fs, name)

    monkeypatch.setattr(commit, "_hadoop", lambda *a: (whole(*a)[0], Broken(whole(*a)[1])))
    with pytest.raises(Stop):
        commit.replace_owners(new, path, "owner", run)
    monkeypatch.undo()
    assert table(spark, path, rows) == OLD


def test_two_writers_of_one_state(spark, rows, loaded):
    path, new, run = loaded
    at = commit.latest(spark, path)
    commit.publish(spark, path, {"parts": {}, "run": None}, at)
    with pytest.raises(commit.Conflict):
        commit.publish(spark, path, {"parts": {"owner=z": "data/none"}}, at)
    assert table(spark, path, rows) == ([], [("first",)]) and commit.latest(spark, path) == at + 1


@pytest.mark.parametrize("step", ["stage", "publish", "after"])
def test_a_stopped_version_is_none_or_whole(spark, rows, monkeypatch, step):
    path = run_dir(spark, "versions-test")
    data = spark.createDataFrame([("s", "o1"), ("s", "o2"), ("t", "o1")], "section string, org_name string")
    assert hs.publish_version(data, path, 2024, 5, AT) == "2024.05"
    whole = {n: getattr(commit, n) for n in ("stage", "publish")}

    def stop(name):
        def call(*a, **k):
            if step != "publish":
                whole[name](*a, **k)
            raise Stop

        return call

    with monkeypatch.context() as m:
        name = "publish" if step == "after" else step
        m.setattr(commit, name, stop(name))
        with pytest.raises(Stop):
            hs.publish_version(data, path, 2024, 6, AT, actor=3)
    made = [("2024.05", 3, "GENERATED")] + ([("2024.06", 3, "GENERATED")] if step == "after" else [])
    assert rows(hs.version_records(spark, path), "version", "n_rows", "status") == made
    assert rows(hs.version_audit(spark, path), "record") == [(v,) for v, *_ in made]
    if step != "after":
        assert hs.publish_version(data, path, 2024, 6, AT, actor=3) == "2024.06"
    assert rows(hs.version_rows(spark, path, "2024.06"), "section", "org_name") == rows(data)
    with pytest.raises(ValueError):
        hs.publish_version(data, path, 2024, 6, AT)


def test_deleted_versions_keep_their_record(spark, rows):
    path = run_dir(spark, "versions-test")
    data = spark.createDataFrame([("s", "o1")], "section string, org_name string")
    hs.publish_version(data, path, 2024, 5, AT, remarks="first")
    hs.delete_version(spark, path, "2024.05", AT, actor=4)
    assert hs.publish_version(data, path, 2024, 5, AT) == "2024.05.2"
    assert rows(hs.version_records(spark, path), "version", "status") == [("2024.05", "DELETED"), ("2024.05.2", "GENERATED")]
    with pytest.raises(ValueError):
        hs.version_rows(spark, path, "2024.05")
    with pytest.raises(ValueError):
        hs.delete_version(spark, path, "2024.05", AT)
