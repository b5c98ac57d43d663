import json
import threading

import pytest

from pairloom.sources import versions as V
from pairloom.streaming import logs, notebook


def numbers(spark, n, tag="a"):
    return spark.range(n).selectExpr("id as k", f"'{tag}' as tag")


def test_versions(spark, tmp_path):
    root = f"{tmp_path}/t"
    with pytest.raises(Exception, match="no version 0"):
        V.read(spark, root)
    assert V.commit(numbers(spark, 3), root) == 1
    first = V.read(spark, root)
    assert V.commit(numbers(spark, 5, "b"), root, expected=1) == 2
    assert V.read(spark, root).count() == 5 and V.read(spark, root, 1).count() == 3
    assert first.count() == 3  # a reader that began before the commit
    with pytest.raises(V.Conflict):
        V.commit(numbers(spark, 9), root, expected=1)
    assert V.numbers(spark, root) == [1, 2] and len(list((tmp_path / "t").glob("v-*"))) == 2
    # a version may have other columns, or no rows
    assert V.commit(spark.range(0).selectExpr("id", "1 as more"), root) == 3
    assert V.read(spark, root).columns == ["id", "more"] and V.read(spark, root).count() == 0
    assert V.forget_old(spark, root, last=1) == [1, 2]
    assert V.numbers(spark, root) == [3] and len(list((tmp_path / "t").glob("v-*"))) == 1


def test_reads_during_commits_find_a_whole_table(spark, tmp_path):
    root, stop, seen, errors = f"{tmp_path}/t", threading.Event(), set(), []
    V.commit(numbers(spark, 10), root)

    def reader():
        while not stop.is_set():
            try:
                seen.add(V.read(spark, root).count())
            except Exception as e:  # shown below
                errors.append(e)

    thread = threading.Thread(target=reader)
    thread.start()
    for n in (20, 30, 40, 50):
        V.commit(numbers(spark, n), root)
    stop.set()
    thread.join()
    assert not errors and seen <= {10, 20, 30, 40, 50} and seen


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root = f"{tmp_path}/t"
    threads = [threading.Thread(target=lambda n=n: V.commit(numbers(spark, n), root)) for n in range(1, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(V.read(spark, root, v).count() for v in V.numbers(spark, root)) == [1, 2, 3, 4, 5, 6]
    assert V.numbers(spark, root) == [1, 2, 3, 4, 5, 6]


def entries(spark, rows):
    return spark.createDataFrame([json.dumps(r) for r in rows], "string").selectExpr(f"from_json(value, '{notebook.ENTRY}') as e").select("e.*")


REGISTER = {"id": "e1", "event": "register", "ts": "2024-01-01T00:00:00Z", "agent": "ann", "label": "faers_prr", "title": "t1"}
DONE = {"id": "e1", "event": "complete", "ts": "2024-01-02T00:00:00Z", "metrics": {"validate_average_precision": 0.2}, "findings": "some"}


def test_notebook_refuses_and_repeats(spark, tmp_path):
    path = f"{tmp_path}/n"
    assert notebook.read(spark, path).count() == 0
    bad = [REGISTER | {"label": "mine"}, REGISTER | {"label": None}, DONE | {"metrics": {}}, DONE | {"metrics": None}, DONE | {"findings": " "}, {"event": "note"}, {"id": "x", "event": "?"}, {"id": "x"}]
    got = [r.reason for r in notebook.refused(entries(spark, bad)).collect()]
    assert got == ["unknown label"] * 2 + ["no metrics"] * 2 + ["no findings", "no id", "unknown event", "unknown event"]
    with pytest.raises(ValueError, match="e1: unknown label"):
        notebook.commit(entries(spark, [DONE, bad[0]]), path, "k0")
    assert notebook.read(spark, path).count() == 0  # not even the good one
    assert notebook.commit(entries(spark, [REGISTER, DONE]), path, "k1")
    assert not notebook.commit(entries(spark, [REGISTER, DONE]), path, "k1")
    assert notebook.read(spark, path).count() == 2
    assert notebook.commit(spark.createDataFrame([("n1", "note", "caveat")], "id string, event string, kind string"), path, "k2")
    notes = notebook.notes(notebook.read(spark, path), "caveat").collect()
    assert [n.id for n in notes] == ["n1"] and notes[0].ts is not None
    assert not [p for p in (tmp_path / "n").iterdir() if p.name.startswith(".") and p.is_dir()]


def test_notebook_state(spark):
    rows = [
        REGISTER,
        DONE,
        REGISTER | {"id": "e2", "agent": "bob"},
        DONE | {"id": "e2", "metrics": {"validate_average_precision": 0.5, "x": 1}, "ts": "2024-01-03T00:00:00Z"},
        REGISTER | {"id": "e3", "label": "other"},
        DONE | {"id": "e3", "metrics": {"train": 0.9}, "supersedes": "e2"},
        DONE | {"id": "e3", "metrics": {"my_validate_auc": 0.9}, "ts": "2024-01-04T00:00:00Z", "failed": True},
        DONE | {"id": "lost"},
    ]
    book = entries(spark, rows)
    assert [(r.rank, r.id, r.agent, r.metric) for r in notebook.leaderboard(book).orderBy("rank").collect()] == [(1, "e2", "bob", 0.5), (2, "e1", "ann", 0.2), (3, "lost", None, 0.2)]
    assert [r.id for r in notebook.leaderboard(notebook.current(book), label="faers_prr").collect()] == ["e1"]
    assert sorted((r.id, r.evaluation) for r in notebook.evaluations(book).collect()) == [("e1", 1), ("e2", 3), ("e3", 4), ("lost", 2)]
    assert sorted((r.id, r.evaluation) for r in notebook.evaluations(book, "agent").collect()) == [("e1", 1), ("e2", 1), ("e3", 2)]
    assert notebook.evaluations(book.limit(0)).count() == 0


def scorer(spark, tmp_path, score, **how):
    return logs.Scorer(spark, f"{tmp_path}/in", "k int, r string", ["k"], score, f"{tmp_path}/out", f"{tmp_path}/cp", required="r", **how)


def add(spark, tmp_path, *rows):
    spark.createDataFrame(list(rows), "k int, r string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def test_scorer_scores_each_pair_once_without_reading_its_output(spark, tmp_path):
    ten = lambda df: df.selectExpr("k", "k * 10 as score")
    add(spark, tmp_path, (1, "x"), (2, "x"), (3, None))
    add(spark, tmp_path, (1, "y"), (4, "x"))
    s = scorer(spark, tmp_path, ten)
    assert s.status() == {"running": False, "batches": 0, "scored": 0, "last_error": None}
    s.start()
    done = s.wait()
    assert (done["running"], done["batches"], done["scored"], done["last_error"]) == (False, 2, 3, None)  # a file a batch
    assert sorted(map(tuple, s.results().collect())) == [(1, 10), (2, 20), (4, 40)]
    # what was written is spoilt: a batch that read it would fail
    for part in (tmp_path / "out").rglob("*.parquet"):
        part.write_bytes(b"spoilt")
        part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
    add(spark, tmp_path, (2, "z"), (3, "z"), (5, "z"))
    again = scorer(spark, tmp_path, ten)
    again.start()
    assert again.wait()["scored"] == 5
    new = [p for p in (tmp_path / "out").rglob("*.parquet") if p.read_bytes() != b"spoilt"]
    assert sorted(map(tuple, spark.read.parquet(*map(str, new)).select("k", "score").collect())) == [(3, 30), (5, 50)]


def test_a_batch_that_fails_after_its_commit_is_replayed_without_harm(spark, tmp_path, monkeypatch):
    add(spark, tmp_path, (1, "x"), (2, "x"))
    s = scorer(spark, tmp_path, lambda df: df.select("k"))
    real = logs.publish

    def broken(*a):
        real(*a)
        raise RuntimeError("lost after the commit")

    monkeypatch.setattr(logs, "publish", broken)
    s.start()
    done = s.wait()
    assert not done["running"] and "lost after the commit" in str(s.query.exception()) and done["last_error"]
    monkeypatch.setattr(logs, "publish", real)
    s.start()
    assert s.wait()["last_error"] is None
    assert sorted(r.k for r in s.results().collect()) == [1, 2]


def test_scorer_starts_once_and_stops(spark, tmp_path):
    add(spark, tmp_path, (1, "x"))
    s = scorer(spark, tmp_path, lambda df: df.select("k"))
    assert s.start("100 milliseconds")["running"]
    first = s.query
    assert s.start("100 milliseconds")["running"] and s.query is first
    s.query.processAllAvailable()
    add(spark, tmp_path, (2, "x"))
    s.query.processAllAvailable()
    assert not s.stop()["running"]
    add(spark, tmp_path, (3, "x"))
    assert sorted(r.k for r in s.results().collect()) == [1, 2]
    s.start()
    s.wait()
    assert sorted(r.k for r in s.results().collect()) == [1, 2, 3]
