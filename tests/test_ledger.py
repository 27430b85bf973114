"""Keyed appends and streaming state: re-runs, late and repeated files, restarts."""

import json

from pyspark.sql import functions as F

from tabsleuth.session import ship_package
from tabsleuth.sources import ledger as L
from tabsleuth.streaming import usage as SU


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id string, sc_id long, answer string, transcript string")


def test_append_is_keyed(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert L.read(spark, path) is None
    first = _frame(spark, [("a", 0, "x", "t1"), ("a", 0, "x", "t1"), ("b", 0, "y", None), (None, 1, "z", "t3")])
    assert L.append(first, path, transcript="transcript") == 3
    assert L.append(first, path, transcript="transcript") == 0                    # the same run again
    assert L.append(_frame(spark, [("a", 0, "other", "t"), ("a", 1, "w", "t4")]), path, transcript="transcript") == 1
    want = {("a", 0, "x"), ("b", 0, "y"), (None, 1, "z"), ("a", 1, "w")}
    assert set(map(tuple, L.read(spark, path).collect())) == want
    # a batch that was never committed is not seen
    _frame(spark, [("c", 0, "lost", "t")]).drop("transcript").write.parquet(f"{path}/records/0123")
    assert set(map(tuple, L.read(spark, path).collect())) == want
    L.compact(spark, path)
    assert len(L._entries(spark, path)) == 1 and set(map(tuple, L.read(spark, path).collect())) == want
    assert {r.transcript for r in L.read(spark, path, "transcripts").collect()} == {"t1", None, "t3", "t4"}
    assert L.append(first, path, transcript="transcript") == 0


def test_resume_answers_only_what_is_open(spark, tmp_path):
    path = str(tmp_path / "runs")
    asked = []

    def answer(tasks):
        asked.append(tasks.count())
        return tasks.select("id", "sc_id", F.concat("id", F.lit("!")).alias("answer"))
    tasks = spark.range(6).select(F.col("id").cast("string").alias("id"), F.lit(0).cast("long").alias("sc_id"))
    assert L.run_pending(tasks.where("id < 4"), path, answer).count() == 4
    assert L.run_pending(tasks, path, answer).count() == 6
    assert L.run_pending(tasks, path, answer).count() == 6
    assert asked == [4, 2, 0]


def _deliver(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records))


def _record(i, sc, answer, label="a", tokens=1):
    return {"id": i, "sc_id": sc, "answer": answer, "label": label, "input_token_count": tokens, "output_token_count": tokens}


def test_votes_change_only_where_records_arrive(spark, tmp_path):
    ship_package(spark)
    files, check, out = tmp_path / "in", str(tmp_path / "check"), str(tmp_path / "out")
    _deliver(files, "1.json", [_record("q1", 0, "b"), _record("q2", 1, "a"), _record("q3", 0, "c"), _record(None, 0, "x")])
    votes = {r.id: (r.pred, r.correct) for r in SU.running_vote(spark, str(files), check, out).collect()}
    assert votes == {"q1": ("b", False), "q2": ("a", True), "q3": ("c", False)}
    # a repeated file under another name, and a late record that comes first by sc_id
    _deliver(files, "2.json", [_record("q1", 0, "b"), _record("q3", 0, "c")])
    _deliver(files, "3.json", [_record("q1", 1, "a"), _record("q1", 2, "a"), _record("q2", 0, "d")])
    votes = {r.id: (r.pred, r.correct) for r in SU.running_vote(spark, str(files), check, out, files_per_batch=1).collect()}     # a restart
    assert votes == {"q1": ("a", True), "q2": ("d", False), "q3": ("c", False)}
    written = SU._written(spark, out).groupBy("epoch").agg(F.collect_set("id").alias("ids")).collect()
    assert sorted(sorted(r.ids) for r in written) == [["q1", "q2"], ["q1", "q2", "q3"]]          # only changed questions
    total = SU._written(spark, out).agg(F.sum("input_tokens"), F.sum("total_tokens"), F.sum("n_records")).first()
    assert tuple(total) == (6, 12, 6)


def test_states_expire(spark, tmp_path):
    ship_package(spark)
    files, check, out = tmp_path / "in", str(tmp_path / "check"), str(tmp_path / "out")
    _deliver(files, "1.json", [_record("q1", 0, "b")])
    SU.run_changes(spark, str(files), check, out, expire_ms=1)
    _deliver(files, "2.json", [_record("q2", 0, "b")])
    SU.run_changes(spark, str(files), check, out, expire_ms=1)
    _deliver(files, "3.json", [_record("q1", 0, "b")])
    SU.run_changes(spark, str(files), check, out, expire_ms=1)
    assert SU._written(spark, out).where("id = 'q1'").count() == 2               # the first state was gone
