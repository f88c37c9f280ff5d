"""Arriving clips: each scored once, failed ones again, by the next rows or by timer; restarts go on from the checkpoint."""

import os
import time

from lumenframe.streaming import arrivals as A
from lumenframe.streaming import progress as S


def _scorer(folder):
    """Fails below the number in a file, so that a test can change its mind."""

    def score(row):
        with open(f"{folder}/least") as f:
            if not row["v"] > float(f.read()):
                raise ValueError("too small")
        return {"score": row["v"] * 2}

    return score


class Run:
    def __init__(self, spark, tmp_path):
        self.spark, self.tmp = spark, tmp_path
        self.inp, self.out, self.ckpt = (str(tmp_path / d) for d in ("in", "out", "ck"))
        self.least(0)

    def least(self, value):
        (self.tmp / "least").write_text(str(value))

    def put(self, rows):
        self.spark.createDataFrame(rows, "clip string, v double").coalesce(1).write.mode("append").parquet(self.inp)

    def start(self, **more):
        stream = S.clip_stream(self.spark, self.inp, "clip string, v double")
        scored = A.scored_once(stream, "clip", _scorer(str(self.tmp)), "score double", retry_ms=1)
        self.schema = scored.schema
        return A.start_scoring(scored, self.out, self.ckpt, every=3, **more)

    def rows(self):
        return sorted((r.clip, r.v, r.score, r.tries) for r in A.scores(self.spark, self.out, self.schema).collect())

    def reports(self):
        return sorted(r.processed for r in self.spark.read.parquet(f"{self.out}/reports").collect())


def test_good_rows_of_a_backlog_count_and_failed_clips_come_again(spark, tmp_path):
    run = Run(spark, tmp_path)
    mixed = [(f"c{i}", v) for i in range(8) for v in ((-1.0, 3.0) if i % 2 else (3.0, -1.0))]
    run.put([*mixed, ("late", -2.0)])
    run.start().awaitTermination()
    assert [(c, v, s) for c, v, s, _ in run.rows()] == [(f"c{i}", 3.0, 6.0) for i in range(8)] and run.reports() == [3, 6]
    run.least(-5)
    run.put([("new", 1.0), ("c0", 4.0)])
    run.start().awaitTermination()
    assert [(c, v) for c, v, *_ in run.rows()] == [*[(f"c{i}", 3.0) for i in range(8)], ("late", -2.0), ("new", 1.0)]
    assert {c: t for c, *_, t in run.rows()}["late"] == 2 and run.reports() == [3, 6, 9]


def test_timers_try_again_without_new_rows(spark, tmp_path):
    run = Run(spark, tmp_path)
    run.put([("a", 1.0), ("b", -1.0)])
    query = run.start(poll="500 milliseconds")
    try:
        until = time.time() + 90
        while not os.path.exists(f"{run.out}/totals/batch=0/_SUCCESS") and time.time() < until:
            time.sleep(0.2)
        assert [r[0] for r in run.rows()] == ["a"]
        run.least(-5)
        while len(run.rows()) < 2 and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    assert [r[:3] for r in run.rows()] == [("a", 1.0, 2.0), ("b", -1.0, -2.0)]


def test_a_batch_reads_one_total_and_no_earlier_scores(spark, tmp_path):
    """Earlier scores and totals may be gone: a batch reads its own rows and the total before it."""
    import shutil

    run = Run(spark, tmp_path)
    for i in range(3):
        run.put([(f"x{i}", 1.0)])
        run.start().awaitTermination()
        for old in sorted(os.listdir(f"{run.out}/totals"))[:-1]:
            shutil.rmtree(f"{run.out}/totals/{old}")
        for old in os.listdir(f"{run.out}/scores"):
            if i < 2:
                shutil.rmtree(f"{run.out}/scores/{old}")
    assert [r[0] for r in run.rows()] == ["x2"] and run.reports() == [3]
    run.put([("x0", 2.0)])
    run.start().awaitTermination()
    assert [r[0] for r in run.rows()] == ["x2"]  # x0 has been scored


def test_reports_catch_up():
    assert A.reports_due(0, 9, 10) == [] and A.reports_due(9, 31, 10) == [10, 20, 30] and A.reports_due(10, 10, 10) == []
