"""Streams that stop and go on: keyed state and kept-up views against what a batch gives."""

import json
from datetime import datetime, timedelta

from evalloom.operators import logs, snapshots
from evalloom.sources.files import read_jsonl
from evalloom.streaming import attempts as live

LOG = "ts timestamp, execution_id long, request_key long, outcome string, n int"
START = datetime(2024, 5, 1, 12)


def append(folder, name, rows):
    """rows: (minute, execution, request, outcome)."""
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"ts": None if m is None else (START + timedelta(minutes=m)).isoformat(), "execution_id": e, "request_key": r, "outcome": o, "n": 1}) for m, e, r, o in rows]
    (folder / name).write_text("\n".join(lines))


def test_series_end_by_outcome_or_patience_across_restarts(spark, tmp_path):
    log, out, state = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "state")

    def drain():
        rows = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(log)).withWatermark("ts", "1 minute")
        live.to_parquet(live.request_series(rows, patience=timedelta(minutes=30)), out, state).awaitTermination(120)
        return sorted((r.execution_id, r.request_key, r.outcome, r.attempts, r.last_ms - r.first_ms) for r in spark.read.schema(live.SERIES).parquet(out).collect())

    append(log, "a.json", [(0, 1, 1, "retry"), (1, 1, 2, "retry"), (2, 1, 3, "success"), (None, 1, 9, "success"), (3, None, 4, "success")])
    assert drain() == [(1, 3, "success", 1, 0)]
    append(log, "b.json", [(5, 1, 1, "retry"), (7, 1, 1, "terminal_error"), (6, 1, 1, "success")])
    assert drain() == [(1, 1, "success", 4, 7 * 60_000), (1, 3, "success", 1, 0)]
    append(log, "c.json", [(90, 2, 1, "retry")])
    append(log, "d.json", [(91, 2, 1, "retry")])
    assert drain() == [(1, 1, "success", 4, 7 * 60_000), (1, 2, "abandoned", 1, 0), (1, 3, "success", 1, 0)]
    append(log, "e.json", [(200, 3, 1, "success")])
    append(log, "f.json", [(201, 3, 2, "success")])
    assert (2, 1, "abandoned", 2, 60_000) in drain()


def test_a_view_kept_up_by_a_stream_is_the_batch_view(spark, tmp_path):
    log, path, state = tmp_path / "log", str(tmp_path / "view"), str(tmp_path / "state")
    view = snapshots.View(("execution_id", "request_key"), ("ts", "outcome"), ("outcome",), ("n",))

    def drain():
        rows = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(log))
        live.kept_up(rows, path, view, state, 4).awaitTermination(120)
        whole = read_jsonl(spark, str(log), LOG)
        got = snapshots.current(spark, path, view, whole)
        return [sorted(map(repr, map(tuple, df.collect()))) for df in (got, logs.current_view(whole, ["execution_id", "request_key"], ["ts", "outcome"], ["outcome"], ["n"]))]

    append(log, "a.json", [(9, 1, 1, "retry"), (2, 1, 2, "retry")])
    append(log, "b.json", [(5, 1, 1, "success")])
    got, want = drain()
    assert got == want and len(got) == 2
    append(log, "c.json", [(0, 1, 2, "late"), (99, 4, 4, "success"), (10, 1, 1, "success")])
    got, want = drain()
    assert got == want and len(got) == 3
