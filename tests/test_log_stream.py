"""Following logs with carried state: split files, small batches, and a restart give the table that a batch read gives."""

import random
import time

import pytest

from tallyframe.plans.source_queries import part_width
from tallyframe.streaming.plateau import follow_logs, log_table

STAMP = "I0210 13:39:22.381027 25210 solver.cpp:204] "


def line(rng, i):
    return rng.choice([
        f"{STAMP}Iteration {i}, lr = {rng.randrange(1, 9) / 100}", f"{STAMP}Iteration {i}, Testing net (#0)", f"{STAMP}    Test net output #0: accuracy = 0.{rng.randrange(100)}",
        f"{STAMP}    Train net output #1: loss = nan", f"{STAMP}Iteration {i}, loss = {rng.random():.3f}", "", "something else", f"{STAMP}lr = 0.5",
    ])


def write(folder, name, lines):
    (folder / name).write_text("".join(x + "\n" for x in lines))


def plain(logs):
    """{run: lines} -> rows (run, line_no, iteration, lr, phase, metric) with what was last seen."""
    import re

    out = []
    for run, lines in logs.items():
        iteration = lr = None
        for n, x in enumerate(lines):
            i, r, m, loss = (re.search(p, x) for p in (r"Iteration (\d+)", r"lr = ([\d.]+)", r"(Train|Test) net output #\d+: \S+ = (\S+)", r", loss = ([\d.]+)"))
            iteration, lr = int(i[1]) if i else iteration, float(r[1]) if r else lr
            if i or r or m or loss:
                out.append((run, n, iteration, lr, m[1].lower() if m else None, str(float(m[2])) if m else None))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["run"], r["line_no"], r["iteration"], r["lr"], r["phase"], None if r["metric"] is None else str(r["metric"])) for r in df.collect()), key=str)


@pytest.mark.parametrize("max_files", [None, 1])
def test_followed_logs_are_the_batch_table_across_a_restart(spark, tmp_path, max_files):
    import os

    rng = random.Random(1)
    folder, out, marks = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "marks")
    folder.mkdir()
    logs = {"a": [], "b": []}

    def add(part):
        for run in logs:
            lines = [line(rng, 100 * part + k) for k in range(rng.randrange(1, 12))]
            write(folder, f"{run}.{part:04d}.log", lines)
            os.utime(folder / f"{run}.{part:04d}.log", (1_700_000_000 + part, 1_700_000_000 + part))
            logs[run] += lines

    def follow():
        q = follow_logs(spark, str(folder), max_files=max_files).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination()

    for part in range(2):
        add(part)
    follow()
    assert rows(spark.read.parquet(out)) == plain(logs) == rows(log_table(spark, str(folder)))
    for part in range(2, 4):
        add(part)
    follow()  # goes on from the checkpoint: numbers, iterations and rates continue
    assert rows(spark.read.parquet(out)) == plain(logs) == rows(log_table(spark, str(folder)))


def test_a_long_file_is_cut_once(spark, tmp_path):
    """A log of 12,000 lines, numbered and carried forward like short ones, in time that does not grow with the square of its lines."""
    rng = random.Random(2)
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    lines = [line(rng, k) for k in range(12_000)]
    write(folder, "a.0001.log", lines)
    began = time.time()
    q = follow_logs(spark, str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert time.time() - began < 30
    assert rows(spark.read.parquet(out)) == plain({"a": lines})


def test_parts_of_logs_do_not_become_many_small_files():
    assert [part_width(n) for n in (0, 99_999, 1_000_000, 6_000_000, 36_000_000)] == [5000, 5000, 15_626, 93_751, 250_000]
