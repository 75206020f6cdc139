"""Plateau monitor over test losses, in batch and as a stream with the same state function; log tails."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUT = "run long, iteration long, loss double, best double, steps long, periods long, lr double, nonfinite long, stop boolean"
STATE = "best double, steps long, periods long, since long, nonfinite long, stopped boolean"


@dataclass(frozen=True)
class Params:
    base_lr: float = 0.01
    gamma: float = 0.1
    max_steps: int = 3
    max_periods: int = 3
    #: Least iterations since the last drop, for each period; the last counts for all that follow.
    min_iters: tuple[int, ...] = (0,)


@dataclass
class State:
    best: float = float("inf")
    steps: int = 0
    periods: int = 0
    since: int = 0  # iteration of the last drop of the rate
    nonfinite: int = 0
    stopped: bool = False


def advance(s: State, iteration: int, loss: float, p: Params) -> State:
    """The state after one test loss."""
    bad = loss is None or loss != loss or abs(loss) == float("inf")
    s = State(*astuple(s))
    s.nonfinite = s.nonfinite + 1 if bad else 0
    if not bad and loss < s.best:
        s.best, s.steps = loss, 0
    else:
        s.steps += 1
    need = p.min_iters[min(s.periods, len(p.min_iters) - 1)]
    if not s.stopped and s.steps >= p.max_steps and iteration - s.since >= need:
        s.periods, s.steps, s.since = s.periods + 1, 0, iteration
        s.stopped = s.periods >= p.max_periods
    return s


def _rows(run: int, pdf: pd.DataFrame, s: State, p: Params) -> tuple[list[tuple], State]:
    out = []
    for i, x in zip(pdf["iteration"].tolist(), pdf["loss"].tolist(), strict=True):
        s = advance(s, i, x, p)
        out.append((run, i, x, None if s.best == float("inf") else s.best, s.steps, s.periods, p.base_lr * p.gamma**s.periods, s.nonfinite, s.stopped))
    return out, s


_NAMES = [c.split()[0] for c in OUT.split(", ")]


def plateau_monitor(df: DataFrame, params: Params = Params()) -> DataFrame:
    """The monitor's state after each row of ``df(run, iteration, loss)``; runs are read in order of iteration.

    A task reads its runs row by row and carries only the state of the present one from batch to batch.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, s = None, State()
        for pdf in batches:
            out = []
            for run, part in pdf.groupby("run", sort=False, dropna=False):
                if run != here:
                    here, s = run, State()
                rows, s = _rows(run, part, s, params)
                out += rows
            yield pd.DataFrame(out, columns=_NAMES)

    return df.select("run", "iteration", "loss").repartition("run").sortWithinPartitions("run", "iteration").mapInPandas(walk, OUT)


def plateau_stream(df: DataFrame, params: Params = Params()) -> DataFrame:
    """The same over a stream whose batches come in order of iteration; the state is kept a run."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = State(*state.get) if state.exists else State()
        pdf = pd.concat(list(parts)).sort_values("iteration")
        rows, s = _rows(key[0], pdf, s, params)
        state.update(astuple(s))
        yield pd.DataFrame(rows, columns=_NAMES)

    return df.select("run", "iteration", "loss").groupBy("run").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed metric lines of a growing folder of log files: run, iteration, lr, phase, output, metric, loss."""
    from ..operators.logs import parse_log_metrics

    lines = spark.readStream.text(folder).select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "").alias("run"), F.lit(0).alias("line_no"), "value")
    return parse_log_metrics(lines).drop("line_no")


#: Runs are named by the file up to its first dot, so a run's log may be in many files: a.0001.log, a.0002.log ...
RUN_OF_FILE = r"([^/.]+)[^/]*$"
FOLLOWED = "run string, line_no long, iteration long, lr double, phase string, output_no int, output string, metric double, loss double"
_CARRIED = "lines long, iteration long, lr double"


def _log_parts(files: DataFrame, run: str) -> DataFrame:
    """Parsed lines of whole files (value, path): run, at (file, line in it), last (lines of the file, on its last one), and what F13 finds."""
    lines = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")
    # what stands beside a generator is computed for each of its rows, so a file is cut before
    cut = files.select(F.regexp_extract("path", run, 1).alias("run"), "path", lines.alias("lines")).withColumn("n", F.size("lines"))
    rows = cut.select("run", "path", "n", F.posexplode("lines").alias("at", "value"))
    # the place goes through the parser as one column
    from ..operators.logs import parse_log_metrics

    place = F.struct(F.col("path"), F.col("at").cast("long").alias("at"), F.when(F.col("at") == F.col("n") - 1, F.col("n").cast("long")).alias("last"))
    return parse_log_metrics(rows.select("run", place.alias("line_no"), "value")).select("run", "line_no.*", "iteration", "lr", "phase", "output_no", "output", "metric", "loss")


def log_table(spark: SparkSession, folder: str, run: str = RUN_OF_FILE) -> DataFrame:
    """The table of ``follow_logs`` from files that are all there: lines numbered along the files of a run, iteration and rate carried forward."""
    from ..operators.logs import fill_forward
    from ..operators.sampling import place_in

    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    sizes = place_in(_log_parts(files, run).where("last is not null").select("run", "path", "last"), "run", ["path"], "_no", {"before": "last"}).select("path", "before")
    rows = _log_parts(files, run).where(F.coalesce("iteration", "lr", "metric", "loss").isNotNull()).join(sizes, "path")
    rows = rows.withColumn("line_no", F.col("before") + F.col("at"))
    return fill_forward(rows).select(*[f.split()[0] for f in FOLLOWED.split(", ")])


def follow_logs(spark: SparkSession, folder: str, run: str = RUN_OF_FILE, max_files: int | None = None) -> DataFrame:
    """A stream of the metric lines of a growing folder: ``FOLLOWED``, a row a line that says something, iteration and rate carried forward.

    A run's files are read in order of their names within a batch, and of their coming from batch to batch.  The state of a run is its number of
    lines so far, its iteration and its rate, kept with the query's checkpoint, so that a restarted query goes on with the same numbers.  A file is a row until it is cut into
    lines (logs in parts), and only lines that say something, and one a file, reach the state's function.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [f.split()[0] for f in FOLLOWED.split(", ")]
    source = spark.readStream.option("recursiveFileLookup", True)
    source = source.option("maxFilesPerTrigger", max_files) if max_files else source
    files = source.text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    says = F.coalesce("iteration", "lr", "metric", "loss").isNotNull()
    rows = _log_parts(files, run).withColumn("says", says).where("says or last is not null")
    texts = {c: F.col(c).cast("string") for c in ("metric", "loss")}  # pandas would take not-a-number for null

    def carry(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lines, iteration, lr = state.get if state.exists else (0, None, None)
        seen: dict[str, int] = {}  # paths as numbers, so that a run's lines stay small
        pdf = pd.concat([p.assign(path=p["path"].map(lambda x: seen.setdefault(x, len(seen)))) for p in parts])
        order = {seen[x]: i for i, x in enumerate(sorted(seen))}
        pdf = pdf.assign(path=pdf["path"].map(order)).sort_values(["path", "at"], ignore_index=True)
        ends = pdf["last"].astype("float64").fillna(0).astype("int64")
        pdf["line_no"] = lines + ends.cumsum() - ends + pdf["at"]
        for c, before in (("iteration", iteration), ("lr", lr)):
            known = pdf[c].astype("float64").ffill()
            pdf[c] = (known if before is None else known.fillna(before)).astype("Int64" if c == "iteration" else "Float64")
        iteration, lr = (None if pd.isna(x) else x for x in (pdf["iteration"].iloc[-1], pdf["lr"].iloc[-1]))
        state.update((lines + int(ends.sum()), iteration if iteration is None else int(iteration), lr if lr is None else float(lr)))
        out = pdf[pdf["says"].astype(bool)]
        out = out.assign(run=key[0], output_no=out["output_no"].astype("Int32"))[names]
        yield out.astype({c: object for c in ("phase", "output", "metric", "loss")}).where(out.notna(), None)

    schema = FOLLOWED.replace("metric double, loss double", "metric string, loss string")
    made = rows.withColumns(texts).groupBy("run").applyInPandasWithState(carry, schema, _CARRIED, "append", GroupStateTimeout.NoTimeout)
    return made.withColumns({c: F.col(c).cast("double") for c in texts})
