"""Walk-forward fits: the windows of each instrument dealt to tasks, a failure kept as a row if asked for."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import forward_fill

#: Windows and forecasts of a block: (columns of the instrument's rows, rows to begin at) to (rows, their forecasts).
Fit = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def walk(data: DataFrame, name: str, columns: list[str], fit: Fit, starts: Callable[[int], np.ndarray], blocks: int = 8, isolate: bool = False) -> DataFrame:
    """(ticker, dt, name): what ``fit`` forecasts of each instrument, whose rows in order are a matrix of ``columns``, unknown values nan.

    ``starts`` tells from the number of rows at which of them to fit; they are dealt in ``blocks`` runs, each with all rows of the
    instrument. Rows without a finite forecast are left out. An exception ends the job and names the instrument; with
    ``isolate`` it becomes a row without day and forecast, with its text in a column ``error``, and other instruments go on.
    """
    known = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns]
    days = data.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("dt", F.array(*known).alias("x")))).alias("s"))
    dealt = days.select("ticker", "s", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    # In turn, not by hash, and to a stated number of tasks: a few rows stand for much work, which sizes in bytes do not show.
    dealt = dealt.repartition(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        for b in batches:
            for ticker, s, block in zip(*(b.column(k) for k in range(3)), strict=True):
                s, error = s.values, None
                x = s.field("x").flatten().to_numpy(zero_copy_only=False).reshape(len(s), len(columns))
                own = np.array_split(starts(len(x)), blocks)[block.as_py()]
                try:
                    at, value = fit(x, own) if len(own) else ([], [])
                except ImportError:
                    raise  # a fault of the installation, not of the instrument
                except Exception as e:
                    if not isolate:
                        raise RuntimeError(f"{name} failed for {ticker.as_py()}") from e
                    at, value, error = [], [], f"{type(e).__name__}: {e}"
                at, value = np.asarray(at, np.int64), np.asarray(value, np.float64)
                at, value = at[np.isfinite(value)], value[np.isfinite(value)]
                day = pa.concat_arrays([s.field("dt").take(pa.array(at)), pa.nulls(int(error is not None), s.field("dt").type)])
                n = len(day)
                cells = [pa.array([ticker.as_py()] * n, ticker.type), day, pa.array([*value, *[None] * (n - len(value))], pa.float64())]
                kept = ["ticker", "dt", name]
                if isolate:
                    cells, kept = [*cells, pa.array([error] * n, pa.string())], [*kept, "error"]
                yield pa.RecordBatch.from_arrays(cells, kept)

    made = data.select("ticker", "dt").withColumn(name, F.lit(None).cast("double"))
    return dealt.mapInArrow(run, (made.withColumn("error", F.lit(None).cast("string")) if isolate else made).schema)


def on_rows(data: DataFrame, made: DataFrame, name: str, fill: bool = True) -> DataFrame:
    """(ticker, dt, name) of all rows of data, forecasts filled forward."""
    out = data.select("ticker", "dt").join(made, ["ticker", "dt"], "left")
    return out.withColumn(name, forward_fill(F.col(name))) if fill else out
