"""Counts of rows by stage, taken while the rows pass: no stage may drop, add or swap one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Lost(RuntimeError):
    pass


class Ledger:
    """Observes stages of one action. ``keys`` name a row, such as path, run_index and result_index.

    A stage's metrics are its number of rows and the sum of its rows' key hashes, whose order doesn't matter: they come with the
    action that runs the stages, without another scan. ``runs`` tells each run's numbers where there are few runs.
    """

    def __init__(self, keys: list[str]):
        self.keys, self.stages = keys, []

    def watch(self, rows: DataFrame, stage: str, runs: tuple = ()) -> DataFrame:
        """The same rows, observed. ``runs``: (name, condition) of runs that are counted apart."""
        seen = Observation(f"{stage}-{len(self.stages)}")
        self.stages.append((stage, seen, [n for n, _ in runs]))
        mark = F.sum(F.xxhash64(*self.keys).cast("decimal(38,0)")).alias("mark")
        return rows.observe(seen, F.count(F.lit(1)).alias("n"), mark, *[F.count_if(c).alias(f"run {n}") for n, c in runs])

    def check(self) -> dict[str, int]:
        """After the action: rows of each stage. The first stage that differs from the one before fails by name."""
        before, out = None, {}
        for stage, seen, runs in self.stages:
            got = dict(seen.get)
            out[stage] = got["n"]
            if before is not None:
                for run in runs:
                    if f"run {run}" in before and before[f"run {run}"] != got[f"run {run}"]:
                        raise Lost(f"{stage}: run {run} has {got[f'run {run}']} rows, {before[f'run {run}']} before")
                if got["n"] != before["n"]:
                    raise Lost(f"{stage}: {got['n']} rows, {before['n']} before")
                if got["mark"] != before["mark"]:
                    raise Lost(f"{stage}: as many rows as before, others among them")
            before = got
        return out
