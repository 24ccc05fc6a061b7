"""Runs that may be compared, and reports of runs."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.tables import read_json, write_json


@dataclass(frozen=True)
class Run:
    run_id: str
    data: str
    corpus: str
    metrics: dict[str, float] = field(default_factory=dict)
    status: str = "PASS"
    group: str = "default"

    @property
    def basis(self) -> tuple[str, str, str]:
        return self.data, self.corpus, self.group


class Experiments:
    """Runs on the same data, the same corpus and of one group; others are refused."""

    def __init__(self) -> None:
        self.runs: list[Run] = []

    def add(self, run: Run) -> None:
        if any(run.basis != r.basis for r in self.runs[:1]):
            raise ValueError(f"{run.run_id} was run on other data")
        self.runs.append(run)

    def best(self, metric: str = "recall@50") -> Run:
        """The run of the greatest metric, then the first name; one that lacks it is last."""
        if not self.runs:
            raise ValueError("no runs")
        return min(self.runs, key=lambda r: (-r.metrics.get(metric, float("-inf")), r.run_id))

    def write(self, spark: SparkSession, path: str) -> None:
        write_json([asdict(r) for r in self.runs], path, spark)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Experiments:
        out = cls()
        for held in read_json(path, spark):
            out.add(Run(**held))
        return out


def write_report(parts: dict[str, DataFrame], path: str) -> dict:
    """A JSON report of small tables, by name: their rows as objects."""
    value = {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in parts.items()}
    write_json(value, path, next(iter(parts.values())).sparkSession)
    return value
