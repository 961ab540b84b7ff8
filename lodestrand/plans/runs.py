"""What a run does, by its number and by what earlier runs left."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import writers

STEPS = ["ingest", "index", "enrich", "synthesize"]


@dataclass(frozen=True)
class Run:
    number: int
    steps: tuple[str, ...]
    directory: str
    started: str


def stamp(at: datetime) -> str:
    """a time in UTC as ISO text; handed in, so that a run can be repeated."""
    return at.astimezone(timezone.utc).isoformat(timespec="seconds")


def planned_runs(n: int, root: str, at: datetime, skip_after_first: bool = True) -> list[Run]:
    """The runs of a batch; from the second on, ingest and index are skipped."""
    day = at.astimezone(timezone.utc).strftime("%Y%m%d_%H%M%S")
    first = lambda k: STEPS if k == 1 or not skip_after_first else STEPS[2:]
    return [Run(k, tuple(first(k)), f"{root}/run_{day}_{k:02d}", stamp(at)) for k in range(1, n + 1)]


def reused_traits(spark: SparkSession, path: str, make, reuse: bool = True) -> DataFrame:
    """I8: traits (specie, trait) of an earlier run's file if there is one and it may be used, else what make() gives, which is written there."""
    if not (reuse and writers.exists(spark, f"{path}/_SUCCESS")):  # written to its end
        make().select("specie", "trait").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stage_stats(rows: DataFrame, name: str, triggered) -> tuple[DataFrame, Observation]:
    """Rows, and an observation of how many there were and for how many a stage was triggered; filled by the first action over them."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("seen"), F.count_if(triggered).alias("triggered"), F.round(F.avg(triggered.cast("double")), 4).alias("trigger_rate")), seen


def bundle_meta(runs: list[Run], species: DataFrame) -> dict:
    """K9: what a bundle says of itself."""
    names = [r.name for r in species.select(F.lower(T.strip("canonical")).alias("name")).distinct().orderBy("name").collect()]  # the species of one batch
    return {"runs": len(runs), "started": runs[0].started if runs else "", "species": names, "n_species": len(names), "min_species": max(2, len(names) // 2), "directories": [r.directory for r in runs]}
