"""Staged runs from a configuration: named stages, each a function of frames, with results kept as Parquet and a manifest,
so a run that is resumed skips what is done. Run records are a table that can be searched and compared."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.files import Artifacts

VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::([^}]*))?\}")


def substitute(value, environ: dict[str, str] | None = None):
    """``${NAME:default}`` in strings, at any depth; a string that is all one variable becomes a bool, int or float if it
    reads as one. A variable without value and default raises KeyError."""
    env = environ if environ is not None else dict(os.environ)
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise KeyError(m[1])
        return m[2]

    made = VARIABLE.sub(one, value)
    if not VARIABLE.fullmatch(value):
        return made
    if made.lower() in ("true", "false"):
        return made.lower() == "true"
    for kind in (int, float):
        try:
            return kind(made)
        except ValueError:
            pass
    return made


def merged(base: dict, over: dict) -> dict:
    """Nested dictionaries, the second one's values first."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def check_config(config: dict, required: dict[str, type]) -> list[str]:
    """Problems: dotted names that are missing or of another type."""
    found = []
    for name, kind in required.items():
        at: object = config
        for part in name.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at is None:
            found.append(f"{name} is missing")
        elif not isinstance(at, kind):
            found.append(f"{name} is {type(at).__name__}, not {kind.__name__}")
    return found


@dataclass
class Stage:
    """``run`` gets the session, the configuration and the frames of the stages before."""

    name: str
    run: Callable[[SparkSession, dict, dict[str, DataFrame]], DataFrame]
    after: list[str] = field(default_factory=list)


class Runner:
    def __init__(self, spark: SparkSession, root: str, stages: list[Stage], config: dict | None = None):
        self.spark, self.stages, self.config = spark, stages, config or {}
        self.artifacts = Artifacts(spark, root)
        self.took: dict[str, float] = {}

    def plan(self) -> list[str]:
        """Names in an order that respects ``after``."""
        done: list[str] = []
        rest = list(self.stages)
        while rest:
            ready = [s for s in rest if set(s.after) <= set(done)]
            if not ready:
                raise ValueError(f"stages wait for each other: {', '.join(s.name for s in rest)}")
            done += [s.name for s in ready]
            rest = [s for s in rest if s not in ready]
        return done

    def run(self, run_id: str, resume: bool = True) -> dict[str, DataFrame]:
        known = {r.name for r in self.artifacts.manifest().collect()} if resume else set()
        frames: dict[str, DataFrame] = {}
        by = {s.name: s for s in self.stages}
        for name in self.plan():
            artifact = f"{run_id}.{name}"
            began = time.perf_counter()
            if artifact not in known:
                self.artifacts.save_frame(artifact, by[name].run(self.spark, self.config, frames), {"run": run_id})
            frames[name] = self.artifacts.load(artifact)
            self.took[name] = time.perf_counter() - began
        return frames


class Tracker:
    """Runs with parameters and metrics, as JSON rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self, run: str, params: dict, metrics: dict[str, float]) -> None:
        row = json.dumps({"run": run, "params": {k: str(v) for k, v in params.items()}, "metrics": metrics})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{run}")

    def runs(self) -> DataFrame:
        return self.spark.read.schema("run string, params map<string,string>, metrics map<string,double>").json(f"{self.root}/*")

    def search(self, where: str) -> DataFrame:
        """Runs that meet a condition on run, params and metrics, such as ``metrics['auc'] > 0.8 AND params['depth'] = '3'``;
        what a run has not logged is null."""
        return self.runs().filter(where)

    def best(self, metric: str, least: bool = False) -> str | None:
        m = F.try_element_at("metrics", F.lit(metric))
        r = self.runs().filter(m.isNotNull()).orderBy(m if least else F.desc(m), "run").first()
        return r.run if r else None

    def compare(self, metrics: list[str]) -> DataFrame:
        return self.runs().select("run", *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics])
