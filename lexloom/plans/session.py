"""Which analyses run over the documents, and how they fared (ORC)."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import extraction, structure, terms

Pipeline = Callable[..., DataFrame]


class Registry:
    """ORC-01: pipelines by key, run in order of registration."""

    def __init__(self) -> None:
        self._by_key: dict[str, Pipeline] = {}

    def register(self, key: str, pipeline: Pipeline) -> None:
        if key in self._by_key:
            raise ValueError(f"there is a pipeline {key} already")
        self._by_key[key] = pipeline

    def get(self, key: str) -> Pipeline:
        if key not in self._by_key:
            raise KeyError(f"no pipeline {key!r}; there are {', '.join(self._by_key)}")
        return self._by_key[key]

    def resolve(self, targets: list[str]) -> list[str]:
        """Targets without repeats, in order of registration; an unknown one is an error."""
        for t in targets:
            self.get(t)
        return [k for k in self._by_key if k in targets]

    def keys(self) -> list[str]:
        return list(self._by_key)


@dataclass
class Status:
    """ORC-04: each requested pipeline is completed or failed, once."""

    requested: list[str]
    results: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, tuple[str, str]] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    finished: bool = False

    def record(self, key: str, result: DataFrame | None = None, error: tuple[str, str] | None = None) -> None:
        if self.finished:
            raise RuntimeError("the run is over")
        if key not in self.requested:
            raise ValueError(f"{key} was not requested")
        if key in self.results or key in self.errors:
            raise ValueError(f"{key} is recorded already")
        if (result is None) == (error is None):
            raise ValueError("either a result or an error")
        if error:
            self.errors[key] = error
        else:
            self.results[key] = result

    def finish(self) -> Status:
        if self.finished:
            raise RuntimeError("the run is over")
        if missing := [k for k in self.requested if k not in self.results and k not in self.errors]:
            raise RuntimeError(f"not recorded: {missing}")
        self.finished = True
        return self


def classify(error: BaseException) -> str:
    """ORC-03."""
    return "timeout" if isinstance(error, TimeoutError) else "invalid_options" if isinstance(error, ValueError) else "failed"


def _terms(docs: DataFrame, **options) -> DataFrame:
    return terms.analyse(docs, bool(options.get("unquoted", False)))["resolutions"]


def _acronyms(docs: DataFrame, **options) -> DataFrame:
    return extraction.extract(docs, bool(options.get("dotted", False)))


def _structure(docs: DataFrame, **options) -> DataFrame:
    return structure.resolve(docs, bool(options.get("convert_roman", False)))


def default_registry() -> Registry:
    out = Registry()
    out.register("acronyms", _acronyms)
    out.register("defined_terms", _terms)
    out.register("structural_references", _structure)
    return out


def _written(result: DataFrame, key: str, folder: str, seconds: float | None) -> DataFrame:
    """The result as Parquet, read again; its jobs are cancelled if they take longer than ``seconds``."""
    spark = result.sparkSession
    sc = spark.sparkContext
    group, out, late = f"{key}-{uuid.uuid4()}", f"{folder.rstrip('/')}/{key}", threading.Event()

    def cancel() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, cancel) if seconds else None
    before = {name: sc.getLocalProperty(name) for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    sc.setJobGroup(group, f"pipeline {key}", interruptOnCancel=True)
    try:
        if timer:
            timer.start()
        result.write.mode("errorifexists").parquet(out)
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"{key} took over {seconds} seconds") from e
        raise
    finally:
        if timer:
            timer.cancel()
        for name, value in before.items():
            sc.setLocalProperty(name, value)
    return spark.read.parquet(out)


def run(docs: DataFrame, targets: list[str] | None = None, options: dict[str, dict] | None = None, registry: Registry | None = None, folder: str | None = None, seconds: float | None = None) -> Status:
    """ORC-02, ORC-06: runs the targets (all if none is named); one that fails, fails alone.

    Without ``folder`` the results are plans and only planning is watched. With
    it each result is computed, written as Parquet below the folder (one that
    executors share) and read again, so what fails while it runs is recorded as
    well; ``seconds`` then bounds each target's time, after which its jobs are
    cancelled and it counts as a timeout.
    """
    if seconds is not None and (folder is None or seconds <= 0):
        raise ValueError("a time limit is positive and needs a folder, as plans take no time")
    registry = registry or default_registry()
    status = Status(registry.resolve(targets or registry.keys()))
    for key in status.requested:
        began = time.monotonic()
        try:
            result = registry.get(key)(docs, **(options or {}).get(key, {}))
            status.record(key, _written(result, key, folder, seconds) if folder else result)
        except Exception as e:  # each pipeline fails alone
            status.record(key, error=(classify(e), str(e)))
        status.seconds[key] = time.monotonic() - began
    return status.finish()


def chain(docs: DataFrame, *stages: tuple[str, Callable[[DataFrame], DataFrame]], observe: bool = False) -> DataFrame:
    """ORC-05: stages in order; with ``observe`` each counts its rows in the same job."""
    for name, stage in stages:
        docs = docs.transform(stage)
        if observe:
            docs = docs.observe(name, F.count(F.lit(1)).alias("rows"))
    return docs
