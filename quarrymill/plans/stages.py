"""Running named stages with resume and a guarded clean."""

from __future__ import annotations

import importlib.util
import shutil
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quarrymill.plans.storage import exists


class StageRunner:
    """Stages (name, function of session and the tables so far), each kept as Parquet below ``folder``, in any store that Spark writes."""

    def __init__(self, spark: SparkSession, folder: str, stages: list[tuple[str, Callable[[SparkSession, dict[str, DataFrame]], DataFrame]]]):
        self.spark, self.folder, self.stages = spark, folder.rstrip("/"), stages

    def done(self) -> list[str]:
        """The finished stages that no unfinished one precedes."""
        out = []
        for name, _ in self.stages:
            if not exists(self.spark, f"{self.folder}/{name}/_SUCCESS"):
                break
            out.append(name)
        return out

    def run(self, resume: bool = True, first: str | None = None) -> dict[str, float]:
        """Seconds of each stage that ran; ``first`` names the stage to begin with."""
        names = [n for n, _ in self.stages]
        if first is not None and first not in names:
            raise ValueError(f"no stage {first}")
        skip = names[: names.index(first)] if first else self.done() if resume else []
        tables, took = {}, {}
        for name, stage in self.stages:
            at = f"{self.folder}/{name}"
            if name not in skip:
                began = time.perf_counter()
                stage(self.spark, tables).write.mode("overwrite").parquet(at)
                took[name] = time.perf_counter() - began
            tables[name] = self.spark.read.parquet(at)
        return took


def guarded_clean(folder: str, inside: str) -> None:
    """Empties a folder that lies truly inside another; refuses anything else."""
    target, root = Path(folder).resolve(), Path(inside).resolve()
    if target == root or root not in target.parents:
        raise ValueError(f"{target} isn't inside {root}")
    shutil.rmtree(target, ignore_errors=True)
    target.mkdir(parents=True)


def environment() -> dict[str, bool]:
    """Which optional libraries are installed."""
    return {name: importlib.util.find_spec(name) is not None for name in ("PIL", "cv2", "torch", "open_clip", "pillow_heif", "onnxruntime")}
