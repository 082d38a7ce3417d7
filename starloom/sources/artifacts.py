"""What a run leaves behind: JSON documents, event lines, masks; and small file helpers on Hadoop paths."""

from __future__ import annotations

import json
import os
import shutil
import sys
from collections.abc import Iterable
from dataclasses import asdict, is_dataclass
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST = 120_000  # fixed value: rows by frame and tile beyond which a production run leaves them out of its JSON


def write_artifact(rows: DataFrame, path: str, head: dict[str, object] | None = None) -> None:
    """A table of a run as JSON lines in a folder, one file a partition, with ``head`` as a line of its own first.

    Rows are written by the executors; nothing is gathered, however large the table is."""
    spark = rows.sparkSession
    if head is not None:
        spark.createDataFrame([(json.dumps(head, sort_keys=True),)], "value string").write.mode("overwrite").text(f"{path}/head")
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/rows")


def read_artifact(spark: SparkSession, path: str, schema: str) -> tuple[dict[str, object], DataFrame]:
    head = spark.read.text(f"{path}/head").first()
    return json.loads(head.value), spark.read.schema(schema).json(f"{path}/rows")


def keeps_rows(mode: str, frames: int, tiles: int) -> bool:
    """Whether rows by frame and tile go into a run's JSON."""
    return mode != "production" or frames * tiles <= LARGEST


class EventSink:
    """Appends events as JSON lines to a run's log, each flushed, and to another stream (standard output)."""

    def __init__(self, path: str, run_id: str, tee=sys.stdout):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        self.file, self.run_id, self.tee = open(path, "a", encoding="utf-8"), run_id, tee

    def emit(self, kind: str, **fields: object) -> None:
        at = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
        line = json.dumps({"ts": at, "type": kind, "run_id": self.run_id} | fields)
        for out in filter(None, (self.file, self.tee)):
            out.write(line + "\n")
            out.flush()

    def close(self) -> None:
        self.file.close()


def as_record(config: object) -> dict[str, object]:
    """Settings or diagnostics as plain values for JSON: arrays become lists, and what is not finite becomes null."""

    def plain(x: object) -> object:
        if is_dataclass(x) and not isinstance(x, type):
            return plain(asdict(x))
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple, np.ndarray)):
            return [plain(v) for v in x]
        if isinstance(x, np.generic):
            return plain(x.item())
        return None if isinstance(x, float) and not np.isfinite(x) else x

    return plain(config)


def mask_table(px: DataFrame) -> DataFrame:
    """canvas(y, x, inside) as a table that masks are stored as: 1 and 0 for pixels inside and outside."""
    return px.select("y", "x", F.col("inside").cast("float").alias("v"))


def load_mask(stored: DataFrame, height: int, width: int) -> DataFrame:
    """The mask again, if it has a value for every pixel of an image of this size."""
    shape = stored.agg(F.count("*").alias("n"), F.max("y").alias("y"), F.max("x").alias("x")).first()
    if (shape.n, shape.y, shape.x) != (height * width, height - 1, width - 1):
        raise ValueError(f"mask of {shape.n} pixels up to ({shape.y}, {shape.x}) for an image of {height} x {width}")
    return stored.select("y", "x", (F.col("v") > 0.5).alias("inside"))


def link_or_copy(source: str, target: str) -> str:
    """A hard link, or a copy where links can't be made; how it was done."""
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    if os.path.exists(target):
        os.remove(target)
    try:
        os.link(source, target)
        return "link"
    except OSError:
        shutil.copy2(source, target)
        return "copy"


def first_existing(folder: str, names: Iterable[str]) -> str | None:
    """The first of some files that is there."""
    return next((p for p in (os.path.join(folder, n) for n in names) if os.path.isfile(p)), None)


def project_root(start: str, marks: Iterable[str] = (".git", "pyproject.toml")) -> str:
    """The nearest folder above that holds one of ``marks``, or ``start``."""
    here = os.path.abspath(start)
    while True:
        if any(os.path.exists(os.path.join(here, m)) for m in marks):
            return here
        up = os.path.dirname(here)
        if up == here:
            return os.path.abspath(start)
        here = up
