"""Frames in long form, from the driver's tables and from FITS files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, COMMON = 16, 8  # pixels a side; frames that make a pixel common

PX_SQL = f"""px AS (SELECT l_suppkey AS frame_id, l_partkey % {SIDE} AS y, l_orderkey % {SIDE} AS x,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS v FROM lineitem GROUP BY 1, 2, 3)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px(frame_id, y, x, v): a frame for each supplier, so frames grow with the table; prices as pixel values, summed as integers so that every engine agrees."""
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    keys = (F.col("l_suppkey").alias("frame_id"), (F.col("l_partkey") % SIDE).alias("y"), (F.col("l_orderkey") % SIDE).alias("x"))
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg((cents.cast("double") / F.count("*") / 100).alias("v"))


IMAGES = (".fits", ".fit", ".fts", ".fits.fz")  # fixed values: suffixes of images, in lower case


def is_image(path: Column) -> Column:
    """Whether a path ends like an image, whatever the case of its letters."""
    found = F.lit(False)
    for suffix in IMAGES:
        found = found | F.endswith(F.lower(path), F.lit(suffix))
    return found


def discover(spark: SparkSession, folder: str, patterns: str = "*.fit;*.fits;*.fts") -> DataFrame:
    """frame_id, path: files of one folder (not below it) that meet one of several patterns, numbered in lexical order
    of their paths (one row a file). ``*`` and ``?`` are the only signs of a pattern; names match in any case."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    wanted = F.lit(False)
    for one in filter(None, (p.strip().lower() for p in patterns.split(";"))):
        wanted = wanted | name.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in one) + "$")
    found = files.where(wanted)
    return found.withColumn("frame_id", (F.row_number().over(Window.orderBy("path")) - 1).cast("long"))


def _image_hdu(take: Callable[[int, int], bytes]) -> tuple[dict[str, str], int, list[int]]:
    """Header cards, place of the data and axes of the first HDU with an image; ``take`` (at, n) reads bytes."""
    at = 0
    while True:
        cards, done = {}, False
        while not done:
            block = take(at, 2880)
            if len(block) < 2880:
                raise ValueError("no image found")
            at += 2880
            for i in range(0, 2880, 80):
                card = block[i : i + 80].decode("ascii", "replace")
                if card.startswith("END") and not card[3:].strip():
                    done = True
                    break
                if card[8:10] == "= ":
                    text = card[10:]
                    cards[card[:8].strip()] = text.strip()[1:].split("'")[0].rstrip() if text.strip().startswith("'") else text.split("/")[0].strip()
        axes = [int(cards.get(f"NAXIS{k + 1}", 0)) for k in range(int(cards.get("NAXIS", 0)))]
        size = abs(int(cards.get("BITPIX", 8))) // 8 * int(np.prod(axes)) if axes else 0
        if len(axes) >= 2 and size:
            return cards, at, axes
        at += -(-(size + int(cards.get("PCOUNT", 0))) // 2880) * 2880


_KINDS = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def _values(cards: dict[str, str], raw: np.ndarray) -> np.ndarray:
    return (raw * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))).astype(np.float32)


def parse_fits(content: bytes) -> tuple[dict[str, str], np.ndarray]:
    """Header cards and first plane of the first image HDU, as float32."""
    cards, at, axes = _image_hdu(lambda i, n: content[i : i + n])
    raw = np.frombuffer(content, _KINDS[int(cards["BITPIX"])], axes[0] * axes[1], at).reshape(axes[1], axes[0])
    return cards, _values(cards, raw)


def parse_planes(content: bytes) -> tuple[dict[str, str], np.ndarray]:
    """Header cards and all planes (one for a flat image) of the first image HDU, as float32."""
    cards, at, axes = _image_hdu(lambda i, n: content[i : i + n])
    planes = axes[2] if len(axes) > 2 else 1
    raw = np.frombuffer(content, _KINDS[int(cards["BITPIX"])], axes[0] * axes[1] * planes, at).reshape(planes, axes[1], axes[0])
    return cards, _values(cards, raw)


def _take(stream) -> Callable[[int, int], bytes]:
    def take(at: int, n: int) -> bytes:
        stream.seek(at)
        return stream.read(n)

    return take


def read_region(path: str, x0: int, y0: int, w: int, h: int) -> np.ndarray:
    """A part of a local image file: only the header and the rows of the region are read, cut to the image."""
    with open(path, "rb") as f:
        take = _take(f)
        cards, at, axes = _image_hdu(take)
        kind = np.dtype(_KINDS[int(cards["BITPIX"])])
        left, right, top, bottom = max(x0, 0), min(x0 + w, axes[0]), max(y0, 0), min(y0 + h, axes[1])
        if left >= right or top >= bottom:
            return np.zeros((0, 0), np.float32)
        raw = take(at + top * axes[0] * kind.itemsize, (bottom - top) * axes[0] * kind.itemsize)
        return _values(cards, np.frombuffer(raw, kind).reshape(bottom - top, axes[0])[:, left:right])


def read_headers(spark: SparkSession, folder: str, n: int = 64 * 2880) -> DataFrame:
    """path, cards, width, height and axes of every image of a folder; of each file's content only the first
    ``n`` bytes, where headers are, go to Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            out = []
            for path, content in zip(files["path"], files["content"], strict=True):
                cards, _, axes = _image_hdu(lambda i, k, c=content: c[i : i + k])
                out.append((path, cards, axes[0], axes[1], len(axes)))
            yield pd.DataFrame(out, columns=["path", "cards", "width", "height", "axes"])

    files = spark.read.format("binaryFile").load(folder).where(is_image(F.col("path")))
    head = files.select("path", F.substring("content", 1, n).alias("content"))
    return head.mapInPandas(run, "path string, cards map<string,string>, width int, height int, axes int")


def read_rgb(spark: SparkSession, folder: str) -> DataFrame:
    """px(path, channel, y, x, v) of all planes of all images of a folder: channels r, g, b for cubes of three, l else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, content in zip(files["path"], files["content"], strict=True):
                _, planes = parse_planes(content)
                for name, plane in zip("rgb" if len(planes) >= 3 else "l", planes, strict=False):
                    y, x = np.indices(plane.shape)
                    yield pd.DataFrame({"path": path, "channel": name, "y": y.ravel(), "x": x.ravel(), "v": plane.ravel().astype(np.float64)})

    files = spark.read.format("binaryFile").load(folder).where(is_image(F.col("path")))
    return files.select("path", "content").mapInPandas(run, "path string, channel string, y int, x int, v double")


def fits_bytes(image: np.ndarray, cards: dict[str, object] | None = None) -> bytes:
    """An image of one plane (height, width) or several (planes, height, width) as a FITS file."""
    axes = {f"NAXIS{k + 1}": n for k, n in enumerate(reversed(image.shape))}
    head = {"SIMPLE": "T", "BITPIX": -32, "NAXIS": image.ndim} | axes | (cards or {})
    text = "".join(f"{k:<8}= {(repr(v) if isinstance(v, str) and v not in 'TF' else str(v)):>20}".ljust(80) for k, v in head.items()) + "END".ljust(80)
    data = image.astype(">f4").tobytes()
    return text.ljust(-(-len(text) // 2880) * 2880).encode("ascii") + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def write_fits(path: str, image: np.ndarray, cards: dict[str, object] | None = None, spark: SparkSession | None = None) -> None:
    """Write an image to a local path, or with ``spark`` to any that its file systems know."""
    content = fits_bytes(image, cards)
    if spark is None:
        with open(path, "wb") as f:
            f.write(content)
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def read_fits(spark: SparkSession, folder: str, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """px(path, y, x, v) of all FITS files of a folder; ``region`` (x0, y0, w, h) reads a part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in frames:
            for path, content in zip(files["path"], files["content"], strict=True):
                _, image = parse_fits(content)
                x0, y0, w, h = region or (0, 0, image.shape[1], image.shape[0])
                part = image[max(y0, 0) : y0 + h, max(x0, 0) : x0 + w]
                y, x = np.indices(part.shape)
                yield pd.DataFrame({"path": path, "y": y.ravel() + max(y0, 0), "x": x.ravel() + max(x0, 0), "v": part.ravel().astype(np.float64)})

    files = spark.read.format("binaryFile").load(folder).where(is_image(F.col("path")))
    return files.select("path", "content").mapInPandas(run, "path string, y int, x int, v double")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Run events from JSON lines; blank and malformed lines are left out."""
    schema = "ts string, type string, run_id string, phase_name string, status string, progress double, from_phase string, success boolean, reason string, phase string, _corrupt_record string"
    return spark.read.schema(schema).json(path).where("_corrupt_record is null and type is not null").withColumn("phase_name", F.coalesce("phase_name", "phase")).drop("_corrupt_record", "phase")
