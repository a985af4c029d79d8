"""Which files make up the closed days of a history.

A closed day is rewritten into ``_closed/dt=…/version=…`` of its history. The manifest, one small JSON file per commit in
``_manifest``, names for every such day its version and the files that it replaces; a reader takes the newest manifest, so
it sees a day either before or after it was rewritten. Files that come later stand beside the version: those of a batch
that is run again replace the batch's rows in it. A history without a manifest is read as plain folders.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "dt"
BATCH = "batch_id"
CLOSED, MANIFESTS, VERSION = "_closed", "_manifest", "version"
KEPT_MANIFESTS = 5  # for readers that have just looked up the newest
_NAME = re.compile(r"(\d{10})\.json")
_BATCH_FOLDER = re.compile(rf"{BATCH}=(\d+)/")


@dataclass(frozen=True)
class Manifest:
    """``days``: per day (as text) its ``version`` and the ``replaced`` files, by their paths below the day's folder."""

    number: int = 0
    days: dict[str, dict] = field(default_factory=dict)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and the class of its paths."""
    path_class = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path_class(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path_class


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, at = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at(path))] if fs.exists(at(path)) else []


def load(spark: SparkSession, root: str) -> Manifest:
    """The newest manifest of the history at ``root``; an empty one if it has none."""
    numbers = [int(m[1]) for m in map(_NAME.fullmatch, names_in(spark, f"{root}/{MANIFESTS}")) if m]
    if not numbers:
        return Manifest()
    text = spark.read.text(f"{root}/{MANIFESTS}/{max(numbers):010d}.json", wholetext=True).first()[0]
    return Manifest(max(numbers), json.loads(text))


def commit(spark: SparkSession, root: str, previous: Manifest, days: dict[str, dict]) -> Manifest:
    """Make ``days`` the content of the history, in one rename; one run at a time may change a history."""
    fs, at = file_system(spark, root)
    folder, number = f"{root}/{MANIFESTS}", previous.number + 1
    fs.mkdirs(at(folder))
    draft, final = at(f"{folder}/.draft-{uuid.uuid4().hex}"), at(f"{folder}/{number:010d}.json")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(days, sort_keys=True).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"another run has changed the history at {root}; run again")
    for name in names_in(spark, folder):
        if (found := _NAME.fullmatch(name)) and int(found[1]) <= number - KEPT_MANIFESTS:
            fs.delete(at(f"{folder}/{name}"), False)
    return Manifest(number, days)


def loose_files(spark: SparkSession, root: str, day: str) -> dict[str, int]:
    """Files in the folder of a day, by their paths below it, and their sizes."""
    fs, at = file_system(spark, root)
    folder = at(f"{root}/{DAY}={day}")
    if not fs.exists(folder):
        return {}
    base, found = fs.makeQualified(folder).toString() + "/", {}
    files = fs.listFiles(folder, True)
    while files.hasNext():
        status = files.next()
        if not status.getPath().getName().startswith(("_", ".")):
            found[status.getPath().toString().removeprefix(base)] = status.getLen()
    return found


def live_files(spark: SparkSession, root: str, manifest: Manifest, day: str) -> dict[str, int]:
    """The loose files of a day that readers see."""
    gone = set(manifest.days.get(day, {}).get("replaced", ()))
    return {name: size for name, size in loose_files(spark, root, day).items() if name not in gone}


def version_folder(root: str, day: str, version: str) -> str:
    return f"{root}/{CLOSED}/{DAY}={day}/{VERSION}={version}"


def resolved(spark: SparkSession, root: str, manifest: Manifest, only: Iterable[str] | None = None) -> DataFrame:
    """The rows of a history under ``manifest``; with ``only`` just those days, which must have rows."""
    wanted = None if only is None else set(only)
    loose, closed, again = [], [], []
    for name in names_in(spark, root):
        day = name.removeprefix(f"{DAY}=")
        if day == name or (wanted is not None and day not in wanted):
            continue
        if day not in manifest.days:
            loose.append(f"{root}/{name}")
            continue
        live = live_files(spark, root, manifest, day)
        loose += [f"{root}/{name}/{file}" for file in live]
        if batches := {int(m[1]) for m in map(_BATCH_FOLDER.match, live) if m}:
            again.append((F.col(DAY) == F.lit(day).cast("date")) & F.col(BATCH).isin(*batches))
    for day, entry in manifest.days.items():
        if wanted is None or day in wanted:
            closed.append(version_folder(root, day, entry["version"]))
    parts = []
    if loose:
        parts.append(spark.read.option("basePath", root).parquet(*loose))
    if closed:
        rows = spark.read.option("basePath", f"{root}/{CLOSED}").parquet(*closed).drop(VERSION)
        for condition in again:
            rows = rows.filter(~F.coalesce(condition, F.lit(False)))
        parts.append(rows)
    dated = [df.withColumn(DAY, F.col(DAY).cast("date")) for df in parts]  # folders without a time only give text
    return dated[0] if len(dated) == 1 else dated[0].unionByName(dated[1].select(dated[0].columns))
