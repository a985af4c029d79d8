"""Closed days of a history in few, sorted files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, SparkSession

from statloom.sources.manifest import (
    CLOSED, DAY, VERSION, Manifest, commit, file_system, live_files, load, loose_files, names_in, resolved, version_folder)

FILE_BYTES = 128 << 20
ROW_GROUP_BYTES = 16 << 20
CLUSTER = ("server_name",)
AT_ONCE = 16  # days whose rewriting is under way at a time


def rewritten(
    spark: SparkSession, root: str, manifest: Manifest, day: str, at: str = "collect_date", cluster: Sequence[str] = CLUSTER,
    file_bytes: int = FILE_BYTES, row_group_bytes: int = ROW_GROUP_BYTES, keep: Column | None = None,
    run: Callable[[Callable[[], None]], object] = lambda write: write(),
) -> dict:
    """The manifest entry of a day that is written anew, in one file per ``file_bytes`` of what it has now.

    Rows are dealt out by ranges of the ``cluster`` columns and the time, so a host with most of a day's rows is spread over
    several files, and sorted by them; each file has statistics per row group and Bloom filters of the cluster columns, so
    that looking for one host skips the others. ``keep`` leaves out the rows for which it isn't true. The entry holds once
    ``run`` has called what it is given, which reads and writes; without ``run`` that is done here.
    """
    size = sum(live_files(spark, root, manifest, day).values())
    if day in manifest.days:
        fs, path = file_system(spark, root)
        size += fs.getContentSummary(path(version_folder(root, day, manifest.days[day]["version"]))).getLength()
    files, version = max(1, -(-size // file_bytes)), f"v{uuid.uuid4().hex}"
    entry = {"version": version}

    def write() -> None:
        entry["replaced"] = sorted(loose_files(spark, root, day))
        rows = resolved(spark, root, manifest, [day]).drop(DAY)
        if keep is not None:
            rows = rows.filter(keep)
        known = [c for c in cluster if c in rows.columns]
        keys = [*known, *([at] if at in rows.columns else [])]
        dealt = rows.repartitionByRange(files, *keys) if keys and files > 1 else rows.repartition(files)
        writer = (dealt.sortWithinPartitions(*keys) if keys else dealt).write.option("parquet.block.size", row_group_bytes)
        for column in known:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(version_folder(root, day, version))

    run(write)
    return entry


def _sweep(spark: SparkSession, root: str, manifest: Manifest) -> None:
    """Delete what no reader of ``manifest`` sees: replaced files, former versions, and those of runs that stopped."""
    fs, path = file_system(spark, root)
    for day, entry in manifest.days.items():
        for name in set(entry["replaced"]) & set(loose_files(spark, root, day)):
            fs.delete(path(f"{root}/{DAY}={day}/{name}"), False)
    for folder in names_in(spark, f"{root}/{CLOSED}"):
        day = folder.removeprefix(f"{DAY}=")
        for name in names_in(spark, f"{root}/{CLOSED}/{folder}"):
            if name != f"{VERSION}={manifest.days.get(day, {}).get('version')}":
                fs.delete(path(f"{root}/{CLOSED}/{folder}/{name}"), True)


def compact_history(
    spark: SparkSession, path: str, before: str, at: str = "collect_date", cluster: Sequence[str] = CLUSTER,
    file_bytes: int = FILE_BYTES, row_group_bytes: int = ROW_GROUP_BYTES, at_once: int = AT_ONCE,
) -> list[str]:
    """Rewrite the days before the day ``before`` that have loose files, each on its own; returns them.

    Most days make one file, which one task writes; so ``at_once`` days are rewritten side by side, as jobs of their own, and
    committed in their order. A day has then at most one file per ``file_bytes`` of its former size. A single loose file is left as it is until others
    stand beside it. A run may stop after any step: a day counts as rewritten from the commit of its manifest on, and the
    next run deletes whatever that leaves over. Replaced files also stay until the next run, so that readers which
    resolved the history before can finish. Late rows of a closed day are added as usual and go into its next version. One
    run at a time may change a history; readers must use ``read_history`` from the first run on.
    """
    root = path.rstrip("/")
    manifest = load(spark, root)
    _sweep(spark, root, manifest)
    due = []
    for folder in sorted(names_in(spark, root)):
        day = folder.removeprefix(f"{DAY}=")
        if day == folder or not day[:1].isdigit() or day >= before:
            continue
        live = live_files(spark, root, manifest, day)
        if live and (len(live) > 1 or day in manifest.days):
            due.append(day)

    pool = ThreadPoolExecutor(max(1, at_once))
    try:
        entries, under_way = {}, []
        for day in due:
            entries[day] = rewritten(spark, root, manifest, day, at, cluster, file_bytes, row_group_bytes,
                                     run=lambda write: under_way.append(pool.submit(inheritable_thread_target(spark)(write))))
        for (day, entry), job in zip(entries.items(), under_way):
            job.result()
            manifest = commit(spark, root, manifest, {**manifest.days, day: entry})
    finally:
        pool.shutdown(cancel_futures=True)  # waits for the jobs that run, so none goes on after a failure
    return due


def history_files(spark: SparkSession, path: str) -> dict[str, int]:
    """The number of files that a reader of each day opens."""
    root = path.rstrip("/")
    manifest = load(spark, root)
    days = {name.removeprefix(f"{DAY}=") for name in names_in(spark, root) if name.startswith(f"{DAY}=")} | set(manifest.days)
    found = {}
    for day in sorted(days):
        inner = names_in(spark, version_folder(root, day, manifest.days[day]["version"])) if day in manifest.days else []
        found[day] = len(live_files(spark, root, manifest, day)) + sum(not n.startswith(("_", ".")) for n in inner)
    return {day: n for day, n in found.items() if n}
