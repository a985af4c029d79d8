"""The stateful step of snapshot pairing. It is sent to the workers by value, so it imports nothing of this package."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PAIRED, FIRST, LATE = "paired", "first", "late"
PREFIX = "prev_"
BUCKET = "bucket"
KEY = "lookback_key"
BETWEEN, NONE = "\x1f", "\x00"  # what separates packed values, and stands for a NULL


def _remembered(row: Sequence) -> tuple:
    return (int(row[0]), *[None if pd.isna(v) else v for v in row[1:]])


class LookBack(StatefulProcessor):
    """Emits every row of a bucket of keys with its status and, if ``paired``, the counters of the preceding snapshot.

    The state maps a key of the bucket to the last row seen of it: number and counters. A call handles all rows of the
    bucket at once and reads and writes the keys of those rows alone, one access each, whatever else the bucket
    remembers. With ``forget_ms`` a key that gets no row for so long leaves the state. Keys and counters travel as text,
    so that 64-bit values and NULLs pass through pandas unchanged. Spark hands rows over one by one, at a cost per column:
    with ``packed``, that column has all counters (and whatever follows them) in one text, and so has the previous one. The
    state is the same either way.
    """

    def __init__(self, counters: Sequence[str], forget_ms: int | None = None, packed: str | None = None):
        self.counters = list(counters)
        self.forget_ms = forget_ms
        self.packed = packed
        self.carried = [packed] if packed else self.counters

    def _known(self, row: Sequence) -> tuple:
        """A remembered row as rows come."""
        return (row[0], BETWEEN.join(NONE if v is None else v for v in row[1:])) if self.packed else tuple(row)

    def _to_remember(self, row: Sequence) -> tuple:
        if not self.packed:
            return _remembered(row)
        return (int(row[0]), *[None if v == NONE else v for v in row[1].split(BETWEEN)[:len(self.counters)]])

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(["snapshot_no bigint", *[f"{c} string" for c in self.counters]])
        options = {} if self.forget_ms is None else {"ttlDurationMs": self.forget_ms}
        self.last = handle.getMapState("last", f"{KEY} string", fields, **options)

    def handleInitialState(self, key, rows: pd.DataFrame, timer_values) -> None:
        """Takes over what another run remembered, for ``pair_stream(known=)``."""
        for row in rows[[KEY, "snapshot_no", *self.counters]].itertuples(index=False):
            self.last.updateValue((row[0],), _remembered(row[1:]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        columns = [KEY, "snapshot_no", *self.carried]
        batch = pd.concat(list(rows), ignore_index=True).assign(_known=False)
        held = [(k, self.last.getValue((k,))) for k in batch[KEY].unique()]
        known = pd.DataFrame.from_records([(k, *self._known(row)) for k, row in held if row is not None], columns=columns)
        both = pd.concat([known.assign(_known=True), batch], ignore_index=True) if len(known) else batch
        both = both.sort_values([KEY, "snapshot_no", "_known"], ascending=True, kind="stable")

        # Known rows carry the highest number seen of their key; what is not above it, or repeats a number, is late.
        last_no = both["snapshot_no"].where(both["_known"]).groupby(both[KEY]).transform("max")
        late = ~both["_known"] & ((both["snapshot_no"] <= last_no) | both.duplicated([KEY, "snapshot_no"]))
        fresh = both[~late]
        before = fresh.groupby(KEY, sort=False)[["snapshot_no", *self.carried]].shift(1)
        paired = before["snapshot_no"] == fresh["snapshot_no"] - 1

        out = both.assign(status=LATE, **{PREFIX + c: None for c in self.carried})
        out.loc[fresh.index, "status"] = paired.map({True: PAIRED, False: FIRST})
        for counter in self.carried:
            values = before[counter].astype(object)
            out.loc[fresh.index, PREFIX + counter] = values.where(paired & values.notna(), None)
        newest = fresh.groupby(KEY, sort=False).tail(1)
        for row in newest.loc[~newest["_known"], columns].itertuples(index=False):
            self.last.updateValue((row[0],), self._to_remember(row[1:]))
        yield out[~out["_known"]].drop(columns=["_known"] if self.packed else ["_known", KEY])

    def close(self) -> None:
        pass


# Workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
