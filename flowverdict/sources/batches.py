"""Stored tables that grow by batches: a log names what is there, readers merge it.

A batch of rows is written beside the table and then named in a log; readers merge the logged
batches over the base table, so the history is neither rewritten by a batch nor shuffled by a
reader. Compaction writes a new base and names it in the log; what no reader can need any more
is deleted. Files of the log are only ever created, each by one writer, so writers and readers
need no lock. The folder must be on storage where renaming to a name that is there already fails
(as on HDFS).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_LOG = "number long, kind string, origin string, batch long, base string, covers string"


@dataclass
class _State:
    base: str | None = None
    before: str | None = None  # the base before
    covered: set = field(default_factory=set)  # batches of the log that are in the base
    done: dict = field(default_factory=dict)  # (origin, batch) -> number
    claimed: dict = field(default_factory=dict)
    last: dict = field(default_factory=dict)  # origin -> highest batch of the base
    next: int = 0
    version: int = -1  # of the base


class BatchStore:
    """Rows below ``path`` that come in numbered batches and are merged when they are read.

    A kind of store says what a batch stores (``prepared``) and how stored rows merge
    (``merged``); ``schema`` is that of its stored rows.
    """

    schema: T.StructType

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def prepared(self, rows: DataFrame, number: int) -> DataFrame:
        """What batch ``number`` stores of ``rows``."""
        raise NotImplementedError

    def merged(self, base: DataFrame | None, changed: DataFrame) -> DataFrame:
        """One state of the rows of ``base`` and of the batches ``changed``; both have the number
        ``_batch`` of the batch that a row is from, and so has the result."""
        raise NotImplementedError

    # --- the log ---------------------------------------------------------------------

    def _files(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _create(self, name: str, record: dict) -> bool:
        """Writes a file of the log; False if another writer has made it."""
        files, place = self._files(f"{self.path}/log/{name}.json")
        text = bytearray((json.dumps(record) + "\n").encode())
        _, hidden = self._files(f"{self.path}/log/_{uuid.uuid4().hex}")
        out = files.create(hidden, False)
        out.write(text)
        out.close()
        made = not files.exists(place) and files.rename(hidden, place)
        if not made:
            files.delete(hidden, False)
        return made

    def _delete(self, path: str) -> None:
        files, place = self._files(path)
        files.delete(place, True)

    def _state(self) -> _State:
        files, place = self._files(f"{self.path}/log")
        if not files.exists(place):
            return _State()
        rows = self.spark.read.schema(_LOG).json(f"{self.path}/log").collect()
        state = _State()
        bases = sorted((r for r in rows if r["kind"] == "base"), key=lambda r: r["number"])
        if bases:
            held = json.loads(bases[-1]["covers"])
            state.base, state.version = bases[-1]["base"], bases[-1]["number"]
            state.before, state.covered = held["before"], set(held["batches"])
            state.last, state.next = held["last"], held["next"]
        for r in rows:
            if r["kind"] == "base":
                continue
            key = (r["origin"], r["batch"])
            (state.done if r["kind"] == "done" else state.claimed)[key] = r["number"]
            state.next = max(state.next, r["number"] + 1)
        return state

    def _known(self, state: _State, origin: str, batch: int) -> bool:
        return (origin, batch) in state.done or batch <= state.last.get(origin, -1)

    # --- writing and reading ---------------------------------------------------------

    def append(self, rows: DataFrame, origin: str, batch: int = 0) -> bool:
        """Adds the rows of batch ``batch`` of a stream or task; False if they are there already.

        The batches of an origin must come in order; a batch that comes again, after a failure
        or a compaction, changes nothing.
        """
        while True:
            state = self._state()
            if self._known(state, origin, batch):
                return False
            number = state.claimed.get((origin, batch), state.next)
            record = {"number": number, "origin": origin, "batch": batch}
            if (origin, batch) in state.claimed or self._create(
                    f"{number:012d}-claim", record | {"kind": "claim"}):
                break
        self.prepared(rows, number).write.mode("overwrite").parquet(self._delta(number))
        self._create(f"{number:012d}-done", record | {"kind": "done"})
        return True

    def _delta(self, number: int) -> str:
        return f"{self.path}/verdicts/batch_id={number}"

    def _rows(self, path: str, number: int | None = None) -> DataFrame:
        """The rows of a base, or of a batch, with the batch they are from."""
        batch = T.StructField("_batch", T.LongType())
        if number is None:
            return self.spark.read.schema(T.StructType([*self.schema.fields, batch])).parquet(path)
        return self.spark.read.schema(self.schema).parquet(path).withColumn("_batch", F.lit(number).cast("long"))

    def _merged(self, state: _State) -> DataFrame:
        deltas = [n for n in sorted(state.done.values()) if n not in state.covered]
        base = self._rows(state.base) if state.base else None
        if not deltas:
            return base if base is not None else self.spark.createDataFrame([], self.schema).withColumn(
                "_batch", F.lit(0).cast("long"))
        changed = None
        for n in deltas:
            part = self._rows(self._delta(n), n)
            changed = part if changed is None else changed.unionByName(part)
        return self.merged(base, changed)

    def read(self) -> DataFrame:
        """All rows, merged."""
        return self._merged(self._state()).drop("_batch")

    def compact(self, keep: Column | None = None) -> bool:
        """Writes all rows, or those that ``keep`` is true for, as a new base; what the base before the last one needed is freed.

        Batches may be written meanwhile. False if there is nothing new, or if another writer
        has compacted at the same time.
        """
        state = self._state()
        new = set(state.done.values()) - state.covered
        if not new:
            return False
        base = f"{self.path}/base/{uuid.uuid4().hex}"
        rows = self._merged(state)
        (rows if keep is None else rows.where(keep)).write.parquet(base)
        last = dict(state.last)
        for origin, batch in state.done:
            last[origin] = max(last.get(origin, -1), batch)
        covers = {"batches": sorted(state.done.values()), "last": last, "next": state.next,
                  "before": state.base}
        number = state.version + 1
        if not self._create(f"base-{number:012d}", {
                "number": number, "kind": "base", "base": base, "covers": json.dumps(covers)}):
            self._delete(base)
            return False
        for n in state.covered:  # the last base holds them, and the one before is not read any more
            for kind in ("done", "claim"):
                self._delete(f"{self.path}/log/{n:012d}-{kind}.json")
            self._delete(self._delta(n))
        if state.before:
            self._delete(state.before)
        if number > 1:
            self._delete(f"{self.path}/log/base-{number - 2:012d}.json")
        return True
