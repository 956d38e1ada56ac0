"""Parquet tables by day whose days can be written by several jobs, rewritten and merged while others read.

A table has one folder per day and batch. Batches are only ever added. Which of a day's folders count is told by a small
state file: a rewritten day names the one folder that holds it and the batches that this folder covers; those are hidden from
then on, and so is a rewriting that isn't committed. A new state is a new file with the next number, created
exclusively, so all days of one rewriting change at once and of two writers one sees the conflict.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import defaultdict
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.schema import DAY

#: The batch that wrote a row.
BATCH = "ingest"
_REWRITTEN = "day-"
_NAME = re.compile(r"(?!day-)[A-Za-z0-9_.\-]+")
_LOG = "_days"

#: Tasks that write one day of a rewritten table.
TASKS_PER_DAY = 8


class DayConflict(RuntimeError):
    """Another job rewrote one of the same days meanwhile. Nothing was changed; the call can be repeated."""


class DayTable:
    """The table under ``path``. Only names of folders and the state file are read on the driver, never rows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _listed(self, pattern: str) -> list[str]:
        escaped = re.sub(r"([\\*?\[\]{}])", r"\\\1", self.path)
        found = self._files.globStatus(self._jvm.org.apache.hadoop.fs.Path(f"{escaped}/{pattern}"))
        return [status.getPath().toString() for status in found or ()]

    def _state(self) -> tuple[int, dict[str, dict]]:
        """Number and content of the newest complete state: per rewritten day its folder (``shown``) and the batches it covers."""
        for number in sorted((int(name[-17:-5]) for name in self._listed(f"{_LOG}/*.json")), reverse=True):
            stream = self._files.open(self._at(f"{_LOG}/{number:012d}.json"))
            try:
                return number, json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except json.JSONDecodeError:
                continue  # Being written: not committed yet.
            finally:
                stream.close()
        return 0, {}

    def _commit(self, before: dict[str, dict], change: dict[str, dict]) -> None:
        """Makes ``change`` the state of its days, if they are still as in ``before``."""
        while True:
            number, now = self._state()
            if any(now.get(day) != before.get(day) for day in change):
                raise DayConflict(f"{self.path}: {', '.join(sorted(change))}")
            try:
                stream = self._files.create(self._at(f"{_LOG}/{number + 1:012d}.json"), False)
            except Py4JJavaError as error:
                if "AlreadyExists" not in str(error.java_exception):
                    raise
                continue
            stream.write(bytearray(json.dumps(now | change, sort_keys=True).encode()))
            stream.close()
            return

    def _folders(self) -> dict[str, set[str]]:
        days: dict[str, set[str]] = defaultdict(set)
        for name in self._listed(f"{DAY}=*/{BATCH}=*"):
            day, batch = (part.partition("=")[2] for part in name.split("/")[-2:])
            days[day].add(batch)
        return days

    @staticmethod
    def _shown(folders: set[str], state: dict) -> set[str]:
        plain = {b for b in folders if not b.startswith(_REWRITTEN)} - set(state.get("covers", ()))
        return plain | ({state["shown"]} & folders if state.get("shown") else set())

    def visible(self) -> dict[str, set[str]]:
        """The folders that count, by day."""
        # The state first: a folder it names exists, and a batch that comes meanwhile is not covered.
        _, state = self._state()
        return {day: shown for day, batches in self._folders().items() if (shown := self._shown(batches, state.get(day, {})))}

    def batches(self) -> dict[str, set[str]]:
        """The batches whose rows each day holds, also those since merged. Merging a day does not change them."""
        _, state = self._state()
        held = {}
        for day, folders in self._folders().items():
            known = state.get(day, {})
            held[day] = {b for b in folders if not b.startswith(_REWRITTEN)} | set(known.get("covers", ()))
        return held

    def sources(self) -> dict[str, list[str]]:
        """What each rewritten day was made from, as ``replace`` was told."""
        return {day: known["sources"] for day, known in self._state()[1].items() if "sources" in known}

    def covered_days(self, batch: str) -> list[str]:
        """Days in which ``batch`` was merged with others."""
        return sorted(day for day, known in self._state()[1].items() if batch in known["covers"])

    def append(self, rows: DataFrame, batch: str | None = None, again: str = "refuse") -> None:
        """Adds ``rows`` (with their day) as a batch. A name used before takes the place of what was written under it.

        Once a day is merged, its batches are final. ``again="skip"`` leaves such days out, which is right for a job that is repeated with
        the rows it had before; ``again="refuse"`` raises an error.
        """
        name = batch or f"batch-{uuid.uuid4().hex}"
        if not _NAME.fullmatch(name):
            raise ValueError(f"not a batch name: {name!r}")
        final = self.covered_days(name) if batch else []
        if final and again != "skip":
            raise ValueError(f"batch {name} is final, its days were merged: {', '.join(final)}")
        if final:
            rows = rows.filter(~F.col(DAY).cast("string").isin(final))
        writer = rows.withColumn(BATCH, F.lit(name)).write.partitionBy(DAY, BATCH)
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def read(self, schema: T.StructType | None = None, days: Iterable[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
        """The rows of all days, of ``days``, or from ``first`` to ``last``. Only the folders that count are listed and read."""
        chosen = None if days is None else set(days)
        found = self.visible()
        wanted = [
            f"{self.path}/{DAY}={day}/{BATCH}={batch}"
            for day in sorted(found)
            if (chosen is None or day in chosen) and (first is None or day >= first) and (last is None or day <= last)
            for batch in sorted(found[day])
        ]
        if not wanted:
            # Hidden folders have the table's layout, too; without any there is no table, and Spark says so.
            return self.spark.createDataFrame([], schema or self.spark.read.parquet(self.path).schema)
        reader = self.spark.read.option("basePath", self.path)
        if schema is not None:
            layout = T.StructType([f for f in schema if f.name not in (DAY, BATCH)]).add(DAY, T.DateType()).add(BATCH, T.StringType())
            return reader.schema(layout).parquet(*wanted).select(*schema.names)
        return reader.parquet(*wanted)

    def replace(
        self, rows: DataFrame, days: Iterable[str], by: str | None = None, sources: dict[str, list[str]] | None = None
    ) -> None:
        """``rows`` become the content of ``days``, at once; a day without rows becomes empty. ``by``: a column to deal a day's rows by.

        ``sources`` is kept with each day and tells later what it was made from. Raises ``DayConflict`` if one of the days was rewritten meanwhile. Batches that arrive meanwhile stay.
        """
        _, before = self._state()
        folders = self._folders()
        read = {day: self._shown(folders.get(day, set()), before.get(day, {})) for day in days}
        self._rewrite(rows, read, before, by, sources or {})

    def _rewrite(
        self, rows: DataFrame, read: dict[str, set[str]], before: dict[str, dict], by: str | None, sources: dict[str, list[str]]
    ) -> None:
        if not read:
            return
        made = f"{_REWRITTEN}{uuid.uuid4().hex}"
        part = F.pmod(F.hash(by), F.lit(TASKS_PER_DAY)) if by else F.lit(0)
        dealt = rows.filter(F.col(DAY).cast("string").isin(sorted(read))).repartition(DAY, part)
        dealt.withColumn(BATCH, F.lit(made)).write.partitionBy(DAY, BATCH).mode("append").parquet(self.path)
        written = {day for day, batches in self._folders().items() if made in batches}
        change = {}
        for day, shown in read.items():
            covers = set(before.get(day, {}).get("covers", ())) | {b for b in shown if not b.startswith(_REWRITTEN)}
            change[day] = {"shown": made if day in written else None, "covers": sorted(covers)}
            known = sources.get(day, before.get(day, {}).get("sources"))
            change[day] |= {} if known is None else {"sources": known}
        self._commit(before, change)

    def merge(self, first: str | None = None, last: str | None = None, by: str | None = None) -> list[str]:
        """Rewrites each day from ``first`` to ``last`` that has several folders into one, in one job; returns these days.

        Readers see a day before or after, never both. Other writers may go on: what they add meanwhile isn't covered and stays.
        """
        _, before = self._state()
        folders = self._folders()
        read = {}
        for day in sorted(folders):
            shown = self._shown(folders[day], before.get(day, {}))
            if len(shown) > 1 and (first is None or day >= first) and (last is None or day <= last):
                read[day] = shown
        if read:
            paths = [f"{self.path}/{DAY}={day}/{BATCH}={batch}" for day in read for batch in sorted(read[day])]
            rows = self.spark.read.option("basePath", self.path).parquet(*paths).drop(BATCH)
            self._rewrite(rows, read, before, by, {})
        return sorted(read)

    def clean(self) -> int:
        """Deletes folders that no longer count; for a time when no reader still uses them and no rewriting runs. Returns how many."""
        _, state = self._state()
        gone = [
            (day, batch)
            for day, batches in self._folders().items()
            for batch in batches - self._shown(batches, state.get(day, {}))
        ]
        for day, batch in gone:
            self._files.delete(self._at(f"{DAY}={day}/{BATCH}={batch}"), True)
        return len(gone)
