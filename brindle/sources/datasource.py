"""Spark data source "journal": one partition for each SLOTS entries of a file in batch, and for each file with new entries in streams.

Options: path (comma-separated roots), mode (FAILFAST, or PERMISSIVE: a file's error ends that file and is logged),
branches (JSON list of lists of FIELD=value in hex: entries that hold all of one list are looked up in each file's hash
table; Spark evaluates the filter again), decode_fields (false: empty fields), slots (JSON of {file id in hex: [first, end]}:
only those slots of these files are read), limits (JSON of Limits), startingOffsets
(latest, earliest, or JSON of {file id in hex: slots}), maxEntriesPerBatch and fresh (true: nothing is checkpointed yet)
in streams. The folders must be visible to
driver and executors under the same path.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterable, Iterator
from dataclasses import asdict
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from brindle.plans.model import ENTRY, JournalError, Limits, Transient
from brindle.sources.discovery import list_files, usable
from brindle.sources.format import Header, JournalFile

log = logging.getLogger(__name__)

#: Rows of a batch.
ROWS = 2048
#: Slots of a task that scans a file.
SLOTS = 1 << 18
_FIELD = pa.struct([pa.field("name", pa.string(), False), pa.field("value", pa.binary(), False)])
_LISTS = pa.list_(pa.field("element", _FIELD, False))
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.string()]
_SCHEMA = pa.schema([*(pa.field(f.name, k, f.nullable) for f, k in zip(ENTRY, _KINDS)), pa.field("fields", _LISTS, False)])


def options_of(limits: Limits) -> dict[str, str]:
    """The options that carry limits to the tasks."""
    return {"limits": json.dumps(asdict(limits))}


def _limits(options: dict) -> Limits:
    return Limits(**json.loads(options["limits"])) if options.get("limits") else Limits()


def _roots(options: dict) -> list[str]:
    return [p for p in str(options.get("path", "")).split(",") if p]


def _files(options: dict, limits: Limits) -> list[tuple[str, Header]]:
    return usable(list_files(_roots(options), limits), limits)


def batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of JournalFile.entries() as Arrow batches of ENTRY."""
    rows = iter(rows)
    while some := list(islice(rows, ROWS)):
        *keys, fields = zip(*some)
        offsets = [0]
        for f in fields:
            offsets.append(offsets[-1] + len(f))
        flat = list(chain.from_iterable(fields))
        items = pa.StructArray.from_arrays([pa.array([n for n, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.binary())], fields=list(_FIELD))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, type=_LISTS)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(keys, _KINDS)), lists], schema=_SCHEMA)


class FilePart(InputPartition):
    def __init__(self, path: str, start: int = 0, end: int | None = None) -> None:
        super().__init__(path)
        self.path, self.start, self.end = path, start, end


class BatchReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.limits = options, _limits(options)
        self.since: int | None = None
        self.until: int | None = None

    def pushFilters(self, filters) -> Iterator:  # noqa: N802
        """Bounds on realtime_usec prune files and entries; every filter is left to Spark as well."""
        for f in filters:
            if getattr(f, "attribute", None) == ("realtime_usec",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    v = f.value + isinstance(f, GreaterThan)
                    self.since = v if self.since is None else max(self.since, v)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    v = f.value - isinstance(f, LessThan)
                    self.until = v if self.until is None else min(self.until, v)
            yield f

    def partitions(self) -> list[FilePart]:
        """Files whose times may meet the bounds. A file without times in its header has those of its ends."""
        out = []
        for path, header in _files(self.options, self.limits):
            lo, hi = header.head_realtime, header.tail_realtime
            if (self.since is not None or self.until is not None) and lo is None:
                try:
                    with JournalFile(path, self.limits) as f:
                        if r := f.range():
                            lo, hi = r[0].realtime_usec, r[1].realtime_usec
                except JournalError:
                    pass
            if lo is not None and hi is not None and (self.since is not None and hi < self.since or self.until is not None and lo > self.until):
                continue
            out += self._parts(path, header)
        return out

    def _parts(self, path: str, header: Header) -> list[FilePart]:
        """Ranges of slots, scanned by tasks of their own. A file whose error is to end it, one that is looked up in its
        index, and one that can't hold as many entries as it says is one part."""
        first, n = 0, header.n_entries
        if self.options.get("slots"):
            first, end = json.loads(self.options["slots"]).get(header.file_id.hex(), (0, 0))
            if first >= end:
                return []
            if self._permissive():
                return [FilePart(path, first, end)]
            return [FilePart(path, i, min(i + SLOTS, end)) for i in range(first, end, SLOTS)]
        if self._permissive() or self._wanted() or n * 64 > header.arena_size:
            return [FilePart(path)]
        return [FilePart(path, i, i + SLOTS if i + SLOTS < n else None) for i in range(0, max(1, n), SLOTS)]

    def _permissive(self) -> bool:
        return str(self.options.get("mode", "FAILFAST")).upper() == "PERMISSIVE"

    def _wanted(self) -> list[list[bytes]]:
        return [[bytes.fromhex(x) for x in b] for b in json.loads(self.options.get("branches") or "[]")]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        wanted = self._wanted()
        decode = str(self.options.get("decode_fields", "true")).lower() != "false"
        try:
            with JournalFile(partition.path, self.limits) as f:
                only = f.branches(wanted) if wanted else None
                yield from batches(f.entries(self.since, self.until, only, partition.start, partition.end, decode))
        except JournalError as e:
            if not self._permissive():
                raise
            log.warning("%s: %s", partition.path, e)


class TailReader(DataSourceStreamReader):
    """Offset: {file id: slots consumed}. A batch holds at most maxEntriesPerBatch new slots, one task a file.

    The driver reads headers only. Spark asks for the end of a query's first batch without saying what a checkpoint holds,
    so that batch is bounded only if the query is said to be fresh. A file that has become shorter goes on from its new end.
    """

    def __init__(self, options: dict) -> None:
        self.options, self.limits = options, _limits(options)
        self.most = int(options.get("maxentriesperbatch", options.get("maxEntriesPerBatch", self.limits.max_live_batch_entries)))
        self.planned: dict[str, int] | None = None

    def _counts(self) -> dict[str, tuple[str, int]]:
        try:
            return {h.file_id.hex(): (p, h.n_entries) for p, h in _files(self.options, self.limits)}
        except JournalError as e:
            log.warning("tail: %s", e)
            return {}

    def initialOffset(self) -> dict:  # noqa: N802
        start = str(self.options.get("startingoffsets", self.options.get("startingOffsets", "latest")))
        if start.startswith("{"):
            self.planned = json.loads(start)
        else:
            self.planned = {} if start.lower() == "earliest" else {i: n for i, (_, n) in self._counts().items()}
        return self.planned

    def latestOffset(self) -> dict:  # noqa: N802
        counts = self._counts()
        if self.planned is None and str(self.options.get("fresh", "false")).lower() == "true":
            self.initialOffset()  # Spark asks for the end of the first batch before its start
        end, room = dict(self.planned or {}), self.most if self.planned is not None else None
        for i, (_, n) in counts.items():
            have = int(end.get(i, 0))
            more = n - have if room is None else min(n - have, room)
            if more != 0:
                end[i] = have + more
            if room is not None and more > 0:
                room -= more
        return end

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        self.planned = dict(end)
        paths = self._counts()
        return [FilePart(paths[i][0], int(start.get(i, 0)), int(n)) for i, n in sorted(end.items()) if int(n) > int(start.get(i, 0)) and i in paths]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        """A file that is being written is tried again; what stays broken is logged and passed over."""
        done = 0
        for attempt in range(5):
            try:
                with JournalFile(partition.path, self.limits) as f:
                    for b in batches(islice(f.entries(skip=partition.start, stop=partition.end), done, None)):
                        yield b
                        done += b.num_rows
                return
            except Transient:
                time.sleep(0.1 * (attempt + 1))
            except JournalError as e:
                if not self._permissive():
                    raise
                log.warning("%s: %s", partition.path, e)
                return
        if not self._permissive():
            raise Transient(f"{partition.path}: still being written")
        log.warning("%s: still being written", partition.path)

    def _permissive(self) -> bool:
        return str(self.options.get("mode", "PERMISSIVE")).upper() == "PERMISSIVE"

    def commit(self, end: dict) -> None:
        pass


class JournalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> StructType:
        return ENTRY

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema: StructType) -> TailReader:  # noqa: N802
        return TailReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JournalSource)
