"""Live tailing: one Structured Streaming query for any number of subscriptions, with replay before live.

A cycle, poll_once(), lets the stream through for one micro-batch of at most max_live_batch_entries entries. It is decoded
once; which subscriptions an entry goes to is one array column, and the rows are put into bounded queues. With the block
policy what a full queue can't take is parked with its subscription, and no further batch is let through until it is gone:
the stream waits, not the caller.

A subscription that starts in the past replays by bounded batch queries what the files held at a snapshot (the last entry
of each file), then, as catch-up, what they held at a later one, until nothing is new; then it goes live. Live entries that
a snapshot covers are skipped, so each entry comes once, whatever its time. One lock spans a cycle and every hand-over.
"""

from __future__ import annotations

import ast
import json
import queue
import tempfile
import threading
import time
import uuid
from collections import deque
from collections.abc import AsyncIterator, Iterator
from itertools import chain, islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from brindle.plans.cursor import Cursor
from brindle.plans.model import KEY, JournalError, Key, LimitExceeded, Limits, Transient, beyond
from brindle.plans.predicates import Filter
from brindle.sources import datasource, discovery
from brindle.sources.format import JournalFile

#: Rows of a partition of a replay, one of which the driver holds at a time.
SORTED = 1 << 16

#: file id in hex -> (slots, offset of the last entry, its key); files without entries have offset 0 and no key.
Snapshot = dict[str, tuple[int, int, Key | None]]


class Closed(JournalError):
    """The subscription has ended and its queue is empty."""


class Subscription:
    def __init__(self, flt: Filter, limits: Limits, after: Key | None, since: int | None, armed: Key | None, replaying: bool) -> None:
        flt.check()
        self.filter, self.limits, self.since = flt, limits, since
        self.last, self.replaying, self.replayed = after, replaying, 0
        self.lower: Snapshot = {}
        self.upper: Snapshot = {}
        self.armed = armed  # live entries up to this key are skipped until one has passed
        self.queue: queue.Queue = queue.Queue(limits.live_channel_capacity)
        self.parked: deque = deque()
        self.rows: Iterator[Row] | None = None  # what is left of a replay's sorted rows
        self.closed = False

    def put(self, item: Row | JournalError) -> bool:
        """Whether the item was delivered, by the policy for a full queue. Never waits."""
        if self.closed:
            return False
        policy = self.limits.queue_full_policy
        if not self.parked:
            try:
                self.queue.put_nowait(item)
                return True
            except queue.Full:
                self.closed = policy == "disconnect"
        if policy == "block":
            self.parked.append(item)
        return False

    def flush(self) -> int:
        """Moves what is parked into the queue as far as there is room. Returns how many."""
        n = 0
        while self.parked and not self.closed and not self.queue.full():
            self.queue.put_nowait(self.parked.popleft())
            n += 1
        if self.closed:
            self.parked.clear()
        return n

    def recv(self, timeout: float | None = None) -> Row:
        """The next entry. queue.Empty after the time-out, Closed at the end; errors are raised in their place."""
        left = timeout
        while True:
            try:
                item = self.queue.get(timeout=0.05 if left is None else max(0.0, min(0.05, left)))
                break
            except queue.Empty:
                if self.closed:
                    raise Closed("closed") from None
                if left is not None:
                    left -= 0.05
                    if left <= 0:
                        raise
        if isinstance(item, JournalError):
            raise item
        return item

    def try_recv(self) -> Row | None:
        try:
            item = self.queue.get_nowait()
        except queue.Empty:
            if self.closed:
                raise Closed("closed") from None
            return None
        if isinstance(item, JournalError):
            raise item
        return item

    async def stream(self) -> AsyncIterator[Row]:
        """The same for asyncio."""
        import asyncio

        while True:
            try:
                yield await asyncio.to_thread(self.recv)
            except Closed:
                return

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> Subscription:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def _offset(snapshot: Snapshot, otherwise: int) -> Column:
    """The last offset that a snapshot has of a row's file."""
    if not snapshot:
        return F.lit(otherwise).cast("bigint")
    ends = F.create_map(*(x for i, (_, at, _) in snapshot.items() for x in (F.lit(i), F.lit(at).cast("bigint"))))
    return F.coalesce(F.try_element_at(ends, F.lower(F.hex("file_id"))), F.lit(otherwise).cast("bigint"))


def _newest(snapshot: Snapshot) -> Key | None:
    return max((k for _, _, k in snapshot.values() if k is not None), default=None)


class LiveJournal:
    def __init__(self, spark: SparkSession, roots: list[str], limits: Limits | None = None, checkpoint: str | None = None, mode: str = "PERMISSIVE") -> None:
        """mode: PERMISSIVE passes over files that are broken; with FAILFAST the first error is raised by poll_once()."""
        from brindle.operators.journal import Journal

        self.limits = (limits or Limits()).check().check_live()
        self.journal = Journal(spark, roots, self.limits)
        self.spark, self.roots, self.mode = spark, [str(r) for r in roots], mode
        datasource.register(spark)
        self.subscriptions: list[Subscription] = []
        self.lock = threading.RLock()
        self.permits, self.ready = threading.Semaphore(0), queue.Queue()
        self.stopped, self.round = False, 0
        # taken before the query starts, which takes a while: what is appended meanwhile is live
        tail = self._snapshot()
        self.newest = _newest(tail)
        self.consumed = {i: n for i, (n, _, _) in tail.items()}
        options = datasource.options_of(self.limits) | {"startingOffsets": json.dumps(self.consumed), "maxEntriesPerBatch": str(self.limits.max_live_batch_entries), "fresh": str(checkpoint is None), "mode": mode}
        stream = spark.readStream.format("journal").options(**options).load(",".join(self.roots))
        self.query = stream.writeStream.foreachBatch(self._dispatch).option("checkpointLocation", checkpoint or self._checkpoint()).start()

    @classmethod
    def open_default(cls, spark: SparkSession, limits: Limits | None = None) -> LiveJournal:
        return cls(spark, discovery.default_roots(), limits)

    @classmethod
    def open_dir(cls, spark: SparkSession, path: str, limits: Limits | None = None, **options: str) -> LiveJournal:
        return cls(spark, [path], limits, **options)

    @classmethod
    def open_dirs(cls, spark: SparkSession, paths: list[str], limits: Limits | None = None) -> LiveJournal:
        return cls(spark, list(paths), limits)

    def _checkpoint(self) -> str:
        """A folder of its own in the shared one; a local one in local mode only."""
        sc = self.spark.sparkContext
        if named := sc.getConf().get("spark.checkpoint.dir"):
            return f"{named}/live-{uuid.uuid4().hex}"
        if not sc.master.split("[")[0] == "local":
            raise JournalError("live tailing on a cluster needs spark.checkpoint.dir or a checkpoint folder")
        return tempfile.mkdtemp(prefix="brindle-live-")

    def _snapshot(self) -> Snapshot:
        """Where each file ends now, from headers and last entries alone. Files that can't be read are passed over; if
        none can, the first error is raised."""
        out: Snapshot = {}
        error: JournalError | None = None
        for path, header in discovery.usable(discovery.list_files(self.roots, self.limits), self.limits):
            try:
                with JournalFile(path, self.limits) as f:
                    next(f.entry_offsets(), None)  # a broken array shows here
                    at = f.last_entry()
                    out[header.file_id.hex()] = (f.header.n_entries, at or 0, f.head(at)[0] if at else None)
            except JournalError as e:
                if self.mode != "PERMISSIVE" and not isinstance(e, Transient):
                    raise
                error = error or e
        if not out and error is not None:
            raise error
        return out

    def filter(self) -> Filter:
        return Filter(self.limits)

    def subscribe(self, flt: Filter | None = None) -> Subscription:
        """Live entries beyond the newest key of now."""
        with self.lock:
            s = Subscription(flt or self.filter(), self.limits, None, None, self.newest, False)
            self.subscriptions.append(s)
            return s

    def subscribe_from(self, flt: Filter | None = None, after_cursor: Cursor | None = None, since_realtime: int | None = None) -> Subscription:
        """Replay of what matches beyond the cursor and from the time on, then live. Without either: from the beginning."""
        after = self.journal.query().resolve(after_cursor) if after_cursor else None
        with self.lock:
            s = Subscription(flt or self.filter(), self.limits, after, since_realtime, None, True)
            s.upper = self._snapshot()
            self.subscriptions.append(s)
            return s

    def poll_once(self) -> int:
        """One bounded cycle: closed subscriptions go; what is parked is delivered, and while anything is left of it the
        cycle ends; one live batch; if it delivered nothing, one replay batch. Returns how many entries were delivered."""
        with self.lock:
            self.subscriptions = [s for s in self.subscriptions if not s.closed]
            delivered = sum(s.flush() for s in self.subscriptions)
            if any(s.parked for s in self.subscriptions):
                return delivered
            delivered += self._live_batch()
            waiting = [s for s in self.subscriptions if s.replaying and not s.closed]
            if waiting and not delivered:
                self.round += 1
                delivered += self._replay(waiting[self.round % len(waiting)])
            return delivered

    def run(self) -> None:
        """Until no subscription is left."""
        while any(not s.closed for s in self.subscriptions):
            if not self.poll_once():
                time.sleep(self.limits.poll_interval_ms / 1000)

    def stop(self) -> None:
        self.stopped = True
        self.query.stop()
        for s in self.subscriptions:
            s.close()

    def _replay(self, s: Subscription) -> int:
        n, delivered = self.limits.max_live_batch_entries, 0
        if s.rows is None:
            s.rows = self._sorted(s)
        rows = list(islice(s.rows, n + 1))  # one more tells whether the replay is done
        s.rows = chain(rows[n:], s.rows)
        for r in rows[:n]:
            cap = self.limits.max_live_replay_entries
            if cap is not None and s.replayed >= cap:
                s.close()
                raise LimitExceeded("live replay entries", cap)
            s.last, s.replayed = Key.of(r), s.replayed + 1
            delivered += s.put(r)
        if s.closed:
            s.rows = None
        elif len(rows) <= n:
            s.rows = None
            now = self._snapshot()
            if any(at > s.upper.get(i, (0, 0, None))[1] for i, (_, at, _) in now.items()):
                s.lower, s.upper, s.replayed, s.last = s.upper, now, 0, None
            else:
                s.replaying = False
        return delivered

    def _sorted(self, s: Subscription) -> Iterator[Row]:
        """What is to be replayed between the two snapshots, sorted once; only the slots between them are read."""
        slots = {i: (s.lower.get(i, (0, 0, None))[0], n) for i, (n, _, _) in s.upper.items()}
        df = self.journal.entries(mode=self.mode, slots=json.dumps(slots)).where(s.filter.always())
        if s.since is not None:
            df = df.where(F.col("realtime_usec") >= s.since)
        if s.last is not None:
            df = df.where(beyond(s.last, False))
        df = df.where((F.col("entry_offset") > _offset(s.lower, -1)) & (F.col("entry_offset") <= _offset(s.upper, -1)))
        parts = -(-sum(n - first for first, n in slots.values()) // SORTED)
        return iter(df.repartitionByRange(max(1, parts), *KEY).sortWithinPartitions(*KEY).toLocalIterator())

    def pending(self) -> bool:
        """Whether files hold what the stream hasn't consumed, or a subscription replays or has parked entries."""
        with self.lock:
            now = {h.file_id.hex(): h.n_entries for _, h in discovery.usable(discovery.list_files(self.roots, self.limits), self.limits)}
            return any(self.consumed.get(i, 0) != n for i, n in now.items()) or any((s.replaying or s.parked) and not s.closed for s in self.subscriptions)

    def _failed(self) -> None:
        """Raises what ended the stream, if it has ended by itself."""
        if (e := self.query.exception()) is not None:
            raise e from None
        if not self.query.isActive and not self.stopped:
            raise JournalError("the stream has ended")

    def _live_batch(self) -> int:
        """Lets the stream through for one batch, if files have grown or are new, and delivers it."""
        self._failed()
        try:
            now = {h.file_id.hex(): h.n_entries for _, h in discovery.usable(discovery.list_files(self.roots, self.limits), self.limits)}
        except JournalError as e:
            if self.mode != "PERMISSIVE" and not isinstance(e, Transient):
                raise
            return 0
        if all(self.consumed.get(i, 0) == n for i, n in now.items()):
            return 0
        self.permits.release()
        while True:
            try:
                rows, newest, batch_id = self.ready.get(timeout=0.1)
                break
            except queue.Empty:
                self._failed()
                if self.stopped:
                    return 0
        self._advance(batch_id)
        if len({bytes(r["file_id"]) for r in rows}) > 1:
            rows.sort(key=Key.of)
        else:
            rows.sort(key=lambda r: r["entry_offset"])  # the file's order
        delivered = 0
        for r in rows:
            key = Key.of(r)
            for i in r["__to"]:
                s = self.subscriptions[i]
                if s.armed is not None:
                    if key <= s.armed:
                        continue
                    s.armed = None
                if r["entry_offset"] > s.upper.get(key.file_id.hex(), (0, 0, None))[1]:
                    delivered += s.put(r)
        if newest is not None:
            self.newest = newest if self.newest is None else max(self.newest, newest)
        return delivered

    def _advance(self, batch_id: int) -> None:
        """Waits for the batch's end and takes over what the stream has consumed."""
        end = time.monotonic() + 300
        while time.monotonic() < end:
            p = self.query.lastProgress
            if p is not None and p["batchId"] >= batch_id:
                offset = p["sources"][0]["endOffset"]
                self.consumed = ast.literal_eval(offset) if isinstance(offset, str) else dict(offset)
                return
            self._failed()
            if self.stopped:
                return
            time.sleep(0.01)
        raise JournalError(f"batch {batch_id} doesn't end")

    def _dispatch(self, batch: DataFrame, batch_id: int) -> None:
        """In the stream's thread. The caller of poll_once() holds the lock meanwhile, so subscriptions don't change."""
        while not self.permits.acquire(timeout=0.1):
            if self.stopped:
                return
        live = [(i, s) for i, s in enumerate(self.subscriptions) if not s.closed and not s.replaying]
        hits = F.array_compact(F.array(*(F.when(s.filter.always(), F.lit(i)) for i, s in live))) if live else F.lit(None).cast("array<int>")
        # at most a live batch, by one job; of what no subscription wants only the key comes
        wanted = F.coalesce(F.size("__to") > 0, F.lit(False))
        rows = batch.withColumn("__to", hits).select(*(F.when(wanted, F.col(c)).alias(c) if c == "fields" else F.col(c) for c in (*batch.columns, "__to"))).collect()
        self.ready.put(([r for r in rows if r["__to"]], max(map(Key.of, rows), default=None), batch_id))
