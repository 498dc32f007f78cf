"""Historical queries: filter, time range, cursor, order and limit over entry rows, as one DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from brindle.plans.cursor import Cursor, FileOffset, Native
from brindle.plans.model import ENTRY, KEY, MAX_LONG, InvalidQuery, Key, Limits, NotFound, beyond
from brindle.plans.predicates import Filter
from brindle.sources.entries import Entries


class JournalQuery(Filter):
    """A chainable builder over an Entries source. Nothing runs before a terminal call."""

    def __init__(self, source: Entries, limits: Limits | None = None) -> None:
        super().__init__(limits)
        self.source = source
        self._since: int | None = None
        self._until: int | None = None
        self._cursor: tuple[Cursor, bool] | None = None
        self._resolved: tuple[Cursor, Key] | None = None
        self._reverse = False
        self._limit: int | None = None

    def since_realtime(self, usec: int) -> JournalQuery:
        """Inclusive lower bound."""
        self._since = usec
        return self

    def until_realtime(self, usec: int) -> JournalQuery:
        """Inclusive upper bound."""
        self._until = usec
        return self

    def after_cursor(self, cursor: Cursor) -> JournalQuery:
        """Keys strictly beyond the cursor's; a lower bound in either direction."""
        self._cursor = (cursor, False)
        return self

    def at_cursor(self, cursor: Cursor) -> JournalQuery:
        self._cursor = (cursor, True)
        return self

    def seek_head(self) -> JournalQuery:
        self._cursor, self._reverse = None, False
        return self

    def seek_tail(self) -> JournalQuery:
        self._cursor, self._reverse = None, True
        return self

    def reverse(self, on: bool = True) -> JournalQuery:
        self._reverse = on
        return self

    def limit(self, n: int) -> JournalQuery:
        self._limit = n
        return self

    def check(self) -> None:
        super().check()
        if self._since is not None and self._until is not None and self._since > self._until:
            raise InvalidQuery("since_realtime is after until_realtime")

    def resolve(self, cursor: Cursor) -> Key:
        """The cursor's key: an entry key as it is, others by one look-up over key columns."""
        at = cursor.at
        if isinstance(at, Key):
            return at
        keys = self.source.keys()
        if isinstance(at, FileOffset):
            rows = keys.where((F.col("file_id") == F.lit(at.file_id)) & (F.col("entry_offset") == min(at.entry_offset, MAX_LONG))).select(*KEY).limit(1).collect()
            if not rows:
                raise NotFound("no such entry")
            return Key.of(rows[0])
        return self._resolve_native(at, keys)

    def _resolve_native(self, at: Native, keys: DataFrame) -> Key:
        signed = lambda x: x - (1 << 64) if x > MAX_LONG else x
        wanted = [F.lit(True)]
        for name, value in zip(("seqnum_id", "seqnum", "boot_id", "monotonic_usec", "realtime_usec", "xor_hash"), at.parts()):
            if value is not None:
                wanted.append(F.col(name) == F.lit(value if isinstance(value, bytes) else signed(value)))
        cond: Column = wanted[0]
        for w in wanted[1:]:
            cond = cond & w
        rows = keys.where(cond).orderBy("source_path", "entry_offset").select(*KEY).limit(1).collect()
        if rows:
            return Key.of(rows[0])
        if at.realtime_usec is None:
            raise NotFound("no entry matches the cursor")
        return Key(at.realtime_usec, at.seqnum or 0, bytes(16), 0)

    def cursor_key(self) -> Key | None:
        """The key that the cursor stands for, looked up once."""
        if self._cursor is None:
            return None
        if self._resolved is None or self._resolved[0] is not self._cursor[0]:
            self._resolved = (self._cursor[0], self.resolve(self._cursor[0]))
        return self._resolved[1]

    def span(self) -> tuple[int | None, int | None]:
        """Least and greatest time of what can match, for sources that prune by it."""
        key = self.cursor_key()
        lower = [x for x in (self._since, None if key is None else key.realtime_usec) if x is not None]
        return max(lower, default=None), self._until

    def bounds(self) -> Column | None:
        """Time range and cursor as one Column."""
        parts = []
        if self._since is not None:
            parts.append(F.col("realtime_usec") >= F.lit(min(self._since, MAX_LONG)))
        if self._until is not None:
            parts.append(F.col("realtime_usec") <= F.lit(min(self._until, MAX_LONG)))
        if self._cursor is not None:
            parts.append(beyond(self.cursor_key(), self._cursor[1]))
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out

    def unordered(self) -> DataFrame:
        """Matching entries without order or limit: for aggregations, where a sort would be wasted."""
        self.check()
        return self.source.select(self)

    def to_df(self) -> DataFrame:
        """The result in its order. With a limit the plan is one top-k (TakeOrderedAndProject)."""
        self.check()
        if self._limit == 0:  # before any cursor is looked up
            return self.source.spark.createDataFrame([], ENTRY)
        df = self.unordered()
        df = df.orderBy(*(F.col(k).desc() if self._reverse else F.col(k).asc() for k in KEY))
        return df if self._limit is None else df.limit(self._limit)

    def iter(self) -> Iterator[Row]:
        return self.to_df().toLocalIterator()

    def collect(self) -> list[Row]:
        return self.to_df().collect()
