"""Sources of entry rows: ready entry tables, and flat tables described field by field."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.plans.model import ENTRY, KEY


class Entries:
    """A table of entry rows (the ENTRY columns)."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def keys(self) -> DataFrame:
        """All columns but fields, for cursor look-ups."""
        return self.df.drop("fields")

    def select(self, query) -> DataFrame:
        df, bounds, terms = self.df, query.bounds(), query.column()
        if bounds is not None:
            df = df.where(bounds)
        return df if terms is None else df.where(terms)


@dataclass(frozen=True)
class FlatField:
    """A field of an entry made from a flat table's columns: its name, its value as text or bytes, and when it is there.

    equals: the comparison with a text, put in the table's own columns so that it reaches the scan. It must hold for the
    very rows whose value is that text.
    """

    name: str
    value: Column
    when: Column | None = None
    equals: Callable[[str], Column] | None = None

    def there(self) -> Column:
        c = self.value.isNotNull()
        return c if self.when is None else c & F.coalesce(self.when, F.lit(False))


class FlatEntries(Entries):
    """Entries over a flat table. Terms are compiled to predicates on the table's own columns, so they reach its scan
    and no array is built for rows that don't match; the fields are put together for the rows that are left."""

    def __init__(self, df: DataFrame, keys: dict[str, Column], flat: list[FlatField], between: Callable[[int | None, int | None], Column | None] | None = None) -> None:
        """between: the inclusive time range in microseconds as a comparison of the table's own columns, or None."""
        super().__init__(df)
        self.flat, self.between = flat, between
        self.key_columns = {f.name: keys.get(f.name, F.lit(None)).cast(f.dataType) for f in ENTRY if f.name != "fields"}

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"__k_{n}": c for n, c in self.key_columns.items()})

    def _named(self, df: DataFrame, with_fields: bool) -> DataFrame:
        cols = [F.col(f"__k_{n}").alias(n) for n in self.key_columns]
        if with_fields:
            made = [F.when(f.there(), F.struct(F.lit(f.name).alias("name"), f.value.cast("binary").alias("value"))) for f in self.flat]
            cols.append(F.array_compact(F.array(*made)).alias("fields"))
        return df.select(*cols)

    def keys(self) -> DataFrame:
        return self._named(self._keyed(self.df), False)

    def entries(self) -> DataFrame:
        return self._named(self._keyed(self.df), True)

    def _any(self, conditions: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)

    def exact(self, name: str, value: bytes) -> Column:
        def same(f: FlatField) -> Column:
            try:
                text = value.decode("utf-8")
            except UnicodeDecodeError:
                return f.there() & (f.value.cast("binary") == F.lit(value))
            if f.equals is None:
                return f.there() & (f.value.cast("string") == F.lit(text))
            own = f.equals(text)  # first, alone: what branches share is drawn out of them and reaches the scan
            return own if f.when is None else own & F.coalesce(f.when, F.lit(False))

        return self._any([same(f) for f in self.flat if f.name == name])

    def present(self, name: str) -> Column:
        return self._any([f.there() for f in self.flat if f.name == name])

    def select(self, query) -> DataFrame:
        df = self.df
        terms = query.column(self.exact, self.present)
        if terms is not None:
            df = df.where(terms)
        if self.between is not None and (span := self.between(*query.span())) is not None:
            df = df.where(span)
        out = self._named(self._keyed(df), True)
        bounds = query.bounds()
        return out if bounds is None else out.where(bounds)


EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def timestamps(column: str) -> Callable[[int | None, int | None], Column | None]:
    """A time range over a TIMESTAMP_NTZ column in UTC; bounds that no such column can hold are left out."""

    def at(usec: int) -> Column | None:
        try:
            return F.expr(f"TIMESTAMP_NTZ'{(EPOCH + timedelta(microseconds=usec)).strftime('%Y-%m-%d %H:%M:%S.%f')}'") if usec >= 0 else None
        except OverflowError:
            return None

    def between(lo: int | None, hi: int | None) -> Column | None:
        parts = []
        if lo is not None and (x := at(lo)) is not None:
            parts.append(F.col(column) >= x)
        if hi is not None and (x := at(hi)) is not None:
            parts.append(F.col(column) <= x)
        return reduce(lambda a, b: a & b, parts) if parts else None

    return between


def suffixed(column: str, suffix: str) -> Callable[[str], Column]:
    """column || suffix = text."""
    return lambda text: F.col(column) == F.lit(text[: len(text) - len(suffix)]) if text.endswith(suffix) else F.lit(False)


def integer(column: str) -> Callable[[str], Column]:
    """CAST(column AS STRING) = text, of a BIGINT column."""

    def equals(text: str) -> Column:
        n = int(text) if text.lstrip("-").isdecimal() and text.isascii() else None
        return F.col(column) == F.lit(n).cast("bigint") if n is not None and str(n) == text and -(1 << 63) <= n < 1 << 63 else F.lit(False)

    return equals


def events(df: DataFrame) -> FlatEntries:
    """The driver's events table as entries."""
    rt = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    unit, part = F.concat("event_type", F.lit(".service")), F.col("event_id") % 5
    keys = {
        "realtime_usec": rt,
        "seqnum": F.col("event_id") + 1,
        "file_id": F.unhex(F.lpad(F.hex(F.col("event_id") % 4), 32, "0")),
        "entry_offset": 4096 + F.col("event_id") * 64,
        "monotonic_usec": rt - 1704067200000000,
        "boot_id": F.unhex(F.md5((F.col("user_id") % 8).cast("string").cast("binary"))),
        "seqnum_id": F.unhex(F.lit("0" * 31 + "1")),
        "xor_hash": F.col("event_id"),
        "source_path": F.concat(F.lit("file-"), (F.col("event_id") % 4).cast("string")),
    }
    is_unit = suffixed("event_type", ".service")
    error = F.col("event_type") == "error"
    urgent = {"3": error, "6": F.coalesce(~error, F.lit(True))}
    flat = [
        FlatField("_SYSTEMD_UNIT", unit, part < 3, is_unit),
        FlatField("UNIT", unit, part == 3, is_unit),
        FlatField("OBJECT_SYSTEMD_UNIT", unit, part == 4, is_unit),
        FlatField("MESSAGE", F.col("props"), None, lambda text: F.col("props") == F.lit(text)),
        FlatField("PRIORITY", F.when(error, "3").otherwise("6"), None, lambda text: urgent.get(text, F.lit(False))),
        FlatField("_UID", F.col("user_id").cast("string"), None, integer("user_id")),
        FlatField("_PID", F.col("event_id").cast("string"), F.col("user_id") % 3 != 0, integer("event_id")),
        FlatField("MESSAGE", F.lit("dup"), F.col("event_id") % 11 == 0, lambda text: F.lit(text == "dup")),
    ]
    return FlatEntries(df, keys, flat, timestamps("ts"))


def file_ranges(entries: DataFrame) -> DataFrame:
    """First and last key of each file: one aggregation with map-side combine."""
    key = F.struct(*KEY)
    return entries.groupBy("file_id").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n_entries"))


def last_seen(entries: DataFrame) -> DataFrame:
    return entries.agg(F.max(F.struct(*KEY)).alias("key")).where("key is not null").select("key.*")


def dedup_files(entries: DataFrame) -> DataFrame:
    """Of files with one file_id the entries of that which is first by path."""
    first = entries.groupBy("file_id").agg(F.min("source_path").alias("source_path"))
    return entries.join(first, ["file_id", "source_path"], "left_semi").select(*entries.columns)


def dedup_entries(entries: DataFrame) -> DataFrame:
    """One row for each key, where tables overlap."""
    return entries.dropDuplicates(list(KEY))


def fan_out(entries: DataFrame, subscriptions: dict[str, object]) -> DataFrame:
    """(subscription, entry) for every filter that an entry passes: one scan for all subscriptions."""
    hits = F.array_compact(F.array(*(F.when(f.always(), F.lit(name)) for name, f in subscriptions.items())))
    return entries.withColumn("subscription", F.explode(hits))


def replay_batch(entries: DataFrame, after, upper, n: int) -> DataFrame:
    """The next n entries of (after, upper] and one more, which tells whether the replay is done."""
    from brindle.plans.model import beyond, up_to

    df = entries.where(up_to(upper))
    if after is not None:
        df = df.where(beyond(after, False))
    return df.orderBy(*KEY).limit(n + 1)


def newest_per_file(entries: DataFrame) -> DataFrame:
    w = Window.partitionBy("file_id").orderBy(*(F.col(k).desc() for k in KEY))
    return entries.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


__all__ = ["Entries", "FlatEntries", "FlatField", "dedup_entries", "dedup_files", "events", "fan_out", "file_ranges", "last_seen", "newest_per_file", "replay_batch"]
