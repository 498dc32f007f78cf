"""The data model: entry rows, their total order, limits and errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

#: Largest value that a u64 literal may have here; larger bounds are clamped to it.
MAX_LONG = (1 << 63) - 1
#: The total order of entries.
KEY = ("realtime_usec", "seqnum", "file_id", "entry_offset")

FIELD = StructType([StructField("name", StringType(), False), StructField("value", BinaryType(), False)])
ENTRY = StructType(
    [
        StructField("realtime_usec", LongType(), False),
        StructField("seqnum", LongType(), False),
        StructField("file_id", BinaryType(), False),
        StructField("entry_offset", LongType(), False),
        StructField("monotonic_usec", LongType(), False),
        StructField("boot_id", BinaryType(), False),
        StructField("seqnum_id", BinaryType(), True),
        StructField("machine_id", BinaryType(), True),
        StructField("xor_hash", LongType(), True),
        StructField("source_path", StringType(), True),
        StructField("fields", ArrayType(FIELD, False), False),
    ]
)


class JournalError(Exception):
    """Base of all errors."""


class InvalidQuery(JournalError):
    def __init__(self, reason: str) -> None:
        super().__init__(f"invalid query: {reason}")
        self.reason = reason


class Unsupported(JournalError):
    pass


class Corrupt(JournalError):
    def __init__(self, path: str | None, offset: int | None, reason: str) -> None:
        super().__init__(f"corrupt journal {path or '?'} at {offset if offset is not None else '?'}: {reason}")
        self.path, self.offset, self.reason = path, offset, reason

    def __reduce__(self):
        return Corrupt, (self.path, self.offset, self.reason)


class Transient(JournalError):
    """A file that is being written; a later read may succeed."""


class DecompressFailed(JournalError):
    pass


class LimitExceeded(JournalError):
    def __init__(self, kind: str, limit: int) -> None:
        super().__init__(f"limit exceeded: {kind} (limit {limit})")
        self.kind, self.limit = kind, limit

    def __reduce__(self):
        return LimitExceeded, (self.kind, self.limit)


class NotFound(JournalError):
    pass


@dataclass(frozen=True)
class Limits:
    """Bounds of reading, querying and tailing. Names and defaults of the bounds are fixed values."""

    max_object_size_bytes: int = 16 << 20
    max_decompressed_bytes: int = 1 << 20
    max_field_name_len: int = 128
    max_fields_per_entry: int = 256
    max_journal_files: int = 1024
    max_open_files: int = 64
    max_chain_steps: int = 1_000_000
    max_query_terms: int = 64
    poll_interval_ms: int = 2000
    live_channel_capacity: int = 64
    max_live_batch_entries: int = 64
    max_live_replay_entries: int | None = None
    queue_full_policy: str = "block"
    include_tilde_files: bool = False
    #: auto: files that no one writes to are mapped, files online only where that is allowed; never: none is
    mmap_policy: str = "auto"
    allow_mmap_online: bool = False
    #: time bounds are looked up by binary search in files; false: every entry's time is compared
    seek_realtime: bool = True

    def maps(self, online: bool) -> bool:
        return self.mmap_policy != "never" and (not online or self.allow_mmap_online)

    def check(self) -> Limits:
        for name in ("max_object_size_bytes", "max_decompressed_bytes", "max_field_name_len", "max_fields_per_entry", "max_journal_files", "max_open_files", "max_chain_steps", "max_query_terms"):
            if getattr(self, name) <= 0:
                raise InvalidQuery(f"{name} must be non-zero")
        if self.mmap_policy not in ("auto", "never"):
            raise InvalidQuery(f"unknown mmap policy {self.mmap_policy}")
        return self

    def check_live(self) -> Limits:
        if self.live_channel_capacity <= 0 or self.max_live_batch_entries <= 0:
            raise InvalidQuery("live capacities must be non-zero")
        if self.queue_full_policy not in ("block", "drop_newest", "disconnect"):
            raise InvalidQuery(f"unknown queue policy {self.queue_full_policy}")
        if self.queue_full_policy == "block" and self.max_live_batch_entries > self.live_channel_capacity:
            raise InvalidQuery("with the block policy a live batch must fit into the channel")
        return self


@dataclass(frozen=True, order=True)
class Key:
    """A place in the total order. Fields compare in this order; bytes compare unsigned, as BINARY does in Spark."""

    realtime_usec: int
    seqnum: int
    file_id: bytes
    entry_offset: int

    def literal(self) -> Column:
        return F.struct(
            F.lit(min(self.realtime_usec, MAX_LONG)).cast("bigint").alias("realtime_usec"),
            F.lit(min(self.seqnum, MAX_LONG)).cast("bigint").alias("seqnum"),
            F.lit(self.file_id).alias("file_id"),
            F.lit(min(self.entry_offset, MAX_LONG)).cast("bigint").alias("entry_offset"),
        )

    @staticmethod
    def column() -> Column:
        return F.struct(*(F.col(k) for k in KEY))

    @staticmethod
    def of(row) -> Key:
        return Key(row["realtime_usec"], row["seqnum"], bytes(row["file_id"]), row["entry_offset"])


def beyond(key: Key, inclusive: bool) -> Column:
    """key of a row > (or >=) key. The bound on the first part is redundant; alone it reaches the scan."""
    at = Key.column() >= key.literal() if inclusive else Key.column() > key.literal()
    return (F.col("realtime_usec") >= F.lit(min(key.realtime_usec, MAX_LONG))) & at


def up_to(key: Key) -> Column:
    return (F.col("realtime_usec") <= F.lit(min(key.realtime_usec, MAX_LONG))) & (Key.column() <= key.literal())
