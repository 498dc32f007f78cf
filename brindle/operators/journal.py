"""A journal: the files under some roots, queried and tailed as entry rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from brindle.operators.query import JournalQuery
from brindle.plans.cursor import Cursor
from brindle.plans.model import InvalidQuery, Limits
from brindle.sources import datasource, discovery
from brindle.sources.entries import Entries


class FileEntries(Entries):
    """Entries read by the journal source. It gets the exact terms of each branch of the filter, and looks them up in the
    files' hash tables; where a branch has none, files are scanned."""

    def __init__(self, spark: SparkSession, roots: list[str], limits: Limits) -> None:
        self._spark, self.roots, self.limits = spark, roots, limits
        datasource.register(spark)
        super().__init__(self.load())

    @property
    def spark(self) -> SparkSession:
        return self._spark

    def load(self, **options: str) -> DataFrame:
        return self._spark.read.format("journal").options(**datasource.options_of(self.limits), **options).load(",".join(self.roots))

    def keys(self) -> DataFrame:
        return self.load(decode_fields="false").drop("fields")

    def select(self, query) -> DataFrame:
        branches = [[n.encode() + b"=" + v for n, v in (*query.globals, *g) if v is not None] for g in query.groups or [[]]]
        options = {"branches": json.dumps([[x.hex() for x in b] for b in branches])} if all(branches) else {}
        df, bounds, terms = self.load(**options), query.bounds(), query.column()
        if bounds is not None:
            df = df.where(bounds)
        return df if terms is None else df.where(terms)


class Journal:
    def __init__(self, spark: SparkSession, roots: list[str], limits: Limits | None = None) -> None:
        self.limits = (limits or Limits()).check()
        if not roots:
            raise InvalidQuery("no journal roots")
        self.spark, self.roots = spark, [str(r) for r in roots]
        self.files = discovery.usable(discovery.list_files(self.roots, self.limits), self.limits)

    @classmethod
    def open_default(cls, spark: SparkSession, limits: Limits | None = None) -> Journal:
        return cls(spark, discovery.default_roots(), limits)

    @classmethod
    def open_dir(cls, spark: SparkSession, path: str, limits: Limits | None = None) -> Journal:
        return cls(spark, [path], limits)

    @classmethod
    def open_dirs(cls, spark: SparkSession, paths: list[str], limits: Limits | None = None) -> Journal:
        return cls(spark, list(paths), limits)

    def entries(self, **options: str) -> DataFrame:
        return FileEntries(self.spark, self.roots, self.limits).load(**options)

    def query(self) -> JournalQuery:
        return JournalQuery(FileEntries(self.spark, self.roots, self.limits), self.limits)

    def seek_cursor(self, cursor: Cursor) -> JournalQuery:
        """A query from the cursor's entry on, inclusive."""
        return self.query().at_cursor(cursor)

    def catalogue(self) -> DataFrame:
        """One row for each file: path, ids, count and the times of its header. What the driver read when the journal was opened."""
        rows = [(p, h.file_id, h.seqnum_id, h.n_entries, h.head_realtime, h.tail_realtime, h.sealed) for p, h in self.files]
        return self.spark.createDataFrame(rows, "path string, file_id binary, seqnum_id binary, n_entries bigint, head_realtime bigint, tail_realtime bigint, sealed boolean")

    def live(self):
        from brindle.streaming.live import LiveJournal

        return LiveJournal(self.spark, self.roots, self.limits)

    def verify_seal(self, key: str) -> DataFrame:
        """(path, sealed, ok, error, n_tags) of every file; raises for the first that fails. One task a file."""
        from brindle.operators.seal import verify

        return verify(self.spark, [p for p, _ in self.files], key, self.limits)
