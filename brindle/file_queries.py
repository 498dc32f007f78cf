"""Queries over binary journal files, live tailing and seals, and the SQL that each equals.

The files are written by the tasks from the driver's events table, one for each file id and each in another layout
(regular, compact with keyed hashes and zstd, lz4, compact with xz), so the same SQL over events holds.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import fields as fx
from brindle.operators.journal import Journal
from brindle.operators.query import JournalQuery
from brindle.operators.seal import Fsprg
from brindle.plans.cursor import Cursor, FileOffset, Native
from brindle.plans.model import JournalError, Key, Limits
from brindle.plans.predicates import Filter
from brindle.sources import entries as en
from brindle.sources import synthetic as syn
from brindle.sources.format import JournalFile
from brindle.streaming.live import LiveJournal, Subscription

AT = 500
#: A folder name of 32 hex digits, which discovery looks into.
MACHINE = "0123456789abcdef0123456789abcdef"
SEED = bytes(range(12))
#: Slots of a live batch in these queries.
BATCH = 4096
#: Received rows that the driver holds before they go to a file.
PIECE = 1 << 16

_WRITTEN: dict[tuple[str, str, str], str] = {}


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and tasks see under one path."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise JournalError("a cluster needs spark.checkpoint.dir")
        return tempfile.mkdtemp(prefix="brindle-journals-")
    base = named.removeprefix("file://").removeprefix("file:")
    if "://" in base:
        raise JournalError("journal files need a folder that is mounted on all machines")
    os.makedirs(base, exist_ok=True)
    return tempfile.mkdtemp(prefix="journals-", dir=base)


def _events(spark: SparkSession, sf_dir: str) -> en.FlatEntries:
    return en.events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def journals(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the journal files of a table's events, written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, "plain")
    if key not in _WRITTEN:
        root = _folder(spark)
        syn.write_entries(_events(spark, sf_dir).entries(), root)
        _WRITTEN[key] = root
    return _WRITTEN[key]


def _shown(df: DataFrame) -> DataFrame:
    return df.select("realtime_usec", "seqnum", F.conv(F.hex("file_id"), 16, 10).cast("bigint").alias("file_no"))


def _q(build: Callable[[JournalQuery], object], **limits) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = Journal.open_dir(spark, journals(spark, sf_dir), Limits(**limits)).query()
        build(q)
        return _shown(q.to_df())

    return run


def _at(build: Callable[[JournalQuery, object], object], **limits) -> Callable[[SparkSession, str], DataFrame]:
    """build also gets the entry of event AT, found by its seqnum."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        j = Journal.open_dir(spark, journals(spark, sf_dir), Limits(**limits))
        row = j.query().source.keys().where(F.col("seqnum") == AT + 1).first()
        q = j.query()
        build(q, row)
        return _shown(q.to_df())

    return run


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.explode_fields(Journal.open_dir(spark, journals(spark, sf_dir)).entries())
    return df.select("seqnum", "name", fx.text(F.col("value")).alias("value"))


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Journal.open_dir(spark, journals(spark, sf_dir)).entries(decode_fields="false")
    return df.select("seqnum", "monotonic_usec", F.lower(F.hex("boot_id")).alias("boot_id"), F.lower(F.hex("seqnum_id")).alias("seqnum_id"), "xor_hash")


def _same_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root given twice, and one that holds copies of its files under later names: each file counts once."""
    root, other = journals(spark, sf_dir), _folder(spark)
    for name in os.listdir(root):
        shutil.copy(f"{root}/{name}", f"{other}/z-{name}")
    return _shown(Journal.open_dirs(spark, [root, other, root]).query().to_df())


def _found(tilde: bool) -> Callable[[SparkSession, str], DataFrame]:
    """File 0 lies in the root, 1 in a machine's folder, 2 is a tilde file; what else is there isn't looked at."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root, top = journals(spark, sf_dir), _folder(spark)
        for d in (MACHINE, "other", f"{MACHINE}/deeper"):
            os.makedirs(f"{top}/{d}")
        for no, to in ((0, "a.journal"), (1, f"{MACHINE}/b.journal"), (2, "c.journal~"), (3, "other/d.journal"), (3, f"{MACHINE}/deeper/e.journal"), (3, "f.journal.txt")):
            shutil.copy(f"{root}/file-{no}.journal", f"{top}/{to}")
        os.symlink(f"{root}/file-3.journal", f"{top}/link.journal")
        return _shown(Journal.open_dir(spark, top, Limits(include_tilde_files=tilde)).query().to_df())

    return run


def _permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file's entry array is broken; the others are read."""
    root, top = journals(spark, sf_dir), _folder(spark)
    for name in os.listdir(root):
        shutil.copy(f"{root}/{name}", f"{top}/{name}")
    with open(f"{top}/file-2.journal", "r+b") as f:
        f.seek(176)
        at = int.from_bytes(f.read(8), "little")
        f.seek(at)
        f.write(b"\0")
    return _shown(Journal.open_dir(spark, top).entries(mode="PERMISSIVE"))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Journal.open_dir(spark, journals(spark, sf_dir)).catalogue()
    return c.select(F.conv(F.hex("file_id"), 16, 10).cast("bigint").alias("file_no"), "n_entries", "head_realtime", "tail_realtime")


def _each_file(spark: SparkSession, sf_dir: str, fn: Callable[[JournalFile], list[tuple]], schema: str) -> DataFrame:
    """fn's rows for each file, one task a file."""
    paths = [p for p, _ in Journal.open_dir(spark, journals(spark, sf_dir)).files]

    def run(batches):
        import pandas as pd

        for b in batches:
            for path in b["path"]:
                with JournalFile(path) as f:
                    yield pd.DataFrame(fn(f), columns=[x.split()[0] for x in schema.split(", ")])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path").mapInPandas(run, schema)


def _ends(f: JournalFile) -> list[tuple]:
    first, last = f.range()
    return [(f.header.file_id[-1], first.seqnum, last.seqnum)]


def _postings(f: JournalFile) -> list[tuple]:
    """Entries of each unit by the hash table and its posting lists, and what the DATA objects themselves count."""
    out = []
    for kind in ("signup", "error", "click", "view", "purchase"):
        objects = f.data_objects(f"UNIT={kind}.service".encode())
        out.append((f.header.file_id[-1], kind, len(f.postings(objects)), sum(n for n, _, _ in objects)))
    return out


def _sought(f: JournalFile) -> list[tuple]:
    """The slot of each hundredth time, found by binary search."""
    return [(f.header.file_id[-1], i, f.seek(f.head(x)[0].realtime_usec)) for i, x in enumerate(f.entry_offsets()) if i % 100 == 0]


class _Growing:
    """A journal that holds the first part of the events, and is then appended to."""

    def __init__(self, spark: SparkSession, sf_dir: str, **limits) -> None:
        self.spark, self.root = spark, _folder(spark)
        self.entries = _events(spark, sf_dir).entries()
        syn.write_entries(self.entries.where(F.col("seqnum") <= AT), self.root)
        self.live = LiveJournal.open_dir(spark, self.root, Limits(max_live_batch_entries=BATCH, live_channel_capacity=BATCH, **limits), mode="FAILFAST")

    def append(self) -> None:
        syn.write_entries(self.entries, self.root)

    def received(self, subscriptions: dict[str, Subscription]) -> DataFrame:
        """Rows (subscription, key) of cycles until nothing is left to come; queues are emptied after each, and what they
        held goes to files by pieces. A failure is raised, since what came before it isn't the result."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        out, rows = _folder(self.spark), []

        def write() -> None:
            columns = list(zip(*rows)) or [()] * 4
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            table = pa.table({n: pa.array(c, t) for n, c, t in zip(("subscription", "realtime_usec", "seqnum", "file_no"), columns, types)})
            pq.write_table(table, f"{out}/{uuid.uuid4().hex}.parquet")
            rows.clear()

        try:
            more = True
            while more:
                more = self.live.pending()  # asked before the cycle: what it brings is taken below
                self.live.poll_once()
                for name, s in subscriptions.items():
                    while (r := s.try_recv()) is not None:
                        k = Key.of(r)
                        rows.append((name, k.realtime_usec, k.seqnum, int.from_bytes(k.file_id, "big")))
                if len(rows) >= PIECE:
                    write()
            write()
        finally:
            self.live.stop()
            shutil.rmtree(self.root, ignore_errors=True)
        return self.spark.read.schema("subscription string, realtime_usec bigint, seqnum bigint, file_no bigint").parquet(f"file://{out}")


def _live_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _Growing(spark, sf_dir)
    s = g.live.subscribe()
    g.append()
    return g.received({"all": s})


def _live_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _Growing(spark, sf_dir)
    subs = {
        "errors": g.live.subscribe(Filter().match_unit("error.service")),
        "user7": g.live.subscribe(Filter().match_exact("_UID", "7")),
        "dup_or_purchase": g.live.subscribe(Filter().or_group(lambda x: x.match_exact("MESSAGE", "dup")).or_group(lambda x: x.match_exact("_SYSTEMD_UNIT", "purchase.service"))),
    }
    g.append()
    return g.received(subs)


def _live_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the beginning: what was there, then what is appended meanwhile, each once."""
    g = _Growing(spark, sf_dir)
    s = g.live.subscribe_from(Filter().match_unit("error.service"))
    g.append()
    return g.received({"errors": s})


def _live_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _Growing(spark, sf_dir)
    row = g.live.journal.query().source.keys().where(F.col("seqnum") == 101).first()
    s = g.live.subscribe_from(after_cursor=Cursor.of(row))
    g.append()
    return g.received({"all": s})


def _live_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _Growing(spark, sf_dir)
    row = g.live.journal.query().source.keys().where(F.col("seqnum") == 101).first()
    s = g.live.subscribe_from(since_realtime=row["realtime_usec"])
    g.append()
    return g.received({"all": s})


def _live_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that appear later are tailed from their beginning."""
    g = _Growing(spark, sf_dir)
    s = g.live.subscribe_from(Filter())
    later = g.entries.withColumn("file_id", F.unhex(F.lpad(F.hex(F.conv(F.hex("file_id"), 16, 10).cast("bigint") + 4), 32, "0")))
    syn.write_entries(later, g.root)
    return g.received({"all": s})


def _live_slow(policy: str) -> Callable[[SparkSession, str], DataFrame]:
    """A queue of 64 under batches of thousands: what it can't take is parked, the stream waits, and everything comes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = _Growing(spark, sf_dir, queue_full_policy=policy)
        s = Subscription(Filter().match_unit("error.service"), Limits(live_channel_capacity=64, max_live_batch_entries=64, queue_full_policy=policy), None, None, g.live.newest, False)
        g.live.subscriptions.append(s)
        g.append()
        return g.received({"errors": s})

    return run


def _sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed files of the events' units are written by the tasks and verified by key."""
    root = _folder(spark)
    layouts = tuple({"seal": Fsprg(SEED), "compact": i % 2 == 1} for i in range(4))
    syn.write_entries(_events(spark, sf_dir).entries(), root, layouts)
    out = Journal.open_dir(spark, root).verify_seal(SEED.hex() + "/1-1")
    return out.select(F.regexp_extract("path", r"file-(\d+)", 1).cast("bigint").alias("file_no"), "sealed", "ok", "n_tags")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "file_scan": _q(lambda q: q),
    "file_scan_pread": _q(lambda q: q, mmap_policy="never", max_open_files=1),
    "file_fields": _fields,
    "file_columns": _columns,
    "file_same_roots": _same_roots,
    "file_discovery": _found(False),
    "file_discovery_tilde": _found(True),
    "file_permissive": _permissive,
    "file_since": _at(lambda q, r: q.since_realtime(r["realtime_usec"])),
    "file_until": _at(lambda q, r: q.until_realtime(r["realtime_usec"])),
    "file_since_without_seek": _at(lambda q, r: q.since_realtime(r["realtime_usec"]), seek_realtime=False),
    "file_window": _at(lambda q, r: q.since_realtime(r["realtime_usec"]).until_realtime(r["realtime_usec"])),
    "file_after_cursor": _at(lambda q, r: q.after_cursor(Cursor.parse(str(Cursor.of(r))))),
    "file_seek_cursor": _at(lambda q, r: q.at_cursor(Cursor.of(r))),
    "file_cursor_offset": _at(lambda q, r: q.after_cursor(Cursor(FileOffset(bytes(r["file_id"]), r["entry_offset"])))),
    "file_cursor_native": _at(lambda q, r: q.after_cursor(Cursor(Native(seqnum_id=bytes(r["seqnum_id"]), seqnum=r["seqnum"])))),
    "file_match_unit": _q(lambda q: q.match_unit("error.service")),
    "file_match_exact": _q(lambda q: q.match_exact("PRIORITY", "3").match_exact("_UID", "7")),
    "file_match_present": _q(lambda q: q.match_present("_PID")),
    "file_or_groups": _q(lambda q: q.or_group(lambda g: g.match_exact("_SYSTEMD_UNIT", "click.service")).or_group(lambda g: g.match_exact("PRIORITY", "3").match_present("_PID"))),
    "file_global_and_or_groups": _q(lambda q: q.match_present("_PID").or_group(lambda g: g.match_exact("_UID", "7")).or_group(lambda g: g.match_exact("_UID", "8"))),
    "file_no_match": _q(lambda q: q.match_unit("absent.service")),
    "file_unit_since": _at(lambda q, r: q.match_unit("error.service").since_realtime(r["realtime_usec"])),
    "file_tail": _q(lambda q: q.seek_tail().limit(20)),
    "file_catalogue": _catalogue,
    "file_ends": lambda spark, sf_dir: _each_file(spark, sf_dir, _ends, "file_no bigint, first_seqnum bigint, last_seqnum bigint"),
    "file_postings": lambda spark, sf_dir: _each_file(spark, sf_dir, _postings, "file_no bigint, unit string, n_found bigint, n_counted bigint"),
    "file_sought": lambda spark, sf_dir: _each_file(spark, sf_dir, _sought, "file_no bigint, slot bigint, found bigint"),
    "live_append": _live_append,
    "live_fan_out": _live_fan_out,
    "live_replay": _live_replay,
    "live_after_cursor": _live_after_cursor,
    "live_since": _live_since,
    "live_new_files": _live_new_files,
    "live_block": _live_slow("block"),
    "seal_verify": _sealed,
}

_J = """WITH j AS (SELECT epoch_us(ts) AS realtime_usec, event_id + 1 AS seqnum, event_id % 4 AS file_no, event_id % 4 AS fn, * FROM events),
p AS (SELECT realtime_usec AS rt, seqnum AS sq, file_no AS no FROM j WHERE event_id = 500), o AS (SELECT realtime_usec AS rt FROM j WHERE event_id = 100)
"""
_CUR = "SELECT realtime_usec, seqnum, file_no FROM j"
_FIELDS = """SELECT event_id + 1 AS seqnum, CASE WHEN event_id % 5 < 3 THEN '_SYSTEMD_UNIT' WHEN event_id % 5 = 3 THEN 'UNIT' ELSE 'OBJECT_SYSTEMD_UNIT' END AS name, event_type || '.service' AS value FROM events
UNION ALL SELECT event_id + 1, 'MESSAGE', props FROM events
UNION ALL SELECT event_id + 1, 'PRIORITY', CASE WHEN event_type = 'error' THEN '3' ELSE '6' END FROM events
UNION ALL SELECT event_id + 1, '_UID', CAST(user_id AS VARCHAR) FROM events
UNION ALL SELECT event_id + 1, '_PID', CAST(event_id AS VARCHAR) FROM events WHERE user_id % 3 <> 0
UNION ALL SELECT event_id + 1, 'MESSAGE', 'dup' FROM events WHERE event_id % 11 = 0"""
_BEYOND = ", p WHERE (realtime_usec, seqnum, file_no) {} (rt, sq, no)"


def _sql(where: str = "true", tail: str = "") -> str:
    return f"{_J}{_CUR} WHERE {where}{tail}"


def _live_sql(name: str, where: str) -> str:
    return f"{_J}SELECT '{name}' AS subscription, realtime_usec, seqnum, file_no FROM j, o WHERE {where}"


ORACLE: dict[str, str] = {
    "file_scan": _sql(),
    "file_scan_pread": _sql(),
    "file_fields": _FIELDS,
    "file_columns": "SELECT event_id + 1 AS seqnum, epoch_us(ts) - 1704067200000000 AS monotonic_usec, md5(CAST(user_id % 8 AS VARCHAR)) AS boot_id, lpad('1', 32, '0') AS seqnum_id, event_id AS xor_hash FROM events",
    "file_same_roots": _sql(),
    "file_discovery": _sql("file_no IN (0, 1)"),
    "file_discovery_tilde": _sql("file_no IN (0, 1, 2)"),
    "file_permissive": _sql("file_no <> 2"),
    "file_since": f"{_J}{_CUR}, p WHERE realtime_usec >= rt",
    "file_until": f"{_J}{_CUR}, p WHERE realtime_usec <= rt",
    "file_since_without_seek": f"{_J}{_CUR}, p WHERE realtime_usec >= rt",
    "file_window": f"{_J}{_CUR}, p WHERE realtime_usec = rt",
    "file_after_cursor": _J + _CUR + _BEYOND.format(">"),
    "file_seek_cursor": _J + _CUR + _BEYOND.format(">="),
    "file_cursor_offset": _J + _CUR + _BEYOND.format(">"),
    "file_cursor_native": _J + _CUR + _BEYOND.format(">"),
    "file_match_unit": _sql("event_type = 'error'"),
    "file_match_exact": _sql("event_type = 'error' AND user_id = 7"),
    "file_match_present": _sql("user_id % 3 <> 0"),
    "file_or_groups": _sql("(event_type = 'click' AND event_id % 5 < 3) OR (event_type = 'error' AND user_id % 3 <> 0)"),
    "file_global_and_or_groups": _sql("user_id % 3 <> 0 AND user_id IN (7, 8)"),
    "file_no_match": _sql("false"),
    "file_unit_since": f"{_J}{_CUR}, p WHERE event_type = 'error' AND realtime_usec >= rt",
    "file_tail": _sql("true", " ORDER BY realtime_usec DESC, seqnum DESC, file_no DESC LIMIT 20"),
    "file_catalogue": f"{_J}SELECT file_no, count(*) AS n_entries, min(realtime_usec) AS head_realtime, max(realtime_usec) AS tail_realtime FROM j GROUP BY file_no",
    "file_ends": f"{_J}SELECT file_no, arg_min(seqnum, (realtime_usec, seqnum)) AS first_seqnum, arg_max(seqnum, (realtime_usec, seqnum)) AS last_seqnum FROM j GROUP BY file_no",
    "file_postings": f"{_J}SELECT n.file_no, u.unit, count(j.seqnum) AS n_found, count(j.seqnum) AS n_counted FROM (SELECT DISTINCT file_no FROM j) n CROSS JOIN (VALUES ('signup'), ('error'), ('click'), ('view'), ('purchase')) u(unit) LEFT JOIN j ON j.file_no = n.file_no AND j.event_type = u.unit AND j.event_id % 5 = 3 GROUP BY ALL",
    "file_sought": f"{_J}SELECT file_no, slot, slot AS found FROM (SELECT file_no, row_number() OVER (PARTITION BY file_no ORDER BY realtime_usec, seqnum) - 1 AS slot FROM j) WHERE slot % 100 = 0",
    "live_append": _live_sql("all", "seqnum > 500"),
    "live_fan_out": " UNION ALL ".join(f"({_live_sql(n, f'seqnum > 500 AND ({w})')})" for n, w in (("errors", "event_type = 'error'"), ("user7", "user_id = 7"), ("dup_or_purchase", "event_id % 11 = 0 OR (event_type = 'purchase' AND event_id % 5 < 3)"))),
    "live_replay": _live_sql("errors", "event_type = 'error'"),
    "live_after_cursor": _live_sql("all", "realtime_usec > rt"),
    "live_since": _live_sql("all", "realtime_usec >= rt"),
    "live_new_files": f"{_J}SELECT 'all' AS subscription, realtime_usec, seqnum, file_no FROM j WHERE seqnum <= 500 UNION ALL SELECT 'all', realtime_usec, seqnum, file_no + 4 FROM j",
    "live_block": _live_sql("errors", "event_type = 'error' AND seqnum > 500"),
    "seal_verify": "SELECT DISTINCT event_id % 4 AS file_no, true AS sealed, true AS ok, CAST(2 AS BIGINT) AS n_tags FROM events",
}
