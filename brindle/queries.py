"""The engine's queries over the driver's tables, and the SQL that each equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import fields as fx
from brindle.operators.query import JournalQuery
from brindle.plans.cursor import Cursor, FileOffset, Native
from brindle.plans.model import KEY, Key
from brindle.plans.predicates import Filter
from brindle.sources import entries as en

#: The event that cursors and bounds of the examples point at.
AT = 500


def _source(spark: SparkSession, sf_dir: str) -> en.FlatEntries:
    return en.events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _file_no() -> Column:
    return F.conv(F.hex("file_id"), 16, 10).cast("bigint").alias("file_no")


def _keys(df: DataFrame) -> DataFrame:
    return df.select("realtime_usec", "seqnum", _file_no(), "entry_offset")


def _key(src: en.FlatEntries, event_id: int) -> Key:
    """Key of an event: one row of the key columns."""
    return Key.of(src.keys().where(F.col("seqnum") == event_id + 1).select(*KEY).first())


def _file_offset(event_id: int) -> Cursor:
    return Cursor(FileOffset((event_id % 4).to_bytes(16, "big"), 4096 + 64 * event_id))


def _q(build: Callable[[JournalQuery], object], show: Callable[[DataFrame], DataFrame] = _keys, ordered: bool = True) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = JournalQuery(_source(spark, sf_dir))
        build(q)
        return show(q.to_df() if ordered else q.unordered())

    return run


def _at(build: Callable[[JournalQuery, en.FlatEntries], object]) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        src = _source(spark, sf_dir)
        q = JournalQuery(src)
        build(q, src)
        return _keys(q.to_df())

    return run


def _native(src: en.FlatEntries, event_id: int, shift: int = 0) -> Cursor:
    k = _key(src, event_id)
    return Cursor(Native(realtime_usec=k.realtime_usec + shift, seqnum=None if shift else k.seqnum))


def _all(show: Callable[[DataFrame], DataFrame]) -> Callable:
    return lambda spark, sf_dir: show(_source(spark, sf_dir).entries())


def _exploded(df: DataFrame, how: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return how(df).select("seqnum", "name", fx.text(F.col("value")).alias("value"))


def _subscriptions() -> dict[str, Filter]:
    return {
        "errors": Filter().match_unit("error.service"),
        "user7": Filter().match_exact("_UID", "7"),
        "dup_or_purchase": Filter().or_group(lambda g: g.match_exact("MESSAGE", "dup")).or_group(lambda g: g.match_exact("_SYSTEMD_UNIT", "purchase.service")),
    }


def _duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries twice, the second time under a later path: as two roots that hold the same files."""
    e = _source(spark, sf_dir).entries()
    return _keys(en.dedup_files(e.union(e.withColumn("source_path", F.concat(F.lit("z-"), "source_path")))))


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _source(spark, sf_dir)
    return _keys(en.replay_batch(src.entries(), _key(src, AT), _key(src, AT + 200), 64))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entries of a unit in a time range: filter, range, order and limit at once."""
    src = _source(spark, sf_dir)
    q = JournalQuery(src).match_unit("error.service").since_realtime(_key(src, 100).realtime_usec).until_realtime(_key(src, 900).realtime_usec)
    return _keys(q.seek_tail().limit(50).to_df())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_all": _q(lambda q: q),
    "match_exact_priority": _q(lambda q: q.match_exact("PRIORITY", "3")),
    "match_exact_and": _q(lambda q: q.match_exact("PRIORITY", "3").match_exact("_UID", "7")),
    "match_exact_duplicate_value": _q(lambda q: q.match_exact("MESSAGE", "dup")),
    "match_present_pid": _q(lambda q: q.match_present("_PID")),
    "match_unit": _q(lambda q: q.match_unit("error.service")),
    "match_exact_unit_field": _q(lambda q: q.match_exact("_SYSTEMD_UNIT", "error.service")),
    "or_group_two": _q(lambda q: q.or_group(lambda g: g.match_exact("_SYSTEMD_UNIT", "click.service")).or_group(lambda g: g.match_exact("PRIORITY", "3").match_present("_PID"))),
    "global_and_or_groups": _q(lambda q: q.match_present("_PID").or_group(lambda g: g.match_exact("_UID", "7")).or_group(lambda g: g.match_exact("_UID", "8"))),
    "unit_then_group": _q(lambda q: q.match_unit("error.service").or_group(lambda g: g.match_exact("_UID", "7"))),
    "group_then_unit": _q(lambda q: q.or_group(lambda g: g.match_exact("_UID", "7")).match_unit("error.service")),
    "two_units": _q(lambda q: q.match_unit("error.service").match_unit("click.service")),
    "two_units_same": _q(lambda q: q.match_unit("error.service").match_unit("error.service")),
    "no_match": _q(lambda q: q.match_exact("NO_SUCH_FIELD", "1")),
    "since": _at(lambda q, s: q.since_realtime(_key(s, AT).realtime_usec)),
    "until": _at(lambda q, s: q.until_realtime(_key(s, AT).realtime_usec)),
    "window_point": _at(lambda q, s: q.since_realtime(_key(s, AT).realtime_usec).until_realtime(_key(s, AT).realtime_usec)),
    "after_cursor": _at(lambda q, s: q.after_cursor(Cursor(_key(s, AT)))),
    "seek_cursor": _at(lambda q, s: q.at_cursor(Cursor(_key(s, AT)))),
    "after_cursor_reverse": _at(lambda q, s: q.after_cursor(Cursor(_key(s, AT))).reverse().limit(20)),
    "cursor_file_offset": _at(lambda q, s: q.after_cursor(_file_offset(AT))),
    "cursor_native_exact": _at(lambda q, s: q.after_cursor(_native(s, AT))),
    "cursor_native_fallback": _at(lambda q, s: q.after_cursor(_native(s, AT, 1))),
    "cursor_text_resume": _at(lambda q, s: q.after_cursor(Cursor.parse(str(Cursor(_key(s, AT)))))),
    "head_n": _q(lambda q: q.seek_head().limit(10)),
    "tail_n": _q(lambda q: q.seek_tail().limit(10)),
    "reverse_all_limit": _q(lambda q: q.match_present("_PID").reverse().limit(500)),
    "limit_zero": _q(lambda q: q.limit(0)),
    "tail_unit_window": flagship,
    "get_first_message": _q(lambda q: q.match_exact("MESSAGE", "dup"), lambda d: d.select("seqnum", fx.text(fx.get("MESSAGE")).alias("message")), ordered=False),
    "explode_fields": _all(lambda d: _exploded(d, fx.explode_fields)),
    "first_per_name": _all(lambda d: _exploded(d, lambda x: fx.explode_fields(x.withColumn("fields", fx.first_fields())))),
    "field_count": _all(lambda d: d.select("seqnum", F.size("fields").cast("bigint").alias("n_fields"))),
    "wide_view": _all(lambda d: fx.wide(d, ["PRIORITY", "_PID"]).select("seqnum", F.col("PRIORITY").alias("priority"), F.col("_PID").alias("pid"))),
    "cursor_text": _all(lambda d: d.select("seqnum", fx.cursor_text().alias("cursor"))),
    "entry_columns": _all(lambda d: d.select("seqnum", "realtime_usec", "monotonic_usec", F.lower(F.hex("boot_id")).alias("boot_id"))),
    "file_ranges": _all(lambda d: en.file_ranges(d).select(_file_no(), F.col("first.seqnum").alias("first_seqnum"), F.col("last.seqnum").alias("last_seqnum"), F.col("n_entries").cast("bigint").alias("n_entries"))),
    "file_prune_since": lambda spark, sf_dir: (lambda s: en.file_ranges(s.entries()).where(F.col("last.realtime_usec") >= _key(s, AT).realtime_usec).select(_file_no()))(_source(spark, sf_dir)),
    "dedup_files": _duplicated,
    "dedup_entries": lambda spark, sf_dir: (lambda e: _keys(en.dedup_entries(e.union(e))))(_source(spark, sf_dir).entries()),
    "last_seen": _all(lambda d: _keys(en.last_seen(d))),
    "replay_batch": _replay,
    "fanout_matches": _all(lambda d: en.fan_out(d, _subscriptions()).select("subscription", "seqnum")),
}

_J = """WITH j AS (SELECT epoch_us(ts) AS realtime_usec, event_id + 1 AS seqnum, event_id % 4 AS file_no, 4096 + event_id * 64 AS entry_offset, * FROM events),
p AS (SELECT realtime_usec AS rt, seqnum AS sq, file_no AS fn, entry_offset AS eo FROM j WHERE event_id = 500)
"""
_UNIT = "event_type = '{}'"
_CUR = "SELECT realtime_usec, seqnum, file_no, entry_offset FROM j"
_ORDER = " ORDER BY realtime_usec, seqnum, file_no, entry_offset"
_DESC = " ORDER BY realtime_usec DESC, seqnum DESC, file_no DESC, entry_offset DESC"
_BEYOND = ", p WHERE (realtime_usec, seqnum, file_no, entry_offset) {} (rt, sq, fn, eo)"


def _sql(where: str = "true", tail: str = "") -> str:
    return f"{_J}{_CUR} WHERE {where}{tail}"


def _field_sql(first_only: bool) -> str:
    unit = "event_type || '.service'"
    parts = [
        f"SELECT event_id + 1 AS seqnum, CASE WHEN event_id % 5 < 3 THEN '_SYSTEMD_UNIT' WHEN event_id % 5 = 3 THEN 'UNIT' ELSE 'OBJECT_SYSTEMD_UNIT' END AS name, {unit} AS value FROM events",
        "SELECT event_id + 1, 'MESSAGE', props FROM events",
        "SELECT event_id + 1, 'PRIORITY', CASE WHEN event_type = 'error' THEN '3' ELSE '6' END FROM events",
        "SELECT event_id + 1, '_UID', CAST(user_id AS VARCHAR) FROM events",
        "SELECT event_id + 1, '_PID', CAST(event_id AS VARCHAR) FROM events WHERE user_id % 3 <> 0",
    ]
    if not first_only:
        parts.append("SELECT event_id + 1, 'MESSAGE', 'dup' FROM events WHERE event_id % 11 = 0")
    return " UNION ALL ".join(parts)


def _le(x: str) -> str:
    return f"lower(array_to_string(list_transform(range(7, -1, -1), lambda i: substr(lpad(hex({x}), 16, '0'), CAST(i * 2 + 1 AS INT), 2)), ''))"


ORACLE: dict[str, str] = {
    "scan_all": _sql(),
    "match_exact_priority": _sql("event_type = 'error'"),
    "match_exact_and": _sql("event_type = 'error' AND user_id = 7"),
    "match_exact_duplicate_value": _sql("event_id % 11 = 0"),
    "match_present_pid": _sql("user_id % 3 <> 0"),
    "match_unit": _sql("event_type = 'error'"),
    "match_exact_unit_field": _sql("event_type = 'error' AND event_id % 5 < 3"),
    "or_group_two": _sql("(event_type = 'click' AND event_id % 5 < 3) OR (event_type = 'error' AND user_id % 3 <> 0)"),
    "global_and_or_groups": _sql("user_id % 3 <> 0 AND (user_id = 7 OR user_id = 8)"),
    "unit_then_group": _sql("event_type = 'error' OR user_id = 7"),
    "group_then_unit": _sql("event_type = 'error' AND user_id = 7"),
    "two_units": _sql("event_type = 'error' AND event_type = 'click'"),
    "two_units_same": _sql("event_type = 'error'"),
    "no_match": _sql("false"),
    "since": f"{_J}{_CUR}, p WHERE realtime_usec >= rt",
    "until": f"{_J}{_CUR}, p WHERE realtime_usec <= rt",
    "window_point": f"{_J}{_CUR}, p WHERE realtime_usec = rt",
    "after_cursor": _J + _CUR + _BEYOND.format(">"),
    "seek_cursor": _J + _CUR + _BEYOND.format(">="),
    "after_cursor_reverse": _J + _CUR + _BEYOND.format(">") + _DESC + " LIMIT 20",
    "cursor_file_offset": _J + _CUR + _BEYOND.format(">"),
    "cursor_native_exact": _J + _CUR + _BEYOND.format(">"),
    "cursor_native_fallback": f"{_J}{_CUR}, p WHERE realtime_usec > rt",
    "cursor_text_resume": _J + _CUR + _BEYOND.format(">"),
    "head_n": _sql("true", _ORDER + " LIMIT 10"),
    "tail_n": _sql("true", _DESC + " LIMIT 10"),
    "reverse_all_limit": _sql("user_id % 3 <> 0", _DESC + " LIMIT 500"),
    "limit_zero": _sql("false"),
    "tail_unit_window": _sql("event_type = 'error' AND realtime_usec BETWEEN (SELECT realtime_usec FROM j WHERE event_id = 100) AND (SELECT realtime_usec FROM j WHERE event_id = 900)", _DESC + " LIMIT 50"),
    "get_first_message": "SELECT event_id + 1 AS seqnum, props AS message FROM events WHERE event_id % 11 = 0",
    "explode_fields": _field_sql(False),
    "first_per_name": _field_sql(True),
    "field_count": "SELECT event_id + 1 AS seqnum, CAST(4 + CASE WHEN user_id % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_fields FROM events",
    "wide_view": "SELECT event_id + 1 AS seqnum, CASE WHEN event_type = 'error' THEN '3' ELSE '6' END AS priority, CASE WHEN user_id % 3 <> 0 THEN CAST(event_id AS VARCHAR) END AS pid FROM events",
    "cursor_text": f"SELECT event_id + 1 AS seqnum, 'SJ1:04' || lower(lpad(hex(event_id % 4), 32, '0')) || {_le('4096 + event_id * 64')} || {_le('event_id + 1')} || {_le('epoch_us(ts)')} AS cursor FROM events",
    "entry_columns": "SELECT event_id + 1 AS seqnum, epoch_us(ts) AS realtime_usec, epoch_us(ts) - 1704067200000000 AS monotonic_usec, md5(CAST(user_id % 8 AS VARCHAR)) AS boot_id FROM events",
    "file_ranges": f"{_J}SELECT file_no, arg_min(seqnum, (realtime_usec, seqnum, entry_offset)) AS first_seqnum, arg_max(seqnum, (realtime_usec, seqnum, entry_offset)) AS last_seqnum, count(*) AS n_entries FROM j GROUP BY file_no",
    "file_prune_since": f"{_J}SELECT file_no FROM j, p GROUP BY file_no, rt HAVING max(realtime_usec) >= rt",
    "dedup_files": _sql(),
    "dedup_entries": _sql(),
    "last_seen": _sql("true", _DESC + " LIMIT 1"),
    "replay_batch": f"{_J.rstrip()}, u AS (SELECT realtime_usec AS rt2, seqnum AS sq2, file_no AS fn2, entry_offset AS eo2 FROM j WHERE event_id = 700) {_CUR}, p, u WHERE (realtime_usec, seqnum, file_no, entry_offset) > (rt, sq, fn, eo) AND (realtime_usec, seqnum, file_no, entry_offset) <= (rt2, sq2, fn2, eo2){_ORDER} LIMIT 65",
    "fanout_matches": "SELECT 'errors' AS subscription, event_id + 1 AS seqnum FROM events WHERE event_type = 'error' UNION ALL SELECT 'user7', event_id + 1 FROM events WHERE user_id = 7 UNION ALL SELECT 'dup_or_purchase', event_id + 1 FROM events WHERE event_id % 11 = 0 OR (event_type = 'purchase' AND event_id % 5 < 3)",
}
