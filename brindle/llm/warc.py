"""WARC archives and their index of capture histories.

Archives are written as rows of compressed blocks, one gzip member a record, through Spark's own writer, so that any
store that Spark writes to will do; the blocks of an archive, one after the other, are a .warc.gz file. Reading the
blocks back gives records, and an index line for each. Lines are sorted where they arise: a run. Runs are cut, as they
are, at the edges of ranges of the global order; the slices of a range meet in one task, where a loser tree merges them
without sorting anything again. Captures of a URL are numbered across ranges.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut, remove, shared_folder

#: Bytes of compressed records in a block row.
BLOCK = 4 << 20
#: Lines of a run: what a task sorts at once.
RUN = 1 << 16
#: Lines of a range, and most ranges. Beyond LINES * RANGES lines ranges grow.
LINES, RANGES = 8192, 8192
#: Expected sampled lines a range, from which the edges are taken: at most SAMPLES * RANGES lines reach the driver.
SAMPLES = 16
#: Most repeated payloads (28 bytes each) that are sent to every task; more of them are joined by a salted shuffle.
SENT = 200_000
#: A payload's rows are dealt over so many tasks where they are shuffled.
SALTS = 16
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
#: Ids from and up to which a capture's time is EPOCH plus that many seconds; others are at EPOCH.
SECONDS = (-(10**9), 2 * 10**11)
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Host, port, path and query of a URL in small letters.
URL = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"
_URL, _SMALL = re.compile(URL), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
INDEX = "key string, ts string, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, block int, offset bigint, run int"
_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_ARROW = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in (x.split() for x in INDEX.split(", "))])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels reversed, without scheme, user, www, default port and fragment; path; query parts sorted. A-Z become
    small. What has no host part is its own key; null is the empty one."""
    u = (url or "").strip(" \t").translate(_SMALL)
    m = _URL.match(u)
    if not m:
        return u
    host, port, path, query = re.sub(r"^www[0-9]*\.", "", m[1]), m[2] or "", m[3] or "/", m[4] or ""
    port = "" if port in ("", "80", "443") else f":{port}"
    return ",".join(reversed(host.split("."))) + port + ")" + path + (f"?{'&'.join(sorted(query.split('&')))}" if query else "")


def _line(s: str | None) -> str:
    """A header value: no line ends."""
    return re.sub(r"[\r\n]+", " ", s or "")


def captured(page_id: int | None) -> datetime:
    return EPOCH + timedelta(seconds=page_id) if page_id is not None and SECONDS[0] <= page_id <= SECONDS[1] else EPOCH


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, at: datetime) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head alone; the head's Content-Length is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Date: {at.strftime('%Y-%m-%dT%H:%M:%SZ')}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower case names) and content of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip(" \t")) for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:]))
    return fields, rest[: int(fields["content-length"])]


def members(block: bytes, window: int = 1 << 14) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each gzip member of a block. The block is fed by windows: a member costs its own length."""
    view, at = memoryview(block), 0
    while at < len(block):
        d, start, parts = zlib.decompressobj(31), at, []
        while not d.eof:
            if at >= len(block):
                raise ValueError(f"a member at {start} isn't closed")
            fed = view[at : at + window]
            parts.append(d.decompress(fed))
            at += len(fed) - len(d.unused_data)
        yield start, parts[0] if len(parts) == 1 else b"".join(parts)


def _marked(rows: DataFrame, least: int, sent: int) -> DataFrame:
    """rows (id, url, html, sha) and refers_to, the largest id of a repeated payload where the row's is another.

    Digests and ids alone are aggregated. What comes out, one row for each payload that is repeated, is counted: up to
    `sent` of them go to every task and no text is shuffled; more are met by payload and salt, so that a payload with a
    third of all rows is dealt over SALTS tasks.
    """
    sums = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    repeated = cut(sums.where("n > 1").select(F.col("sha").alias("of"), "first"))
    if repeated.count() <= sent:
        met = rows.join(F.broadcast(repeated), rows["sha"] == repeated["of"], "left")
    else:
        salted = repeated.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mine = rows.withColumn("__s", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
        met = mine.join(salted, (mine["sha"] == salted["of"]) & (mine["__s"] == salted["s"]), "left")
    return met.select("id", "url", "html", "sha", F.when(F.col("id").isNull() | (F.col("id") < F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, sent: int = SENT) -> None:
    """Archives of all rows at path. Rows whose payload (null: empty) has at least `least` bytes and equals that of a row
    with a larger id become revisits of the row with the largest; rows that repeat that id are responses too. Among rows
    with a null id alone all are responses; rows with a null id refer to the largest id of their payload. An empty table
    gives no archive."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, no, held, size = f"{uuid.uuid4().hex}.warc.gz", 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([no], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["archive", "block", "bytes"])

        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                for i, url, text, sha, ref in zip(*(b.column(c).to_pylist() for c in ("id", "url", "html", "sha", "refers_to"))):
                    c = zlib.compressobj(3, zlib.DEFLATED, 31)
                    raw = c.compress(record(i, url, text.encode("utf-8"), base64.b32encode(sha).decode(), ref, captured(i))) + c.flush()
                    held.append(raw)
                    size += len(raw)
                    if size >= BLOCK:
                        yield out()
                        no, held, size = no + 1, [], 0
        if held:
            yield out()

    _marked(rows, least, sent).mapInArrow(run, "archive string, block int, bytes binary").write.mode("overwrite").option("compression", "none").parquet(path)


def _order(r: tuple) -> tuple:
    """The global order: URL key, time, id (null first), digest; then the place, so that repeated rows can be parted."""
    return (r[0], r[1], r[2] is not None, r[2] or 0, r[5], r[8], r[9], r[10])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read(archives: DataFrame) -> DataFrame:
    """One index line for each record: the columns of INDEX. Lines come in sorted runs of at most RUN lines; run numbers
    those of a task. No archive gives no line; a response whose payload isn't what its digest says raises."""
    number = lambda s: int(s[len("<urn:page:") : -1]) if s and s != "<urn:page:>" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_of = re.compile(rb"(?i)content-length:\s*(\d+)")
        rows: list[tuple] = []
        made = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, made
            rows.sort(key=_order)  # a run, sorted where it arises
            for at in range(0, len(rows), 8192):
                yield _batch([(*r, made) for r in rows[at : at + 8192]], _ARROW)
            rows, made = [], made + 1

        for b in batches:
            for archive, no, block in zip(*(b.column(c) for c in ("archive", "block", "bytes"))):
                archive, no = archive.as_py(), no.as_py()
                for offset, raw in members(block.as_py()):
                    h, body = parse(raw)
                    head, _, payload = body.partition(b"\r\n\r\n")
                    size = int(size_of.search(head)[1])
                    sha = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response" and (len(payload) != size or digest(payload) != sha):
                        raise ValueError(f"{archive}, block {no}, offset {offset}: the payload isn't what its digest says")
                    url = h["warc-target-uri"]
                    rows.append((url_key(url), h["warc-date"], number(h["warc-record-id"]), url, size, sha, h["warc-type"], number(h.get("warc-refers-to")), archive, no, offset))
                    if len(rows) >= RUN:
                        yield from flush()
        if rows:
            yield from flush()

    return archives.mapInArrow(run, INDEX)


class LoserTree:
    """k-way merge of sorted iterators: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterator], order) -> None:
        self.runs, self.order, self.k = runs, order, max(1, len(runs))
        self.head: list = [next(r, None) for r in runs] or [None]
        self.rank: list = [None if x is None else order(x) for x in self.head]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; an exhausted run goes last, ties go to the earlier run."""
        x, y = self.rank[a], self.rank[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or x == y and a < b

    def _play(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while (x := self.head[w := self.tree[0]]) is not None:
            yield x
            self.head[w] = y = next(self.runs[w], None) if self.runs else None
            self.rank[w] = None if y is None else self.order(y)
            self._play(w)


def _edges(index: DataFrame, n: int, lines: int) -> list[tuple]:
    """First places of the ranges but the first, from lines picked by hash; at most SAMPLES * RANGES lines expected."""
    ranges = min(RANGES, -(-n // lines))
    if ranges <= 1:
        return []
    part = F.pmod(F.xxhash64("archive", "block", "offset"), F.lit(1 << 20)) / float(1 << 20)
    some = sorted(map(_order, index.where(part < SAMPLES * ranges / n).collect()))
    return [some[i * len(some) // ranges] for i in range(1, ranges) if some] if len(some) >= ranges else some[1:]


def _slices(index: DataFrame, edges: list[tuple]) -> DataFrame:
    """(range, lines): each run, cut at the edges and where Arrow batches end; a piece is an Arrow stream."""
    sent = index.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value
        for b in batches:
            orders = list(map(_order, zip(*(b.column(c).to_pylist() for c in _NAMES))))
            of = b.column("run").to_numpy()
            ends = [*(int(i) + 1 for i in np.flatnonzero(of[1:] != of[:-1])), len(of)]
            ranges, blobs, s = [], [], 0
            for end in ends:
                while s < end:
                    r = bisect_right(at, orders[s])
                    e = bisect_left(orders, at[r], s, end) if r < len(at) else end
                    sink = pa.BufferOutputStream()
                    piece = pa.RecordBatch.from_arrays([b.column(c).slice(s, e - s) for c in _NAMES], _NAMES)
                    with pa.ipc.new_stream(sink, piece.schema) as w:
                        w.write_batch(piece)
                    ranges.append(r)
                    blobs.append(sink.getvalue().to_pybytes())
                    s = e
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(blobs, pa.binary())], ["range", "lines"])

    return index.mapInArrow(run, "range int, lines binary")


def _merge(slices: DataFrame) -> DataFrame:
    """Lines in global order within their range: INDEX, range, place (in the range), seq (of the URL, in the range).

    Each slice is sorted as it is, and the tree holds one decoded slice for each run of the range at most.
    """
    names = [*_NAMES, "range", "place", "seq"]
    schema = pa.schema([*_ARROW, ("range", pa.int32()), ("place", pa.int64()), ("seq", pa.int64())])

    def lines(blob: bytes) -> Iterator[tuple]:
        for b in pa.ipc.open_stream(blob):
            yield from zip(*(b.column(c).to_pylist() for c in _NAMES))

    def merged(no: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows, place, seq, last = [], 0, 0, None
        for r in LoserTree([lines(x) for x in blobs], _order):
            seq = seq + 1 if r[0] == last else 1
            last = r[0]
            rows.append((*r, no, place, seq))
            place += 1
            if len(rows) == 8192:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, held = None, []
        for b in batches:
            for r, blob in zip(b.column("range").to_pylist(), b.column("lines")):
                if held and r != no:
                    yield from merged(no, held)
                    held = []
                no = r
                held.append(blob.as_py())
        if held:
            yield from merged(no, held)

    assert names == schema.names
    return slices.repartition("range").sortWithinPartitions("range").mapInArrow(run, f"{INDEX}, range int, place bigint, seq bigint")


def histories(index: DataFrame, lines: int = LINES) -> DataFrame:
    """index (of read(), kept by a checkpoint or table), and for each line place, its number in the order of all (URL key,
    time, id, digest), and seq, the number of the capture among those of its URL, from 1.

    Ranges part the whole order, so one URL with a third of all captures, or one row that is repeated so often, lies in
    many tasks; its numbers go on from range to range. A row of counts for each of at most RANGES ranges reaches the
    driver. An empty index gives an empty one.
    """
    spark = index.sparkSession
    merged = cut(_merge(_slices(index, _edges(index, index.count(), lines))))
    ends = merged.groupBy("range").agg(F.min_by("key", "place").alias("first"), F.max_by("key", "place").alias("last"), F.max_by("seq", "place").alias("tail"), F.count("*").alias("n"))
    shift, place, carried, last = [], 0, 0, None
    for r in sorted(ends.collect(), key=lambda r: r["range"]):
        before = carried if r["first"] == last else 0
        shift.append((r["range"], place, r["first"], before))
        place += r["n"]
        carried = r["tail"] + (before if r["first"] == r["last"] else 0)
        last = r["last"]
    moved = F.broadcast(spark.createDataFrame(shift, "range int, __place bigint, __first string, __before bigint"))
    out = merged.join(moved, "range")
    seq = F.col("seq") + F.when(F.col("key") == F.col("__first"), F.col("__before")).otherwise(0)
    return out.select(*(n for n in _NAMES if n != "run"), (F.col("place") + F.col("__place")).alias("place"), seq.alias("seq"))


def op9(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, seq (the capture's number among those of its URL).

    Archives go to the shared folder, are read back by their blocks once, and are removed when the index is kept. Null
    html is an empty payload, null and broken URLs have their own keys, repeated rows are records of their own, a null
    id is no one's response, an empty table gives no row; other columns aren't read.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages.select("page_id", "url", "html"), path)
    index = cut(read(spark.read.parquet(path)))
    remove(spark, path)
    return histories(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "seq")
