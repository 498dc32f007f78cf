"""Files, queries over files, seals and live tailing, on synthetic journals."""

import random

import numpy as np
import pyarrow as pa
import pytest

from brindle.operators.journal import Journal
from brindle.operators.query import JournalQuery
from brindle.operators.seal import Fsprg, VerificationKey
from brindle.plans.cursor import Cursor
from brindle.plans.model import ENTRY, Corrupt, InvalidQuery, JournalError, Key, LimitExceeded, Limits, NotFound, Unsupported
from brindle.sources import discovery
from brindle.sources import synthetic as syn
from brindle.sources.entries import Entries
from brindle.sources.format import JournalFile


def where(rows):
    return [(r["file_id"][0], r["seqnum"] - 1) for r in rows]


def test_resume_and_duplicate_roots(spark, tmp_path):
    syn.write(f"{tmp_path}/synthetic.journal", ["alpha", "beta", "gamma"])
    j = Journal.open_dirs(spark, [str(tmp_path), str(tmp_path)])
    rows = j.query().collect()
    assert len(rows) == 3
    c = Cursor.parse(str(Cursor.of(rows[0])))
    assert where(j.query().after_cursor(c).collect()) == [(7, 1), (7, 2)]
    assert len(j.seek_cursor(c).collect()) == 3
    assert where(j.query().after_cursor(Cursor.parse(f"t={rows[0]['realtime_usec']:x};s={syn.ident(58).hex()};i=1")).collect()) == [(7, 1), (7, 2)]
    assert j.query().match_unit("alpha").limit(0).after_cursor(Cursor.parse("SJ1:01" + "00" * 24)).collect() == []
    with pytest.raises(NotFound):
        j.query().after_cursor(Cursor.parse("SJ1:01" + "00" * 24)).to_df()
    with pytest.raises(InvalidQuery):
        j.query().since_realtime(2).until_realtime(1).to_df()


def test_two_files_or_limit_reverse(spark, tmp_path):
    syn.write(f"{tmp_path}/synthetic.journal", ["alpha", "beta"])
    syn.write(f"{tmp_path}/later.journal", ["gamma", "alpha"], 9)
    j = Journal.open_dir(spark, str(tmp_path))

    def q():
        return j.query().or_group(lambda g: g.match_exact("_SYSTEMD_UNIT", "alpha")).or_group(lambda g: g.match_exact("_SYSTEMD_UNIT", "gamma"))

    assert where(q().limit(2).collect()) == [(7, 0), (9, 0)]
    assert where(q().reverse().limit(2).collect()) == [(9, 1), (9, 0)]
    assert where(j.query().match_exact("UNIT", "alpha").collect()) == [(7, 0), (9, 1)]
    assert where(j.query().since_realtime(syn.BASE + 80_000).collect()) == [(9, 0), (9, 1)]


@pytest.mark.parametrize("kw", [{}, {"compact": True}, {"keyed": True}, {"compression": "lz4"}, {"compression": "zstd"}, {"compression": "xz"}, {"compact": True, "keyed": True, "compression": "zstd"}])
def test_layouts(tmp_path, kw):
    p = f"{tmp_path}/a.journal"
    syn.write(p, ["alpha", "beta", "alpha"], **kw)
    with JournalFile(p) as f:
        rows = list(f.entries())
        assert [r[-1] for r in rows] == [syn.unit_fields(7, i, u) for i, u in enumerate(["alpha", "beta", "alpha"])]
        assert f.lookup(b"UNIT=alpha") == {rows[0][3], rows[2][3]}
        assert f.lookup(b"UNIT=none") == set()


def test_mutated_files_never_crash(tmp_path):
    p = f"{tmp_path}/a.journal"
    syn.write(p, ["alpha", "beta"])
    raw, rnd = open(p, "rb").read(), random.Random(5)
    for _ in range(300):
        b = bytearray(raw)
        for _ in range(rnd.randrange(1, 6)):
            b[rnd.randrange(len(b))] = rnd.randrange(256)
        open(p, "wb").write(b[: rnd.choice([len(b), rnd.randrange(len(b))])])
        try:
            with JournalFile(p, Limits(max_chain_steps=100)) as f:
                list(f.entries())
        except JournalError:
            pass


def test_seal(spark, tmp_path):
    seed = bytes(range(12))
    p = f"{tmp_path}/a.journal"
    syn.write(p, ["alpha", "beta"], seal=Fsprg(seed))
    j = Journal.open_dir(spark, str(tmp_path))
    assert [(r.ok, r.n_tags) for r in j.verify_seal(seed.hex() + "/1-1").collect()] == [(True, 2)]
    b = bytearray(open(p, "rb").read())
    b[b.index(b"synthetic-message")] ^= 1
    open(p, "wb").write(b)
    with pytest.raises(Corrupt):
        j.verify_seal(seed.hex() + "/1-1")


@pytest.mark.parametrize("text", ["", "00", "0" * 24, "0" * 24 + "/1", "0" * 23 + "g/1-1", "0" * 24 + "/1-0", "0" * 24 + "/ffffffffffffffff-2", "0" * 24 + "/1-x"])
def test_broken_keys(text):
    with pytest.raises(InvalidQuery):
        VerificationKey.parse(text)


def test_key():
    k = VerificationKey.parse(" 000102-030405-060708-090a0B/2-10 ")
    assert (k.seed, k.start_usec, k.interval_usec) == (bytes(range(12)), 32, 16)


@pytest.mark.parametrize("first_array", [1, 3, 64])
def test_slots_and_seek(tmp_path, first_array):
    """Any slot of a chain of arrays is reached, and binary search finds what a scan finds."""
    p = f"{tmp_path}/a.journal"
    for n in (0, 1, 5, 40):
        syn.write(p, ["alpha"] * n, first_array=first_array)
        with JournalFile(p) as f, JournalFile(p, Limits(seek_realtime=False)) as scan:
            every = list(f.entry_offsets())
            assert len(every) == n and f.last_entry() == (every[-1] if n else None)
            for i in range(n + 1):
                assert list(f.entry_offsets(i)) == every[i:] and list(f.entry_offsets(i, i + 3)) == every[i : i + 3]
            for t in range(syn.BASE + 69_990, syn.BASE + 70_000 + n * 100 + 50, 50):
                assert list(f.entries(since=t)) == list(scan.entries(since=t)) and list(f.entries(until=t)) == list(scan.entries(until=t))


def test_index_look_ups(tmp_path):
    """Each branch is looked up for itself; a broken table or a branch without terms means a scan."""
    p = f"{tmp_path}/a.journal"
    syn.write(p, ["alpha", "beta", "alpha", "gamma"])
    with JournalFile(p) as f:
        e = list(f.entry_offsets())
        assert f.branches([[b"UNIT=alpha"], [b"UNIT=gamma", b"PRIORITY=4"]]).tolist() == [e[0], e[2], e[3]]
        assert f.branches([[b"UNIT=alpha", b"PRIORITY=3"], [b"UNIT=none"]]).tolist() == [e[2]]
        assert f.branches([[b"UNIT=alpha"], []]) is None
    raw = bytearray(open(p, "rb").read())
    raw[288:320] = b"\x01" * 32
    open(p, "wb").write(raw)
    with JournalFile(p) as f:
        assert f.branches([[b"UNIT=alpha"]]) is None


def test_pruned_files_may_be_gone(spark, tmp_path):
    syn.write(f"{tmp_path}/synthetic.journal", ["old"])
    syn.write(f"{tmp_path}/recent.journal", ["recent"], 9)
    j = Journal.open_dir(spark, str(tmp_path), Limits(max_open_files=1, mmap_policy="never"))
    old = Cursor.of(j.query().match_unit("old").collect()[0])
    (tmp_path / "synthetic.journal").unlink()
    assert where(j.query().since_realtime(syn.BASE + 90_000).collect()) == [(9, 0)]
    assert where(j.query().after_cursor(old).collect()) == [(9, 0)]


def test_low_memory_merge_and_resume(spark, tmp_path):
    syn.write(f"{tmp_path}/synthetic.journal", ["alpha"])
    syn.write(f"{tmp_path}/later.journal", ["beta", "alpha"], 9)
    j = Journal.open_dir(spark, str(tmp_path), Limits(max_open_files=1, mmap_policy="never"))
    rows = j.query().match_unit("alpha").collect()
    assert where(rows) == [(7, 0), (9, 1)]
    first = Cursor.parse(str(Cursor.of(rows[0])))
    assert where(j.query().match_unit("alpha").after_cursor(first).collect()) == [(9, 1)]
    assert where(j.query().match_unit("alpha").reverse().collect()) == [(9, 1), (7, 0)]


def test_headers(tmp_path):
    p = tmp_path / "a.journal"
    p.write_bytes(b"x" * 100)
    with pytest.raises(Corrupt):
        JournalFile(str(p))
    p.write_bytes(b"x" * 300)
    with pytest.raises(Unsupported):
        JournalFile(str(p))
    syn.write(str(p), ["alpha"], state=2)
    with JournalFile(str(p)) as f, JournalFile(str(p), Limits(mmap_policy="never")) as g:
        assert f.map is not None and g.map is None and list(f.entries()) == list(g.entries())
    with pytest.raises(InvalidQuery):
        Limits(mmap_policy="x").check()


def test_roots(tmp_path, monkeypatch):
    monkeypatch.setattr(discovery.sys, "platform", "plan9")
    with pytest.raises(Unsupported):
        discovery.default_roots()
    monkeypatch.setattr(discovery.sys, "platform", "linux")
    assert discovery.default_roots() == ["/run/log/journal", "/var/log/journal"]
    for i in range(3):
        syn.write(f"{tmp_path}/{i}.journal", ["alpha"], i)
    with pytest.raises(LimitExceeded):
        discovery.list_files([str(tmp_path)], Limits(max_journal_files=2))


def test_builder_against_python(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(120):
        fields = [(rnd.choice("ABC"), bytes([rnd.randrange(3)])) for _ in range(rnd.randrange(4))]
        rows.append((i // 7, i % 5, bytes(16), i, 0, bytes(16), None, None, None, None, [{"name": n, "value": v} for n, v in fields]))
    df = spark.createDataFrame(rows, ENTRY).cache()
    for _ in range(12):
        q = JournalQuery(Entries(df))
        for _ in range(rnd.randrange(4)):
            n, v = rnd.choice("ABC"), bytes([rnd.randrange(3)])
            rnd.choice([lambda: q.match_exact(n, v), lambda: q.match_present(n), lambda: q.or_group(lambda g: g.match_exact(n, v).match_present("A")), lambda: q.or_group(lambda g: g.match_exact(n, v))])()
        got = [Key.of(r) for r in q.collect()]
        want = sorted(Key(r[0], r[1], r[2], r[3]) for r in rows if q.matches([(f["name"], f["value"]) for f in r[-1]]))
        assert got == want


@pytest.mark.parametrize("kw", syn.LAYOUTS)
def test_long_files_in_bounded_memory(spark, tmp_path, monkeypatch, kw):
    """Batches, forgotten DATA objects and lists in many arrays; a prefix keeps its place; scans are dealt by slots."""
    import tracemalloc

    from brindle.sources import datasource

    monkeypatch.setattr(syn, "BATCH", 64)
    monkeypatch.setattr(syn, "HELD", 100)
    monkeypatch.setattr(syn, "PENDING", 200)
    fields = [[("A", b"1"), ("PID", str(i).encode()), ("B", str(i % 390).encode()), ("A", b"1")][: i % 5] for i in range(1000)]
    heads = [(i + 1, syn.BASE + i, i, syn.ident(i), i) for i in range(1000)]
    p, short = f"{tmp_path}/synthetic.journal", f"{tmp_path}/short"
    for path, n in ((p, 1000), (short, 300)):
        syn.write(path, entries=fields[:n], heads=heads[:n], first_array=4, buckets=8, **kw)
    with JournalFile(p) as f, JournalFile(short) as g:
        rows = list(f.entries())
        assert [r[-1] for r in rows] == fields and [r[1] for r in rows] == list(range(1, 1001))
        assert [r[3] for r in g.entries()] == [r[3] for r in rows[:300]]
        assert len(f.data_objects(b"B=3")) > 1
        for text in (b"A=1", b"B=3", b"PID=77", b"PID=none"):
            name, value = text.split(b"=")
            held = [(name.decode(), value) in x for x in fields]
            assert f.lookup(text) == {r[3] for r, x in zip(rows, held) if x}
            assert sum(n for n, _, _ in f.data_objects(text)) == sum(held)
    monkeypatch.setattr(datasource, "SLOTS", 300)
    parts = datasource.BatchReader({"path": str(tmp_path)})
    assert [(x.start, x.end) for x in parts.partitions()] == [(0, 300), (300, 600), (600, 900), (900, None)]
    assert [y for x in parts.partitions() for b in parts.read(x) for y in b.column("seqnum").to_pylist()] == list(range(1, 1001))
    monkeypatch.setattr(syn, "BATCH", 1024)
    monkeypatch.setattr(syn, "HELD", 2048)
    monkeypatch.setattr(syn, "PENDING", 4096)
    most = []
    for n in (8, 40):  # five times as many entries need no more memory
        tracemalloc.start()
        with_ids = syn.Writer(p, (syn.ident(1),) * 3, syn.ident(2), buckets=64, **kw)
        for k in range(n):
            numbers = np.arange(k * 1024, (k + 1) * 1024)
            with_ids.add((numbers, numbers, numbers, bytes(16 * 1024), numbers), np.arange(1025), pa.array([b"PID=%d" % i for i in numbers], pa.binary()))
        with_ids.close((1, n * 1024, 0, 0))
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert most[1] < 1.3 * most[0]


def test_many_hashes():
    from brindle.functions.hashes import jenkins64, jenkins64_many, siphash24, siphash24_many

    xs = [bytes((i * 7 + k) % 256 for k in range(n)) for n in range(40) for i in (1, 2)]
    assert siphash24_many(syn.ident(3), xs).tolist() == [siphash24(syn.ident(3), x) for x in xs]
    assert jenkins64_many(xs).tolist() == [jenkins64(x) for x in xs]
