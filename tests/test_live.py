"""Live tailing on synthetic journals: bounded cycles, queue policies, replay, catch-up and hand-over, broken files."""

import os

import pytest

from brindle.operators.journal import Journal
from brindle.plans.cursor import Cursor
from brindle.plans.model import Corrupt, InvalidQuery, JournalError, LimitExceeded, Limits, Transient
from brindle.plans.predicates import Filter
from brindle.sources import synthetic as syn
from brindle.streaming.live import Closed, LiveJournal, Subscription

A, B, C = "alpha.service", "beta.service", "gamma.service"


@pytest.fixture
def open_live(spark, tmp_path):
    opened = []

    def make(batch=64, channel=64, policy="block", **kw):
        live = LiveJournal.open_dir(spark, str(tmp_path), Limits(max_live_batch_entries=batch, live_channel_capacity=channel, queue_full_policy=policy, **kw))
        opened.append(live)
        return live

    yield make
    for live in opened:
        live.stop()


@pytest.fixture
def put(tmp_path):
    return lambda units, seed=7, name="synthetic.journal": syn.write(f"{tmp_path}/{name}", units, seed)


def unit(u):
    return Filter().match_unit(u)


def place(row):
    return row["file_id"][0], row["seqnum"] - 1


def until(live, n, most=40):
    """Cycles until something is delivered."""
    for _ in range(most):
        if got := live.poll_once():
            assert got == n
            return
    raise AssertionError("nothing was delivered")


def test_fan_out(open_live, put):
    put([A, B])
    live = open_live()
    one, two, other = live.subscribe(unit(A)), live.subscribe(unit(A)), live.subscribe(unit(B))
    assert live.poll_once() == 0 and one.try_recv() is None  # what was there isn't replayed
    put([A, B, A, B, C])
    until(live, 3)
    a, b = one.recv(1), two.recv(1)
    assert place(a) == (7, 2) and Cursor.of(a) == Cursor.of(b) and place(other.recv(1)) == (7, 3)


def test_large_appends_come_in_bounded_batches(open_live, put):
    put([A])
    live = open_live(1, 1)
    s = live.subscribe(unit(A))
    put([A] * 3)
    assert live.poll_once() == 1 and place(s.recv(1)) == (7, 1)
    assert live.poll_once() == 1 and place(s.recv(1)) == (7, 2)


def test_a_full_queue_stops_the_stream_and_not_the_caller(open_live, put):
    put([A])
    live = open_live(4, 4)
    s, quick = live.subscribe(unit(A)), live.subscribe(unit(A))
    put([A] * 20)
    got, seen = [], []
    for _ in range(60):
        live.poll_once()
        while (r := quick.try_recv()) is not None:
            seen.append(place(r)[1])
        if (r := s.try_recv()) is not None:  # one a cycle: slower than the stream
            got.append(place(r)[1])
        assert s.queue.qsize() <= 4 and len(s.parked) <= 4
        if len(got) == 19:
            break
    assert got == list(range(1, 20)) == seen


def test_disconnect_and_drop(open_live, put):
    put([A])
    live = open_live(2, 1, "disconnect")
    s = live.subscribe(unit(A))
    put([A] * 3)
    assert live.poll_once() == 1 and place(s.recv(1)) == (7, 1)
    with pytest.raises(Closed):
        s.try_recv()
    s = Subscription(Filter(), Limits(live_channel_capacity=1, max_live_batch_entries=1, queue_full_policy="drop_newest"), None, None, None, False)
    assert s.put({"n": 1}) and not s.put({"n": 2}) and not s.closed and s.recv(1) == {"n": 1}
    with pytest.raises(InvalidQuery):
        Limits(live_channel_capacity=1).check_live()


def test_replay_comes_in_bounded_batches(open_live, put):
    put([A] * 3)
    live = open_live(1, 1)
    s = live.subscribe_from(unit(A), since_realtime=0)
    for i in range(3):
        assert live.poll_once() == 1 and place(s.recv(1)) == (7, i)


def test_replay_has_no_cap_by_default(open_live, put):
    put([A] * 4097)
    live = open_live(1024, 1024)
    s, got = live.subscribe_from(unit(A), since_realtime=0), []
    while len(got) < 4097:
        n = live.poll_once()
        assert n
        got += [s.recv(1)["seqnum"] for _ in range(n)]
    assert got == list(range(1, 4098))


def test_replay_leaves_the_live_tail_alone(open_live, put):
    put([A])
    live = open_live()
    s = live.subscribe(unit(A))
    put([A, A])
    absent = live.subscribe_from(unit("absent.service"), since_realtime=0)
    until(live, 1)
    assert place(s.recv(1)) == (7, 1) and absent.try_recv() is None


def test_replay_then_catch_up_then_live(open_live, put):
    put([A, A])
    live = open_live(1, 4, max_live_replay_entries=2)
    s = live.subscribe_from(unit(A), since_realtime=0)
    put([A], 9, "later.journal")
    assert live.poll_once() == 1 and place(s.recv(1)) == (7, 0)
    assert live.poll_once() == 1 and place(s.recv(1)) == (7, 1)
    until(live, 1)
    assert place(s.recv(1)) == (9, 0)
    put([A], 3, "early.journal")  # a new file with older times, after the replay
    put([A, A], 9, "later.journal")
    seen = []
    for _ in range(20):
        live.poll_once()
        while (r := s.try_recv()) is not None:
            seen.append(place(r))
        if len(seen) == 2:
            break
    assert sorted(seen) == [(3, 0), (9, 1)] and not s.replaying
    assert live.poll_once() == 0 and s.try_recv() is None


def test_live_is_not_blocked_by_anothers_replay(open_live, put):
    put([A, A])
    put([C], 9, "later.journal")
    live = open_live(1, 4)
    a, b = live.subscribe_from(unit(A), since_realtime=0), live.subscribe(unit(B))
    put([C, B], 9, "later.journal")
    assert live.poll_once() == 1 and place(b.recv(1)) == (9, 1) and a.try_recv() is None
    assert live.poll_once() == 1 and place(a.recv(1)) == (7, 0)


def test_replay_cap_counts_what_matches(open_live, put):
    put([B, A])
    live = open_live(1, 1, max_live_replay_entries=1)
    s = live.subscribe_from(unit(A), since_realtime=0)
    assert live.poll_once() == 1 and place(s.recv(1)) == (7, 1)


def test_replay_cap_is_an_error(open_live, put):
    put([A, A])
    live = open_live(1, 1, max_live_replay_entries=1)
    s = live.subscribe_from(unit(A), since_realtime=0)
    assert live.poll_once() == 1 and place(s.recv(1)) == (7, 0)
    with pytest.raises(LimitExceeded) as e:
        live.poll_once()
    assert e.value.limit == 1


def test_replay_after_a_cursor_of_two_files(spark, tmp_path, open_live, put):
    put([A])
    put([B, A], 9, "later.journal")
    live = open_live(1, 1, max_open_files=1, mmap_policy="never")
    first = Journal.open_dir(spark, str(tmp_path)).query().limit(1).collect()[0]
    s = live.subscribe_from(unit(A), after_cursor=Cursor.of(first))
    until(live, 1)
    assert place(s.recv(1)) == (9, 1)


def broken(tmp_path, name="corrupt.journal~"):
    raw = bytearray((tmp_path / "synthetic.journal").read_bytes())
    raw[24] = (raw[24] + 101) % 256  # another file id
    raw[int.from_bytes(raw[176:184], "little")] = 0  # no entry array
    (tmp_path / name).write_bytes(raw)


def test_broken_files_are_passed_over(tmp_path, open_live, put):
    put([A])
    broken(tmp_path)
    live = open_live(include_tilde_files=True)
    s, old = live.subscribe(unit(A)), live.subscribe_from(unit(A), since_realtime=0)
    put([A, A])
    until(live, 1)
    assert place(s.recv(1)) == (7, 1)
    got = []
    for _ in range(10):
        live.poll_once()
        while (r := old.try_recv()) is not None:
            got.append(place(r))
    assert got == [(7, 0), (7, 1)]


def test_only_broken_files_fail(spark, tmp_path, put):
    put([A])
    broken(tmp_path)
    os.remove(tmp_path / "synthetic.journal")
    with pytest.raises((Corrupt, Transient)):
        Journal.open_dir(spark, str(tmp_path), Limits(include_tilde_files=True)).live()


def test_run_ends_with_its_subscriptions(open_live, put):
    import asyncio
    import threading

    put([A])
    live = open_live(poll_interval_ms=10)
    s = live.subscribe(unit(A))
    t = threading.Thread(target=live.run)
    t.start()
    put([A] * 3)

    async def two():
        got = []
        async for r in s.stream():
            got.append(place(r))
            if len(got) == 2:
                s.close()
        return got

    assert asyncio.run(two()) == [(7, 1), (7, 2)]
    t.join(60)
    assert not t.is_alive()


def test_a_failure_is_no_result(spark, tmp_path, put):
    put([A])
    live = LiveJournal.open_dir(spark, str(tmp_path), Limits(max_live_batch_entries=4, live_channel_capacity=4), mode="FAILFAST")
    try:
        live.subscribe(unit(A))
        put([A] * 3)
        raw = bytearray((tmp_path / "synthetic.journal").read_bytes())
        raw[int.from_bytes(raw[176:184], "little")] = 0  # no entry array
        (tmp_path / "synthetic.journal").write_bytes(raw)
        with pytest.raises(Exception, match="corrupt journal"):
            for _ in range(10):
                live.poll_once()
    finally:
        live.stop()


def test_a_stream_that_ended_is_no_silence(open_live, put):
    put([A])
    live = open_live()
    live.subscribe(unit(A))
    live.query.stop()
    put([A] * 3)
    with pytest.raises(JournalError):
        live.poll_once()


def test_batches_without_a_match_are_no_end(open_live, put):
    put([A])
    live = open_live(1, 1)
    s = live.subscribe(unit(B))
    put([A] * 6 + [B])
    got = []
    while live.pending():
        live.poll_once()
        while (r := s.try_recv()) is not None:
            got.append(place(r))
    assert got == [(7, 6)]


def test_a_replay_is_sorted_once(open_live, put, monkeypatch):
    put([A] * 9)
    live = open_live(2, 2)
    asked, entries = [], live.journal.entries
    monkeypatch.setattr(live.journal, "entries", lambda **kw: asked.append(kw) or entries(**kw))
    s, got = live.subscribe_from(unit(A)), []
    while live.pending():
        live.poll_once()
        while (r := s.try_recv()) is not None:
            got.append(place(r)[1])
    assert got == list(range(9)) and len(asked) == 1
