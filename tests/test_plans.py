"""Filter language, cursors and hashes, without Spark."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from brindle.functions.hashes import jenkins64, siphash24
from brindle.operators.seal import Fsprg, VerificationKey
from brindle.plans.cursor import Cursor, FileOffset, Native
from brindle.plans.model import InvalidQuery, Key, Limits, Unsupported
from brindle.plans.predicates import UNIT_FIELDS, Filter

U64 = st.integers(0, 2**64 - 1)
ID = st.binary(min_size=16, max_size=16)


def test_order_of_unit_and_group():
    unit_first = Filter().match_unit("a").or_group(lambda g: g.match_exact("X", "1"))
    group_first = Filter().or_group(lambda g: g.match_exact("X", "1")).match_unit("a")
    assert unit_first.groups == [[(f, b"a")] for f in UNIT_FIELDS] + [[("X", b"1")]]
    assert group_first.groups == [[("X", b"1"), (f, b"a")] for f in UNIT_FIELDS]
    assert len(Filter().match_unit("a").match_unit("b").groups) == 9


def test_empty_group_is_ignored_and_reasons_stay():
    assert Filter().or_group(lambda g: g).groups == []
    f = Filter(Limits(max_field_name_len=3)).match_exact("LONG", "x").match_exact("A", "1")
    assert f.globals == []
    with pytest.raises(InvalidQuery, match="field name too long"):
        f.check()
    for bad in ("A=B", "ä", "A\0"):
        with pytest.raises(InvalidQuery):
            Filter().match_present(bad).check()
    Filter().match_present("").check()


def test_term_budget():
    f = Filter(Limits(max_query_terms=2)).match_exact("A", "1").match_exact("B", "1")
    f.check()
    with pytest.raises(InvalidQuery):
        f.match_present("C").check()
    Filter(Limits(max_query_terms=3)).match_unit("a").check()
    with pytest.raises(InvalidQuery):
        Filter(Limits(max_query_terms=2)).match_unit("a").check()
    with pytest.raises(InvalidQuery):
        Filter(Limits(max_query_terms=2)).or_group(lambda g: g.match_exact("A", "1").match_exact("B", "1").match_exact("C", "1")).check()


def test_matches():
    e = [("A", b"1"), ("A", b"2"), ("B", b"")]
    assert Filter().match_exact("A", "2").match_present("B").matches(e)
    assert not Filter().match_exact("B", "x").matches(e)
    assert Filter().or_group(lambda g: g.match_exact("Z", "1")).or_group(lambda g: g.match_exact("A", "1")).matches(e)


@given(ID, U64, U64, U64)
def test_entry_key_round_trip(i, a, b, c):
    for at in (Key(a, b, i, c), FileOffset(i, c)):
        assert Cursor.parse(str(Cursor(at))) == Cursor(at)


@given(st.one_of(st.none(), ID), st.one_of(st.none(), U64), st.one_of(st.none(), ID), st.one_of(st.none(), U64), U64, st.one_of(st.none(), U64))
def test_native_round_trip(s, i, b, m, t, x):
    c = Cursor(Native(s, i, b, m, t, x))
    assert Cursor.parse(str(c)) == c


def test_cursor_texts():
    full = "s=0123456789abcdef0123456789abcdef;i=1;b=11111111-1111-1111-1111-111111111111;m=2;t=3;x=4"
    assert str(Cursor.parse(full)).startswith("SJ1:02")
    assert str(Cursor.parse("t=3")).startswith("SJ1:03")
    for bad in ("", "SJ1:", "x=1", "broken-segment", "SJ1:04aa", "SJ1:0310030000000000000000", "SJ1:02ff", "t=3;", "SJ1:zz"):
        with pytest.raises(InvalidQuery):
            Cursor.parse(bad)
    with pytest.raises(Unsupported):
        Cursor.parse("SJ1:ff")


def test_hash_vectors():
    assert siphash24(bytes(range(16)), bytes(range(15))) == 0xA129CA6149BE45E5
    assert jenkins64(b"") == 0xDEADBEEFDEADBEEF
    assert jenkins64(b"Four score and seven years ago") == 0x17770551CE7226E6


def test_generator_seeks_as_it_steps():
    g = Fsprg(bytes(range(12)))
    x = g.x0
    for epoch in range(4):
        assert int.from_bytes(g.seek(epoch)[192:384], "big") == x
        x = x * x % g.n


def test_verification_key():
    k = VerificationKey.parse("00-11-22-33-44-55-66-77-88-99-aa-bb/2-a")
    assert (k.seed[1], k.start_usec, k.interval_usec) == (0x11, 20, 10)
    for bad in ("", "00", "00112233445566778899aabb", "00112233445566778899aabb/1", "00112233445566778899aabb/1-0", "zz112233445566778899aabb/1-1"):
        with pytest.raises(InvalidQuery):
            VerificationKey.parse(bad)
