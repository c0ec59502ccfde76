"""Records by stretches against a plain walk over all characters; lost quotes."""

import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.sources.csv_files import damaged_lines, read_csv
from gridloom.sources.quote_scan import QuoteRule, quoted_spans, read_stretch, records_of, sum_up
from gridloom.sources.semicolon import read_semicolon


def walk(text, sep, newline, anywhere):
    """Records of a text, character by character."""
    out, record, inside, start, i = [], "", False, True, 0
    while i < len(text):
        c = text[i]
        if c == '"' and (anywhere or inside or start):
            if not anywhere and inside and text[i + 1:i + 2] == '"':
                record, i = record + '""', i + 2
                continue
            inside, start = not inside, False
        elif c == newline and not inside:
            out.append(record)
            record, start, i = "", True, i + 1
            continue
        else:
            start = not inside and c == sep
        record, i = record + c, i + 1
    # What an unclosed quote takes in is a record too, without the last line end.
    return out + [record.removesuffix(newline)] if record else out


def by_stretches(data, size, rule):
    file, state, got = io.BytesIO(data), False, []
    for start in range(0, max(1, len(data)), size):
        text, ahead = read_stretch(file, start, start + size, rule.newline)
        if not text:
            continue
        told = sum_up(text, ahead, rule, "latin-1")
        assert told.ends_out == quoted_spans(text, False, rule, ahead).inside
        assert told.ends_in == quoted_spans(text, True, rule, ahead).inside
        for offsets, values, damaged in records_of(text, state, ahead, rule):
            got += [values[a:b] for a, b in zip(offsets, offsets[1:])]
            assert not damaged
        state = told.ends_in if state else told.ends_out
    return got


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet='ab,"\n\r', max_size=80), st.integers(1, 30), st.booleans(), st.sampled_from("\n\r"))
def test_records_are_the_same_however_a_file_is_cut(text, size, anywhere, newline):
    rule = QuoteRule(b",", newline.encode(), 2, anywhere)
    want = [r.removesuffix("\r") if newline == "\n" else r for r in walk(text, ",", newline, anywhere)]
    assert [r.decode() for r in by_stretches(text.encode(), size, rule)] == want


def lost(n, quote_at, sep):
    rows = [f"{i}{sep}value {i}{sep}x" for i in range(n)]
    rows[quote_at] = f'{quote_at}{sep}"broken here{sep}x'
    return rows


@pytest.mark.parametrize("anywhere,sep", [(False, b","), (True, b";")])
@pytest.mark.parametrize("size", [64, 1_000, 1 << 20])
def test_a_lost_quote_damages_one_record(anywhere, sep, size):
    rows = lost(400, 30, sep.decode())
    rows[200] = f'200{sep.decode()}"fine\nover lines"{sep.decode()}x'
    rule = QuoteRule(sep, b"\n", 3, anywhere, look=1_500)
    data = ("a,b,c".replace(",", sep.decode()) + "\n" + "\n".join(rows) + "\n").encode()
    file, state, got, bad = io.BytesIO(data), False, [], []
    for start in range(0, len(data), size):
        text, ahead = read_stretch(file, start, start + size, b"\n")
        if not text:
            continue
        told = sum_up(text, ahead, rule, "utf-8")
        for offsets, values, damaged in records_of(text, state, ahead, rule):
            found = [values[a:b].decode() for a, b in zip(offsets, offsets[1:])]
            got += found
            bad += found if damaged else []
        state = told.ends_in if state else told.ends_out
    assert bad == [f'30{sep.decode()}"""broken here"{sep.decode()}x']
    assert len(got) == 401 and got[201] == rows[200]


def test_a_quote_open_for_too_long_is_lost_whatever_follows():
    rule = QuoteRule(b",", b"\n", 3, look=100, longest=1_000)
    data = b'a,b,c\n1,"x\n' + b"prose without fields\n" * 100 + b"2,y,z\n"
    text, ahead = read_stretch(io.BytesIO(data), 0, len(data), b"\n")
    assert quoted_spans(text, False, rule, ahead).lost == [9]
    short = b'a,b,c\n1,"x\n' + b"prose without fields\n" * 20 + b'",z\n2,y,z\n'
    text, ahead = read_stretch(io.BytesIO(short), 0, len(short), b"\n")
    assert quoted_spans(text, False, rule, ahead).lost == []


def test_files_with_a_lost_quote(spark, tmp_path):
    body = lost(60_000, 100, ",")
    path = tmp_path / "lost.csv"
    path.write_text("a,b,c\n" + "\n".join(body) + "\n")
    got = read_csv(spark, str(path), sep=",")
    assert got.count() == 60_000 and got.where("a = '100'").first().b == '"broken here'
    assert [(r.n_fields, r.value) for r in damaged_lines(spark, str(path), sep=",").collect()] == [(3, '100,"""broken here",x')]
    path.write_text("a;b;c\n" + "\n".join(lost(60_000, 100, ";")) + "\n")
    dirty = read_semicolon(spark, str(path), with_damaged=True)
    assert dirty.count() == 60_000 and [tuple(r) for r in dirty.where("_damaged").collect()] == [("100", '"broken here', "x", None, True)]


def test_mixed_ends_are_judged_outside_quotes_only(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_bytes(b'a,b\n1,"l1\nq\rr\nl3"\n2,z\n')
    assert [tuple(r) for r in read_csv(spark, str(path), sep=",", with_order=True).orderBy("_ord").drop("_ord").collect()] == [("1", "l1\nq\rr\nl3"), ("2", "z")]
    path.write_bytes(b'a,b\n1,"l1\nl2"\n2,z\r3,y\n')
    with pytest.raises(ValueError, match="mixes line ends: 1 lines"):
        read_csv(spark, str(path), sep=",")
