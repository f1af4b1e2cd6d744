"""Line parsing against a plain reader, and edits against brute force."""

import random
import re

import pytest

from strandline.operators import badrows

FIELD = r'(?:[^",]*|"(?:[^"]|"")*")'


def plain(line):
    text = "" if line is None else line[:-1] if line.endswith("\r") else line
    if not re.fullmatch(f"{FIELD}(?:,{FIELD})*", text, re.S):
        return "quoting"
    m = re.fullmatch(f"({FIELD}),({FIELD}),({FIELD}),({FIELD})", text, re.S)
    if not text or not m:
        return "columns"
    name, seq, unk, qual = (x[1:-1].replace('""', '"') if x.startswith('"') else x for x in m.groups())
    if name[:1] != "@":
        return "id"
    if unk[:1] != "+":
        return "unk"
    return "qual" if len(seq) != len(qual) or not re.fullmatch("[!-~]*", qual) else None


def test_reasons(spark):
    rng = random.Random(5)
    lines = [None, "", "\r", '@a,AC,+,II', '@a,AC,+,II\r', '@a,AC,+,II\r\r', '@a,,+,', '"@a","AC",+,"I"""', '@a,AC,+,I"', '"@a"x,AC,+,II', '@a,AC,+,"II', "a,AC,+,II", "@a,AC,-,II", "@a,AC,+,I", "@a,AC,+,I ", "@a,AC,+,II,", '@a,é,+,I', "@" + "x" * 40000 + ",A,+,I"]
    lines += ["".join(rng.choice('",@+AI\r\n') for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id bigint, raw_line string").selectExpr("*", "'x' as reason", "1 as edits")
    got = {r.raw_id: r for r in badrows.parse_reads(df).collect()}
    assert len(got) == len(lines)
    assert {i: r.reason for i, r in got.items()} == {i: plain(x) for i, x in enumerate(lines)}
    assert (got[7].id, got[7].seq, got[7].unk, got[7].qual) == ("@a", "AC", "+", 'I"')
    for r in got.values():
        assert (r.edit_cost == 0) == (r.reason in (None, "id", "unk", "qual"))
        assert len(r.edits) == r.edit_cost


def fixed(line, fields):
    return re.fullmatch(f"{FIELD}(?:,{FIELD}){{{fields - 1}}}", line, re.S) is not None


def cheapest(line, fields, most=4):
    seen, layer = {line}, [line]
    for cost in range(most + 1):
        if any(fixed(x, fields) for x in layer):
            return cost
        after = set()
        for x in layer:
            after |= {x[:i] + x[i + 1 :] for i in range(len(x)) if x[i] in '",'} | {x[:i] + c + x[i:] for i in range(len(x) + 1) for c in '",'}
        layer = list(after - seen)
        seen |= after
    return None


@pytest.mark.parametrize("seed", range(25))
def test_edits_are_the_cheapest(seed):
    rng = random.Random(seed)
    line = "".join(rng.choice('",,ab') for _ in range(rng.randint(0, 7)))
    cost, edits = badrows.cheapest_edits(line, 3)
    want = cheapest(line, 3)
    assert want is None or cost == want
    assert len(edits) == cost


def applied(line, edits):
    """The line with its edits made, from the last to the first; insertions at one place stay in order."""
    out = list(line) + [""]
    put = [""] * (len(line) + 1)
    for e in edits:
        do, what, _, at = e.split()
        c = '"' if what == "quote" else ","
        if do == "delete":
            assert out[int(at)] == c
            out[int(at)] = ""
        else:
            put[int(at)] += c
    return "".join(p + c for p, c in zip(put, out, strict=True))


def test_edits_mend_the_line():
    rng = random.Random(99)
    lines = ["".join(rng.choice('",,ab') for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for line, (quoted, cost, edits) in zip(lines, badrows.parse_costs(lines, 4), strict=True):
        assert fixed(applied(line, edits), 4), (line, edits)
        assert len(edits) == cost >= quoted
        assert (quoted == 0) == bool(re.fullmatch(f"{FIELD}(?:,{FIELD})*", line))
    assert [x[:2] for x in badrows.parse_costs(lines, 4, edits=False)] == [x[:2] for x in badrows.parse_costs(lines, 4)]
    assert badrows.parse_costs([], 4) == []


def test_lines_of_many_marks_have_edits_too(spark):
    df = spark.createDataFrame([(1, "@a" + "," * 6000), (2, "@a,A,+," + "a\"" * 5001)], "raw_id bigint, raw_line string")
    got = {r.raw_id: r for r in badrows.parse_reads(df).collect()}
    assert (got[1].edit_cost, len(got[1].edits)) == (2, 2)
    assert got[2].edit_cost == len(got[2].edits) > 0


def test_empty_table(spark):
    assert badrows.parse_reads(spark.createDataFrame([], "raw_id bigint, raw_line string")).count() == 0
