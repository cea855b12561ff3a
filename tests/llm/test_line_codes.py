"""The numpy kernels of line dedup against plain loops, and the registered options on odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from moltraj.llm import line_codes, line_dedup
from tests.llm import cases

TEXTS = ["", "\n\n", "one two\n\n  ***  \nOne, TWO!", "本站所有 abc本\nx1 y2", "a" * 5000 + " b", "\n".join(f"w{i} w{i + 1} w{i + 2}" for i in range(40)), "---\n***\n---"]


def plain(text):
    """Line number and words of every line that is not blank."""
    for at, line in enumerate(text.lower().split("\n")):
        words = re.findall(f"[{line_codes.SPACELESS}]|[^{line_codes.BETWEEN}{line_codes.SPACELESS}]+", line)
        if words or line.strip():
            yield at, words or [line.strip()]


def batch(texts):
    ids = [None if i == 1 else i for i in range(len(texts))]
    return pa.RecordBatch.from_pydict({"_id": pa.array(ids, pa.int64()), "_version": pa.array(range(len(texts)), pa.int64()), "_text": pa.array(texts, pa.string())})


@pytest.mark.parametrize("chunk", [1, 200_000])
def test_lines_equal_plain_loops(monkeypatch, chunk):
    monkeypatch.setattr(line_codes, "CHUNK", chunk)
    monkeypatch.setattr(line_codes, "CACHED", 7)
    got = pa.Table.from_batches(line_codes.lines_of(iter([batch(TEXTS)]))).to_pylist()
    expected = [(None if i == 1 else i, i, at, words) for i, text in enumerate(TEXTS) for at, words in plain(text)]
    assert [(r["_id"], r["_version"], r["_at"], len(r["_code"]) // 2) for r in got] == [(i, v, at, len(words)) for i, v, at, words in expected]
    by_node, by_words = {}, {}
    for row, (*_, words) in zip(got, expected, strict=True):
        assert len(row["_code"].decode("utf-16-be")) == len(words)
        assert by_node.setdefault(row["_node"], words) == words and by_words.setdefault(tuple(words), row["_node"]) == row["_node"]


def test_no_rows_make_no_lines():
    assert sum(b.num_rows for b in line_codes.lines_of(iter([batch([])]))) == 0
    none = pa.RecordBatch.from_pydict({"_node": pa.array([], pa.int64()), "_code": pa.array([], pa.binary())})
    assert sum(b.num_rows for b in line_codes.keys_of(iter([none]), 4, 10, 8, 5, 9)) == 0


def test_lines_meet_where_runs_or_forms_are_equal():
    draw = random.Random(2)
    lines = [draw.choices(range(0x100, 0x106), k=size) for size in range(1, 30) for _ in range(8)]
    packed = [b"".join(code.to_bytes(2, "big") for code in line) for line in lines]
    rows = pa.RecordBatch.from_pydict({"_node": pa.array(range(len(lines)), pa.int64()), "_code": pa.array(packed, pa.binary())})
    run, most, long, least, short = 4, 10_000, 8, 5, 9
    got = pa.Table.from_batches(line_codes.keys_of(iter([rows]), run, most, long, least, short)).to_pylist()
    expected = []
    for i, line in enumerate(lines):
        runs = {("run", *line[at : at + run]) for at in range(len(line) - run + 1)} if len(line) >= long else set()
        forms = [("form", *line), *(("form", *line[:at], *line[at + 1 :]) for at in range(len(line)))] if least <= len(line) <= short else []
        expected += [(i, key) for key in [*runs, *forms]]
    assert Counter(r["_node"] for r in got) == Counter(i for i, _ in expected)
    assert all(r["_sim"] == len(lines[r["_node"]]) for r in got)
    # Blocks stand for keys: the same lines share them, as often.
    meeting = lambda pairs: Counter(frozenset(Counter(nodes).items()) for nodes in pairs.values())
    blocks, keys = {}, {}
    for r in got:
        blocks.setdefault(r["block"], []).append(r["_node"])
    for i, key in expected:
        keys.setdefault(key, []).append(i)
    assert meeting(blocks) == meeting(keys)
    few = pa.Table.from_batches(line_codes.keys_of(iter([rows]), run, 3, long, least, short)).to_pylist()
    smallest = Counter(r["_node"] for r in few if r["_sim"] > short)
    assert all(n == min(3, len({tuple(lines[i][at : at + run]) for at in range(len(lines[i]) - run + 1)})) for i, n in smallest.items())


@pytest.mark.parametrize("clashing", [False, True])
def test_registered_options_on_odd_rows(spark, clashing):
    docs = cases.documents(spark, clashing)
    kept = line_dedup.without_repeated_lines(docs, **line_dedup.WHOLE)
    assert kept.dtypes == docs.dtypes
    rows = kept.collect()
    assert len(rows) == docs.count()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    assert sum(r["text"] is None for r in rows) == docs.where("text is null").count()


def test_registered_options_on_an_empty_table(spark):
    assert line_dedup.without_repeated_lines(cases.empty(spark), **line_dedup.WHOLE).count() == 0


@pytest.mark.parametrize("crowd", [10**9, 10])
def test_packed_keys_meet_as_plain_keys_do(monkeypatch, crowd):
    """keys travel once, packed; lines meet in the parts just as by a row for each key, whatever the base or part."""
    monkeypatch.setattr(line_codes, "PACKED", 500)
    draw = random.Random(6)
    lines = [draw.choices(range(0x100, 0x106), k=draw.randrange(1, 26)) for _ in range(400)]
    numbers = [(i // 150 << 33) + 65_500 + i for i in range(len(lines))]
    rows = pa.RecordBatch.from_pydict({"_node": pa.array(numbers, pa.int64()), "_code": pa.array([b"".join(c.to_bytes(2, "big") for c in line) for line in lines], pa.binary())})
    blocks = Counter(b for batch in line_codes.every_run(iter([rows]), 3, 8) for b in batch.column(0).to_numpy().view("u8").tolist())
    known = sorted(blocks)
    frequent = np.array(known, "u8"), np.array([blocks[b] for b in known])
    options = {"run": 3, "most": 0, "long": 8, "least": 5, "short": 9, "similarity": 0.8, "frequent": frequent, "hot": 20}
    halved = {b >> 1 << 1: n for b, n in blocks.items() if n > crowd}
    crowded = np.array(sorted(halved), "u8"), np.array([halved[b] for b in sorted(halved)], "i8")
    groups = {}
    for row in pa.Table.from_batches(line_codes.keys_of(iter([rows]), **options)).to_pylist():
        groups.setdefault(row["block"], {})[row["_node"]] = row["_sim"]
    packed = pa.Table.from_batches(line_codes.packed_keys(iter([rows]), 3, crowded, **options))
    assert packed.num_rows < sum(map(len, groups.values())) / 4
    parts = [line_codes.meeting(packed.filter(pa.compute.equal(packed["part"], part)), 4, 0.8) for part in pa.compute.unique(packed["part"])]
    found = pa.concat_tables(parts).to_pylist()
    close = lambda a, b: abs(a - b) <= 0.2 * max(a, b) + 1e-9
    whole = {b for b in groups if (b & (1 << 64) - 1) >> 1 << 1 in halved}
    assert bool(whole) == (crowd == 10)
    small = {b for b, g in groups.items() if 1 < len(g) <= 4 and not b & 1} - whole
    assert {(r["a"], r["b"]) for r in found if r["b"] is not None} == {
        (a, b) for block in small for a in groups[block] for b in groups[block] if a < b and close(groups[block][a], groups[block][b])
    }
    members = {}
    for r in found:
        if r["b"] is None:
            members.setdefault(r["block"], {})[r["a"]] = r["sim"]
    large = [g for b, g in groups.items() if b in whole or b not in small and len(g) > 1]
    assert sorted(sorted(g.items()) for g in members.values()) == sorted(sorted(g.items()) for g in large)
    heads = Counter(r["block"] for r in found if r["sign"] is not None)
    assert all(heads[b] == 1 for b in members if b not in whole) and set(heads) == set(members)


def test_runs_in_very_many_lines_lose_no_pair(spark, monkeypatch):
    """runs above CROWD pass by the parts of keys; the same lines go."""
    draw = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    frame = words[:12]
    lines = [" ".join(frame[:at] + draw.choices(words, k=draw.randrange(1, 5)) + frame[at:]) for at in draw.choices(range(12), k=150)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = lambda: {r["doc_id"] for r in line_dedup.deduplicated(docs, **line_dedup.WHOLE).where("_dropped > 0").select("_row.doc_id").collect()}
    before = gone()
    monkeypatch.setattr(line_dedup, "CROWD", 10)
    assert before and gone() == before


def edited_lines(seed, sizes, alphabet):
    """Pairs of code lines with as many edits as a similarity of 0.8 allows, at random or evenly spread places."""
    draw = random.Random(seed)
    for size in sizes:
        line, other = draw.choices(alphabet, k=size), []
        every = draw.choice((4, 5, 5, 6))
        for at, code in enumerate(line):
            if at % every == every - 1 if draw.random() < 0.8 else draw.random() < 0.2:
                other += draw.choice(([], [draw.choice(alphabet)], [draw.choice(alphabet)], [code, draw.choice(alphabet)]))
            else:
                other.append(code)
        yield line, other


def edits(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def rows_of(lines):
    packed = [b"".join(int(code).to_bytes(2, "big") for code in line) for line in lines]
    return pa.RecordBatch.from_pydict({"_node": pa.array(range(len(lines)), pa.int64()), "_code": pa.array(packed, pa.binary())})


@pytest.mark.parametrize("kinds", [12, 4000])
def test_similar_lines_meet_by_longer_runs_at_places_that_allow_it(kinds):
    """whatever the lengths and edits, some key is given by both lines, and its places pass."""
    draw = random.Random(kinds)
    alphabet = range(0x100, 0x100 + kinds)
    near = [(a, b) for a, b in edited_lines(kinds, [draw.randrange(5, 60) for _ in range(3000)], alphabet) if len(b) >= 5 and edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9]
    lines = [line for pair in near for line in pair]
    none = np.zeros(0, "u8"), np.zeros(0, "i8")
    options = {"run": 3, "most": 0, "long": 8, "least": 5, "short": 9, "similarity": 0.8, "frequent": none, "hot": 9, "longer": (4, 16)}
    keys = {}
    for row in pa.Table.from_batches(line_codes.keys_of(iter([rows_of(lines)]), **options)).to_pylist():
        keys.setdefault(row["_node"], {})[row["block"]] = row["place"]
    assert len(near) > 800 and sum(len(a) > 15 for a, _ in near) > 400
    for at, (a, b) in enumerate(near):
        one, other = keys[2 * at], keys[2 * at + 1]
        both = [block for block in one if block in other]
        pass_on = [line_codes.may_align(*(np.array([v]) for v in (len(a), len(b), one[k], other[k])), 0.8)[0] for k in both]
        assert any(pass_on), (a, b)


@pytest.mark.parametrize("bulky, pairs, tiled", [(128, 10**6, False), (6, 40, True)])
def test_bags_pass_every_similar_pair_and_few_others(monkeypatch, bulky, pairs, tiled):
    """lines of different roots are left for edit distances if their words allow it, and not for one passage."""
    monkeypatch.setattr(line_codes, "BULKY", bulky)
    monkeypatch.setattr(line_codes, "PAIRS", pairs)
    draw = random.Random(5)
    passage = draw.choices(range(0x100, 0x2000), k=20)
    lines = [passage + draw.choices(range(0x100, 0x2000), k=draw.randrange(12, 20)) for _ in range(60)]
    lines += [line for pair in edited_lines(4, [draw.randrange(5, 60) for _ in range(60)], range(0x100, 0x2000)) for line in pair if line]
    lines += [[code] * n for code in (0x300, 0x301) for n in (200, 220, 900)]
    table = pa.Table.from_batches(line_codes.with_bags(iter([rows_of(lines)])))
    roots = [draw.choice((0, 0, i, i)) for i in range(len(lines))]
    tile = [i % 2 if tiled else 0 for i in range(len(lines))]
    for name, values in (("_sim", list(map(len, lines))), ("_root", roots), ("tile", tile)):
        table = table.append_column(name, pa.array(values, pa.int32() if name != "_root" else pa.int64()))
    got = {(r["a"], r["b"]) for r in line_codes.alike(table, 0.8).to_pylist()}
    allowed = [(a, b) for b in range(len(lines)) for a in range(b) if roots[a] != roots[b] and tile[a] + tile[b] == int(tiled)
               or roots[a] != roots[b] and not tiled]
    assert got <= set(allowed)
    near = {(a, b) for a, b in allowed if abs(len(lines[a]) - len(lines[b])) <= 0.2 * max(len(lines[a]), len(lines[b])) and len(lines[b]) < 100
            and edits(lines[a], lines[b]) <= 0.2 * max(len(lines[a]), len(lines[b])) + 1e-9}
    assert len(near) > 5 and near <= got
    assert not any(b < 60 or lines[a][0] == 0x300 and lines[b][0] == 0x301 for a, b in got)
    assert len(got) < 2 * len(near)
