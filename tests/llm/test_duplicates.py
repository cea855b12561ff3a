"""SimHash classes, fuzzy lines and components against brute force."""

import itertools
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from moltraj.llm import components, line_dedup, simhash
from tests.llm import cases


def classes(nodes, links):
    parent = {node: node for node in nodes}

    def find(node):
        while parent[node] != node:
            node = parent[node]
        return node

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {node: find(node) for node in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    draw = random.Random(1)
    links = {
        "chain": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(100)],
        "random": [(draw.randint(0, 200), draw.randint(0, 200)) for _ in range(150)],
    }[shape]
    df = spark.createDataFrame([*links, (None, 3), (4, 4)], "a long, b long")
    got = {row["node"]: row["root"] for row in components.components(df).collect()}
    nodes = {node for link in links for node in link}
    assert {node: got.get(node, node) for node in nodes} == classes(nodes, links)
    assert components.components(df.limit(0)).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(shingle, seed=42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_chunks(monkeypatch):
    texts = [text for text in cases.ODD_TEXTS if text] + [cases.BODY]
    for size in (2, simhash.CHUNK):
        monkeypatch.setattr(simhash, "CHUNK", size)
        for text in texts:
            assert simhash.fingerprint(text.encode()) == simhash.signed(brute_fingerprint(text))


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2, 3):
        masks = simhash.covering(list(range(64)), radius)
        draw = random.Random(radius)
        for _ in range(3000):
            differing = sum(1 << at for at in draw.sample(range(64), radius))
            assert any(not differing & mask for mask in masks)
    masks = simhash.covering(list(range(64)), 3)
    for _ in range(2):
        masks = simhash.refined(masks, 3)
    assert max(64 - mask.bit_count() for mask in masks) <= 10


@pytest.mark.parametrize("group", [2, 1024])
def test_links_connect_all_within_the_radius(spark, monkeypatch, group):
    """Also with groups so small that all levels of masks are used."""
    monkeypatch.setattr(simhash, "GROUP", group)
    draw, values = random.Random(2), set()
    for _ in range(12):
        center = draw.getrandbits(64)
        for _ in range(12):
            values.add(center ^ sum(1 << at for at in draw.sample(range(64), draw.randint(0, 3))))
    values = [simhash.signed(value) for value in values]
    df = spark.createDataFrame([(value,) for value in values], "bits long")
    links = [(row["a"], row["b"]) for row in simhash.near_links(df).collect()]
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    assert all(near(a, b) for a, b in links)
    assert classes(values, links) == classes(values, [p for p in itertools.combinations(values, 2) if near(*p)])


@pytest.mark.parametrize("clashing", [False, True])
def test_near_duplicates_of_odd_rows(spark, clashing):
    rows = cases.document_rows()
    got = simhash.near_duplicates(cases.documents(spark, clashing)).collect()
    prints = [brute_fingerprint(row[1]) for row in rows]
    found = classes(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    smallest = {}
    for at, root in found.items():
        if rows[at][0] is not None:
            smallest[root] = min(smallest.get(root, rows[at][0]), rows[at][0])
    expected = Counter((row[0], f"{prints[at]:016x}", smallest.get(found[at])) for at, row in enumerate(rows))
    assert Counter(tuple(row) for row in got) == expected
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("clashing", [False, True])
def test_one_of_each_group_stays(spark, clashing):
    docs = cases.documents(spark, clashing)
    kept = simhash.one_of_each(docs)
    assert kept.dtypes == docs.dtypes
    roots = {row["component_id"] for row in simhash.near_duplicates(docs).collect()}
    assert sorted(row["doc_id"] for row in kept.collect()) == sorted(roots)
    assert simhash.one_of_each(cases.empty(spark)).count() == 0


def test_line_simhash_lanes_agree(spark):
    words = [["a"], ["a", "b", "c", "d", "e"], ["x"] * 7, [str(i) for i in range(700)]]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w array<string>")
    df = df.select("i", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    for row in df.select("i", line_dedup.simhash(F.col("h")).alias("a"), line_dedup.bit_majority(F.col("h")).alias("b")).collect():
        hashes = [xxhash.xxh64_intdigest(word.encode(), seed=42) for word in words[row["i"]]]
        expected = sum(1 << bit for bit in range(line_dedup.BITS) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
        assert row["a"] == row["b"] == expected


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def line_documents():
    draw = random.Random(4)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    bases = [" ".join(draw.choice(vocabulary) for _ in range(120)) for _ in range(4)]
    rows = []
    for doc in range(40):
        lines = []
        for _ in range(4):
            words = draw.choice(bases).split()
            if draw.random() < 0.7:
                words[draw.randrange(120)] = draw.choice(vocabulary)
            lines.append(" ".join(words).title() + "!" * draw.randint(0, 2))
        rows.append((doc, "\n".join([*lines, "short line", "", "short line"])))
    return rows


@pytest.mark.parametrize("group", [3, 4096])
def test_fuzzy_lines_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(line_dedup, "GROUP", group)
    rows = line_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_dedup.line_rows(docs, "doc_id", "text", 5).collect()
    source = {doc: body.split("\n") for doc, body in rows}
    text = {r["_node"]: [w for w in re.split("[\x00-\x60\x7b-\xbf]+", source[r["_id"]][r["_at"]].lower()) if w] for r in lines}
    bits = {r["_node"]: r["_sim"] for r in lines}
    links = [
        (a, b) for a, b in itertools.combinations(text, 2)
        if (bits[a] ^ bits[b]).bit_count() <= 2 and distance(text[a], text[b]) <= 0.2 * max(len(text[a]), len(text[b])) + 1e-9
    ]
    assert links
    root, seen, gone = classes(text, links), set(), Counter()
    for row in sorted(lines, key=lambda r: (r["_id"], r["_at"])):
        if root[row["_node"]] in seen:
            gone[row["_id"]] += 1
        seen.add(root[row["_node"]])
    got = line_dedup.deduplicated(docs).select("_row.*", "_dropped", "_lines").collect()
    assert {r["doc_id"]: r["_dropped"] for r in got if r["_dropped"]} == dict(gone)
    before = dict(rows)
    for row in got:
        assert row["_lines"] == 7
        left = row["text"].split("\n") if row["_dropped"] < 7 else []
        assert len(left) == 7 - row["_dropped"] and left[-3:] == ["short line", "", "short line"]
        source = iter(before[row["doc_id"]].split("\n"))
        assert all(line in source for line in left)


@pytest.mark.parametrize("clashing", [False, True])
def test_line_dedup_of_odd_rows(spark, clashing):
    docs = cases.documents(spark, clashing)
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.dtypes == docs.dtypes and kept.count() == docs.count()
    texts = Counter((row["doc_id"], row["text"]) for row in kept.collect())
    for row in cases.document_rows()[: len(cases.ODD_TEXTS)]:
        assert texts[row[0], row[1]] >= 1, row
    whole = "\n".join(text for _, text in texts if text)
    assert whole.count(cases.BODY) + whole.count(cases.BODY.upper()) == 1
    assert line_dedup.without_repeated_lines(cases.empty(spark)).count() == 0
