"""Maximal periodic runs of words, by a suffix automaton whose suffix links are kept as a link-cut forest.

A text's words are appended to a suffix automaton. The states of its prefixes are then visited in order: access walks
from a state to the root and recolours that path with the prefix's end. Each stretch of the path that had one colour
before holds the words sequences that all ended last at that colour. If the distance from there to the new end is at
most the length of the stretch's longest sequence, the text has a square of that half length ending here. The half
length is the square's smallest period, as a smaller one would have been a later end. Squares are extended both ways to
runs, once for each run. Preferred paths are splay trees, so a text of n words takes n log n steps however periodic it is.

Words that can't be in a run are left out first, without loss: all of a run of at least `least` words is covered by
sequences of `least` / 2 words that occur twice in it, so that runs lie whole inside the stretches of words covered by
repeated sequences, and each stretch is taken by itself. Equal hashes only ever add stretches.

A run is a stretch of words with smallest period q and length at least max(least, 2 q) that no neighbour extends. Null
texts have no words and no runs; repeated rows give repeated results; empty tables give an empty result; a text is one
unit of work, whole whatever its length, in memory that grows with its words. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltraj.llm.shared import table, utf8

LEAST = 12
#: Words that a task prepares or returns at a time: rows of a batch.
ROWS = 256
#: Rounds of leaving out words; more would only shorten the stretches.
ROUNDS = 4
#: Odd multiplier of the sequence hash.
MULTIPLIER = 0x9E3779B97F4A7C15


class SuffixAutomaton:
    """States with their longest length, suffix link and edges. A state's first edge is kept apart, as most have only one."""

    def __init__(self, size: int):
        self.length, self.link = array("l", [0]), array("l", [-1])
        self.word, self.target, self.more = array("l", [-1]), array("l", [-1]), {}
        self.last = 0
        self.ends = array("l", bytes(8 * size))

    def state(self, length: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self.word.append(-1)
        self.target.append(-1)
        return len(self.length) - 1

    def append(self, word: int, at: int) -> None:
        length, link, first, target, more = self.length, self.link, self.word, self.target, self.more
        here, self.last = self.last, self.state(length[self.last] + 1)
        new = self.last
        self.ends[at] = new
        while here != -1:
            if first[here] == -1:
                first[here], target[here] = word, new
            elif first[here] == word:
                break
            else:
                edges = more.get(here)
                if edges is None:
                    more[here] = {word: new}
                elif word in edges:
                    break
                else:
                    edges[word] = new
            here = link[here]
        if here == -1:
            return
        found = target[here] if first[here] == word else more[here][word]
        if length[here] + 1 == length[found]:
            link[new] = found
            return
        copy = self.state(length[here] + 1)
        link[copy], first[copy], target[copy] = link[found], first[found], target[found]
        if found in more:
            more[copy] = dict(more[found])
        while here != -1:
            if first[here] == word:
                if target[here] != found:
                    break
                target[here] = copy
            else:
                edges = more.get(here)
                if edges is None or edges.get(word) != found:
                    break
                edges[word] = copy
            here = link[here]
        link[found] = link[new] = copy


def last_ends(automaton: SuffixAutomaton, size: int) -> Iterator[tuple[int, int, int]]:
    """For each prefix end, (end, earlier end, length of the longest sequence that ended there last), by access.

    Every preferred path is a splay tree ordered by depth. Its colour is held at the tree's root.
    """
    above = list(automaton.link)
    nodes = len(above)
    left, right, colour = [-1] * nodes, [-1] * nodes, [-1] * nodes
    length = automaton.length

    def splay(x: int) -> None:
        p = above[x]
        if p == -1 or (left[p] != x and right[p] != x):
            return
        while True:
            p = above[x]
            if p == -1:
                return
            low = left[p] == x
            if not low and right[p] != x:
                return
            g = above[p]
            if g != -1 and (left[g] == p or right[g] == p):
                # The parent first where both turn the same way, else the node itself twice.
                up = p if low == (left[g] == p) else x
                rotate(up)
            rotate(x)

    def rotate(x: int) -> None:
        p = above[x]
        g = above[p]
        if left[p] == x:
            b = right[x]
            left[p] = b
            right[x] = p
        else:
            b = left[x]
            right[p] = b
            left[x] = p
        if b != -1:
            above[b] = p
        above[p] = x
        above[x] = g
        if g != -1:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        colour[x] = colour[p]

    ends = automaton.ends
    for at in range(size):
        below, node = -1, ends[at]
        while node != -1:
            splay(node)
            deeper = right[node]
            if deeper != -1:
                colour[deeper] = colour[node]
            right[node] = below
            if colour[node] != -1 and length[node]:
                yield at, colour[node], length[node]
            below, node = node, above[node]
        splay(ends[at])
        colour[ends[at]] = at


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many first places of both agree; looks a little further each time, so that the work follows the answer."""
    low, step, most = 0, 16, min(len(a), len(b))
    while low < most:
        high = min(low + step, most)
        unequal = np.flatnonzero(a[low:high] != b[low:high])
        if len(unequal):
            return low + int(unequal[0])
        low, step = high, 2 * step
    return most


def stretch_runs(words: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one stretch of numbered words."""
    plain = words.tolist()
    size = len(plain)
    automaton = SuffixAutomaton(size)
    for at, word in enumerate(plain):
        automaton.append(word, at)
    reached: dict[int, int] = {}
    found = []
    for at, earlier, longest in last_ends(automaton, size):
        period = at - earlier
        if period > longest or reached.get(period, -1) >= at:
            continue
        stop = at + 1 + agreeing(words[at + 1 - period :], words[at + 1 :])
        start = earlier + 1 - agreeing(words[earlier::-1], words[at::-1])
        reached[period] = stop - 1
        if stop - start >= least:
            found.append((start, stop - start, period))
    return found


def stretches(words: np.ndarray, offset: int, least: int, rounds: int = ROUNDS) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, words) of the parts that sequences of least / 2 words which occur twice in them cover."""
    width = max(1, least // 2)
    if len(words) < least:
        return
    hashes = np.zeros(len(words) - width + 1, np.uint64)
    for at in range(width):
        hashes = hashes * np.uint64(MULTIPLIER) + words[at : at + len(hashes)].astype(np.uint64) + np.uint64(1)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    repeated = np.zeros(len(hashes), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    covered = np.concatenate([[False], np.cumsum(edges[:-1]) > 0, [False]])
    turns = np.flatnonzero(covered[1:] != covered[:-1])
    for begin, end in zip(turns[::2].tolist(), turns[1::2].tolist()):
        if end - begin < least:
            continue
        if rounds <= 1 or end - begin == len(words):
            yield offset + begin, words[begin:end]
        else:
            yield from stretches(words[begin:end], offset + begin, least, rounds - 1)


def numbered(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(word, len(numbers)) for word in words), np.int64, len(words))


def runs_of(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    if len(words) < least:
        return []
    found = []
    for offset, part in stretches(numbered(words), 0, least):
        found += [(offset + start, length, period) for start, length, period in stretch_runs(part, least)]
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[at] for at in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def mapped_words(docs: DataFrame, key: str, text: str, change: Callable[[list[bytes], object], list[bytes]] | None, least: int, columns: dict) -> DataFrame:
    """`key` and, for each name of `columns`, (type, function of words and runs) of every row."""
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, " + ", ".join(f"{name} {spec[0]}" for name, spec in columns.items())
    plain = {"long": pa.int64(), "string": pa.string(), "array<struct<start:long,length:long,period:long>>": pa.list_(
        pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                values = {name: [] for name in columns}
                for ident, body in zip(part.column(0).to_pylist(), part.column(1)):
                    words = body.as_py().split()
                    words = change(words, ident) if change else words
                    runs = runs_of(words, least)
                    for name, (_, value) in columns.items():
                        values[name].append(value(words, runs))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(values[name], plain[spec[0]]) for name, spec in columns.items()]], names=[key, *columns]
                )

    return docs.select(F.col(key), utf8(text).alias("_text")).mapInArrow(run, schema)


def listed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[dict]:
    return [{"start": s, "length": n, "period": q} for s, n, q in runs]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """`key`, `n_words`, `runs` (start, length, period; by start, then period) and `collapsed`, the kept words joined by spaces."""
    columns = {
        "n_words": ("long", lambda words, runs: len(words)),
        "runs": ("array<struct<start:long,length:long,period:long>>", listed),
        "collapsed": ("string", lambda words, runs: b" ".join(collapsed(words, runs)).decode()),
    }
    return mapped_words(docs, key, text, None, least, columns)


def planted(words: list[bytes], ident: int | None) -> list[bytes]:
    """The query's words: one text in ten, by the checksum of its id, repeats a stretch from some word on to its end."""
    n = len(words)
    h = zlib.crc32(str(ident).encode())
    if ident is None or not n or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[: n - a]


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    return min(runs, key=lambda run: (-run[1], run[0], run[2])) if runs else None


def of_greatest(pick: Callable[[tuple[int, int, int]], int]):
    def value(words: list[bytes], runs: list[tuple[int, int, int]]) -> int | None:
        best = greatest(runs)
        return None if best is None else pick(best)

    return value


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, change=planted) -> DataFrame:
    columns = {
        "n_runs": ("long", lambda words, runs: len(runs)),
        "start": ("long", of_greatest(lambda run: run[0])),
        "length": ("long", of_greatest(lambda run: run[1])),
        "period": ("long", of_greatest(lambda run: run[2])),
        "exponent_milli": ("long", of_greatest(lambda run: 1000 * run[1] // run[2])),
        "runs_sha256": ("string", lambda words, runs: hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()),
        "collapsed_sha256": ("string", lambda words, runs: hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()),
    }
    return mapped_words(docs, key, text, change, least, columns)


def op13_recoloured_runs(spark: SparkSession, sf: str) -> DataFrame:
    return digests(table(spark, sf, "documents"))
