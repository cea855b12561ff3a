"""Lines as sequences of word codes, and the keys by which similar sequences meet: numpy kernels for Arrow batches.

A word is 16 bits of a hash of its characters, kept off the surrogates, so that a line's codes are valid UTF-16 and Spark decodes them to
a string with one character for each word. Kernels take whole texts, hold CHUNK words at a time beside the text in hand,
and keep no state between batches but a bounded cache of word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Characters, and later words, are joined to one numpy pass until there are this many; a longer line is a pass of its own.
CHUNK = 200_000
#: Hashes of lines without words that a worker keeps before it starts anew.
CACHED = 300_000
#: Keys that a task packs together before it hands them on.
PACKED = 600_000
#: Nodes of one base number, and the words up to which a packed key says how many its line has.
BASE, SIZED = 1 << 16, 0x1FFF
#: Pairs of groups that are looked at together.
PAIRS = 1_000_000
#: Words of 64 bits that hold the bag of a line's words, and the place of a run that is not told.
BAG, NOWHERE = 8, 255
#: Lines of over BULKY words also have counts of their words in KINDS kinds, as the bits do not tell many words apart.
BULKY, KINDS = 128, 64
#: Codes are FIRST_CODE and the CODES - 1 numbers after it, all below the surrogates.
FIRST_CODE, CODES = 0x100, 0xD000
#: Characters of scripts that put no spaces between words: Thai to Myanmar, Khmer, kana and Han.
SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
#: Characters between words.
BETWEEN = "\x00-\x2f\x3a-\x60\x7b-\xbf\u2000-\u206f\u3000-\u3003\u3008-\u3011\uff01-\uff0f"
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class WordHashes(dict):
    """Hash by line without words; none is 0."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1
        self[word] = found
        return found


def character_classes() -> np.ndarray:
    """0 for characters between words, 1 for those of words, 2 for those that are words, 3 for the end of a line."""
    found = np.ones(0x110000, np.uint8)
    for kind, ranges in ((0, BETWEEN), (2, SPACELESS)):
        at = 0
        while at < len(ranges):
            wide = ranges[at + 1 : at + 2] == "-"
            found[ord(ranges[at]) : ord(ranges[at + 2 * wide]) + 1] = kind
            at += 1 + 2 * wide
    found[ord("\n")] = 3
    return found


CLASSES = character_classes()


def word_hashes(text: str, known: WordHashes) -> np.ndarray:
    """The word hashes of lower-case lines that each end in a line feed, with a 0 after every line.

    A line without words that is not blank is its own word.
    """
    characters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = CLASSES[characters]
    inside = kind == 1
    begins = np.flatnonzero((inside & ~np.insert(inside[:-1], 0, False)) | (kind >= 2))
    # A word ends where the next character is no more of it: ends and all single characters take one place.
    ends = np.flatnonzero((inside & ~np.append(inside[1:], False)) | (kind >= 2)) + 1
    sizes = ends - begins
    used = characters[kind != 0].astype(np.uint64)
    hashes = np.maximum(sequence_hashes(used, np.cumsum(sizes) - sizes, sizes), np.uint64(1)) if len(sizes) else np.zeros(0, np.uint64)
    feeds = kind[begins] == 3
    hashes[feeds] = 0
    at = np.flatnonzero(feeds)
    bare = np.flatnonzero(np.diff(at, prepend=-1) == 1)
    if len(bare):
        stops = begins[at]
        starts = np.append(0, stops + 1)[bare]
        bare, starts = bare[stops[bare] > starts], starts[stops[bare] > starts]
        own = [(at[line], known[raw]) for line, start in zip(bare.tolist(), starts.tolist()) if (raw := text[start : stops[line]].strip())]
        if own:
            hashes = np.insert(hashes, [place for place, _ in own], np.array([value for _, value in own], np.uint64))
    return hashes


def sequence_hashes(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash for each stretch of `values`, by its values in order. Stretches follow one another and are not empty."""
    place = np.arange(len(values), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
    return mixed(np.add.reduceat(mixed(values + ODD * (place + np.uint64(1))), starts) + sizes.astype(np.uint64))


def coded_lines(documents: list[int], lines: list[int], joined: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """Document, line number, hash and codes of every line that has words, from documents, their numbers of lines and word hashes."""
    ends = np.flatnonzero(joined == 0)
    sizes = np.diff(ends, prepend=-1) - 1
    of = np.repeat(np.array(documents), lines)
    at = np.arange(len(ends)) - np.repeat(np.cumsum(lines) - lines, lines)
    some = sizes > 0
    of, at, sizes = of[some], at[some], sizes[some]
    words = joined[joined != 0]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    nodes = sequence_hashes(words, offsets[:-1], sizes) if len(sizes) else np.zeros(0, np.uint64)
    codes = (words % np.uint64(CODES) + np.uint64(FIRST_CODE)).astype(">u2")
    packed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer((2 * offsets).astype(np.int64)), pa.py_buffer(codes.tobytes())])
    return of, pa.array(at.astype(np.int32)), pa.array(nodes.view(np.int64)), packed.cast(pa.binary())


def stretches_of(text: str) -> Iterator[str]:
    """A text that ends in a line feed in parts of whole lines, of about CHUNK characters or one line each."""
    low = 0
    while low < len(text):
        high = text.rfind("\n", low, low + CHUNK) + 1 or text.index("\n", low) + 1
        yield text[low:high]
        low = high


def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From `_id`, `_version`, `_text` to `_id`, `_version`, `_at`, `_node`, `_code`, one row a line with words."""
    known = WordHashes()
    for batch in batches:
        ids, versions, texts = batch.column(0), batch.column(1), batch.column(2)
        documents, held, size = [], [], 0
        for number in range(batch.num_rows + 1):
            if number < batch.num_rows:
                documents.append(number)
                held.append(texts[number].as_py().lower() + "\n")
                size += len(held[-1])
            if documents and (size >= CHUNK or number == batch.num_rows):
                hashes = np.concatenate([word_hashes(part, known) for part in stretches_of("".join(held))])
                of, at, nodes, codes = coded_lines(documents, [text.count("\n") for text in held], hashes)
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays([ids.take(of), versions.take(of), at, nodes, codes], ["_id", "_version", "_at", "_node", "_code"])
                documents, held, size = [], [], 0


def prefix_sizes(sizes: np.ndarray, run: int, similarity: float, short: int, upto: int | None = None) -> np.ndarray:
    """How many of its first runs, in any order that all lines share, a line of so many words gives to meet every similar one.

    Of two lines of n <= m words at edit distance d, m - n of the edits insert words into the shorter and break run - 1 of
    its runs each, the others break `run` each. So with the most that the similarity allows, the shorter has at most
    run * d - (m - n) runs that the longer lacks, and the longer at most run * d. Of one more of the first runs of each,
    at least one is in both: the first of the runs that no edit breaks is among them in both lines.
    This is for pairs of which the longer has over `short` and up to `upto` words.
    """
    wanted, at = np.unique(sizes, return_inverse=True)
    most = np.zeros(len(wanted), np.int64)
    for i, size in enumerate(wanted.tolist()):
        longest = int(size / similarity + 1e-9)
        longer = np.arange(max(size, short + 1), (longest if upto is None else min(longest, upto)) + 1)
        if len(longer):
            most[i] = (size - longer + run * np.floor(longer * (1 - similarity) + 1e-9).astype(np.int64)).max() + 1
    return most[at]


def run_places(codes: np.ndarray, sizes: np.ndarray, run: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line numbers, hashes and places in their lines of the runs of each line of `least` words or more."""
    line = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    starts = np.flatnonzero((np.arange(len(codes)) + run <= end) & (sizes[line] >= least))
    packed = np.zeros(len(starts), np.uint64)
    for step in range(run):
        packed = packed << np.uint64(64 // run) | codes[starts + step]
    line = line[starts]
    return line, mixed(packed), starts - (end[starts] - sizes[line])


def runs_of_lines(codes: np.ndarray, sizes: np.ndarray, run: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Line numbers and hashes of the different runs of each line of `least` words or more, by line and hash."""
    line, hashed, _ = run_places(codes, sizes, run, least)
    order = np.lexsort((hashed, line))
    line, hashed = line[order], hashed[order]
    new = changes(line, hashed) if len(line) else np.zeros(0, np.int64)
    return line[new], hashed[new]


def ranks_of(line: np.ndarray) -> np.ndarray:
    """The place of each row within its stretch of equal line numbers, from 0."""
    first = np.flatnonzero(np.diff(line, prepend=-1) != 0)
    return np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))


def smallest_runs(codes: np.ndarray, sizes: np.ndarray, run: int, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Line numbers and hashes: of each line of `least` words or more the `most` smallest different runs."""
    line, hashed = runs_of_lines(codes, sizes, run, least)
    rank = ranks_of(line)
    return line[rank < most], hashed[rank < most]


def counts_of(hashed: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The counts in `frequent` of the hashes, 0 of those that it lacks."""
    known, counts = frequent
    count = np.zeros(len(hashed), np.int64)
    if len(known):
        # Most runs are not known; a table of the first bits tells most of these.
        first = np.zeros(1 << 22, bool)
        first[known >> np.uint64(42)] = True
        some = np.flatnonzero(first[hashed >> np.uint64(42)])
        at = np.minimum(np.searchsorted(known, hashed[some]), len(known) - 1)
        count[some] = np.where(known[at] == hashed[some], counts[at], 0)
    return count


def rarest_runs(
    codes: np.ndarray, sizes: np.ndarray, run: int, most: np.ndarray, least: int, frequent: tuple[np.ndarray, np.ndarray], hot: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line numbers, hashes, whether for the pivot only, and places: of each line the first `most` runs, those in `frequent` last.

    `frequent` holds hashes, sorted, and counts; it decides the order alone. A line of which over a third of the runs have
    counts above `hot` also gives its most frequent run, for the pivot. The place is NOWHERE for runs that a line has
    more than once, for those of the pivot, and for all of lines of over NOWHERE words.
    """
    line, hashed, place = run_places(codes, sizes, run, least)
    count = counts_of(hashed, frequent)
    order = np.lexsort((hashed, count, line))
    line, hashed, count, place = line[order], hashed[order], count[order], place[order]
    new = changes(line, hashed) if len(line) else np.zeros(0, np.int64)
    once = np.diff(np.append(new, len(line))) == 1
    line, hashed, count = line[new], hashed[new], count[new]
    place = np.where(once & (sizes[line] <= NOWHERE), place[new], NOWHERE)
    given = ranks_of(line) < most[line]
    last = np.flatnonzero((np.diff(line, append=-1) != 0) & (most[line] > 0))
    crowded = 3 * np.bincount(line, weights=count > hot, minlength=len(sizes)) > np.bincount(line, minlength=len(sizes))
    last = last[crowded[line[last]]]
    pivot = np.concatenate([np.zeros(int(given.sum()), bool), np.ones(len(last), bool)])
    places = np.concatenate([place[given], np.full(len(last), NOWHERE)])
    return np.concatenate([line[given], line[last]]), np.concatenate([hashed[given], hashed[last]]), pivot, places


def short_forms(codes: np.ndarray, sizes: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Line numbers and hashes: of each line of `least` to `most` words itself, and itself without each word."""
    starts = np.cumsum(sizes) - sizes
    lines, forms = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for size in range(least, most + 1):
        these = np.flatnonzero(sizes == size)
        if not len(these):
            continue
        words = codes[starts[these][:, None] + np.arange(size)]
        for part in [words, *(np.delete(words, at, axis=1) for at in range(size))]:
            width = part.shape[1]
            forms.append(sequence_hashes(part.ravel(), np.arange(len(these)) * width, np.full(len(these), width)))
            lines.append(these)
    return np.concatenate(lines), np.concatenate(forms)


def parts_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Nodes, codes and numbers of words of stretches of a batch, of about CHUNK words or one line each."""
    binary = batch.column(1).cast(pa.large_binary())
    sizes = pc.binary_length(binary).to_numpy(zero_copy_only=False) // 2
    total, low = np.cumsum(sizes), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + CHUNK, "right")))
        codes = np.frombuffer(b"".join(binary.slice(low, high - low).to_pylist()), ">u2").astype(np.uint64)
        yield batch.column(0).slice(low, high - low), codes, sizes[low:high]
        low = high


def every_run(batches: Iterator[pa.RecordBatch], run: int, long: int, longer: tuple[int, int] | None = None) -> Iterator[pa.RecordBatch]:
    """From `_node`, `_code` to `block`, one row for each different run of a line, numbered as by `keys_of`."""
    for batch in batches:
        for _, codes, sizes in parts_of(batch):
            found = [runs_of_lines(codes, sizes, run, long)[1]] if longer is None else []
            if longer is not None:
                # Runs of `run` words are given up to the longest line that is not compared by longer ones.
                below = np.where(sizes < longer[1], sizes, 0)
                found = [runs_of_lines(codes[np.repeat(below > 0, sizes)], below[below > 0], run, long)[1], runs_of_lines(codes, sizes, longer[0], long)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["block"])


def keys_of(
    batches: Iterator[pa.RecordBatch], run: int, most: int, long: int, least: int, short: int, similarity: float | None = None,
    frequent: tuple[np.ndarray, np.ndarray] | None = None, hot: float = 0, longer: tuple[int, int] | None = None,
) -> Iterator[pa.RecordBatch]:
    """From `_node`, `_code` to `_node`, `_sim` (words), `block`, `place`, one row a key: runs of long lines, forms of short ones.

    With a similarity, a line gives as many runs as `prefix_sizes` says, the rarest first, and each form once; the lowest bit of
    a block is 1 just for keys that serve the pivot only. With `longer`, a number of words in a run and one in a line, pairs of
    which the longer line has so many words meet by runs of so many words alone, and places of runs are given.
    """
    for batch in batches:
        for nodes, codes, sizes in parts_of(batch):
            forms = short_forms(codes, sizes, least, short)
            place = None
            if similarity is None:
                runs = smallest_runs(codes, sizes, run, most, long)
                line, block = np.concatenate([runs[0], forms[0]]), np.concatenate([runs[1], forms[1]])
            else:
                first = prefix_sizes(sizes, run, similarity, short, longer and longer[1] - 1)
                kinds = [(run, first)] if longer is None else [(run, first), (longer[0], prefix_sizes(sizes, longer[0], similarity, longer[1] - 1))]
                runs = [rarest_runs(codes, sizes, words, first, long, frequent, hot) for words, first in kinds]
                line, hashed, pivot, place = (np.concatenate(parts) for parts in zip(*runs))
                form = np.unique(np.rec.fromarrays([forms[0], forms[1] >> np.uint64(1) << np.uint64(1)]))
                line, block = np.concatenate([line, form.f0]), np.concatenate([hashed >> np.uint64(1) << np.uint64(1) | pivot.astype(np.uint64), form.f1])
                place = np.concatenate([place, np.full(len(form), NOWHERE)])
            if longer is None:
                place = np.full(len(line), NOWHERE)
            arrays = [nodes.take(pa.array(line)), pa.array(sizes[line].astype(np.int32)), pa.array(block.view(np.int64)), pa.array(place.astype(np.uint8))]
            yield pa.RecordBatch.from_arrays(arrays, ["_node", "_sim", "block", "place"])


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any of the columns, the first row included."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([column[1:] != column[:-1] for column in columns], axis=0)
    return np.flatnonzero(new)


def stretches(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of each stretch of `values` as one binary value."""
    offsets = np.append(starts, len(values)).astype(np.int32) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return values.astype(np.uint8), (values >> 8).astype(np.uint8)


def packed(
    number: np.ndarray, sim: np.ndarray, block: np.ndarray, place: np.ndarray, bits: int, crowded: tuple[np.ndarray, np.ndarray]
) -> pa.RecordBatch:
    """Keys as one row for each part and base: 32 bits of the block, 16 of the number, 13 of the words, 1 for the pivot, 8 of the place.

    Low and high bytes are kept apart, as the high ones hardly change and take next to nothing once they are compressed.
    A part is the first `bits` bits of the block, so that a part of keys holds whole groups. Keys in `crowded` (sorted, and
    their numbers of lines) are dealt to the parts by base instead, with their block, as their groups may be of any size.
    """
    pivot = block & np.uint64(1)
    sims = (np.minimum(sim, SIZED).astype(np.uint64) | pivot << np.uint64(15)).astype("<u2")
    whole, lines = np.zeros(len(block), np.uint64), np.zeros(len(block), np.int64)
    part = block >> np.uint64(64 - bits)
    if len(crowded[0]):
        at = np.minimum(np.searchsorted(crowded[0], block - pivot), len(crowded[0]) - 1)
        known = crowded[0][at] == block - pivot
        whole[known], lines[known] = block[known], crowded[1][at[known]]
        part[known] = ((number[known] // BASE) % (1 << bits)).astype(np.uint64)
    order = np.argsort(part.astype(np.uint16 if bits <= 16 else np.uint32), kind="stable")
    if lines.any():
        order = order[np.lexsort((whole[order], part[order]))]
    number, sims, block, whole, lines, part, place = (values[order] for values in (number, sims, block, whole, lines, part, place))
    base = number // BASE
    starts = changes(part, whole, base)
    rest = (block << np.uint64(bits) >> np.uint64(32)).astype("<u4")
    arrays = [pa.array(part[starts].astype(np.int32)), pa.array(whole[starts].view(np.int64)), pa.array(lines[starts]), pa.array(base[starts])]
    spots = (number % BASE).astype("<u2")
    arrays += [stretches(values, starts) for values in (rest, *halves(spots), *halves(sims), place.astype(np.uint8))]
    return pa.RecordBatch.from_arrays(arrays, PACKED_NAMES)


PACKED_NAMES = ["part", "whole", "n", "base", "rest", "spot", "spot_high", "sims", "sims_high", "place"]
PACKED_KEYS = "part int, whole long, n long, base long, rest binary, spot binary, spot_high binary, sims binary, sims_high binary, place binary"


def packed_keys(batches: Iterator[pa.RecordBatch], bits: int, crowded: tuple[np.ndarray, np.ndarray], **options) -> Iterator[pa.RecordBatch]:
    """The keys of `keys_of`, packed; nodes are numbers from 0 here."""
    held, count = [], 0
    for found in keys_of(batches, **options):
        if found.num_rows:
            held.append((found.column(0).to_numpy(), found.column(1).to_numpy(), found.column(2).to_numpy().view(np.uint64), found.column(3).to_numpy()))
            count += found.num_rows
        if count >= PACKED:
            yield packed(*map(np.concatenate, zip(*held)), bits, crowded)
            held, count = [], 0
    if count:
        yield packed(*map(np.concatenate, zip(*held)), bits, crowded)


MEETING = "a long, b long, sim int, block long, n long, sign long"


def pairs_within(starts: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of rows of the groups that start at `starts` with `n` rows each, about PAIRS at a time."""
    total, low = np.cumsum(n * (n - 1) // 2), 0
    while low < len(n):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + PAIRS, "right")))
        sizes = n[low:high]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place, after = np.repeat(starts[low:high], sizes) + within, np.repeat(sizes, sizes) - 1 - within
        left = np.repeat(place, after)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
        low = high


def may_align(one: np.ndarray, other: np.ndarray, place: np.ndarray, place_other: np.ndarray, similarity: float) -> np.ndarray:
    """Whether lengths, and places of a run that both lines have once, allow the similarity.

    The edits before and after a run that no edit breaks are different ones: at least as many as the lengths before it
    and after it differ by.
    """
    apart = one.astype(np.int64) - other
    shift = place.astype(np.int64) - place_other
    outside = np.maximum(np.maximum(shift - np.maximum(apart, 0), np.minimum(apart, 0) - shift), 0)
    outside[(place == NOWHERE) | (place_other == NOWHERE)] = 0
    return np.abs(apart) + 2 * outside <= np.maximum(one, other) * (1 - similarity) + 1e-9


def meeting(keys: pa.Table, few: int, similarity: float) -> pa.Table:
    """What the packed keys of one part have in common, one row a pair or member.

    Groups of up to `few` give their pairs `a`, `b` whose lengths and places allow the similarity, once, with the number `n` of
    keys shared here; larger ones and those for the pivot their members `a` with words, block and size, the first member
    also a sign that groups of equal members share.
    """
    joined = lambda name, kind: np.frombuffer(b"".join(keys.column(name).to_pylist()), kind).astype(np.int64)
    sizes = pc.binary_length(keys.column("spot")).to_numpy()
    numbers = np.repeat(keys.column("base").to_numpy() * BASE, sizes) + joined("spot", "u1") + (joined("spot_high", "u1") << 8)
    sims, rest, place = joined("sims", "u1") + (joined("sims_high", "u1") << 8), joined("rest", "<u4"), joined("place", "u1")
    pivot, sim = sims >> 15, (sims & SIZED).astype(np.int32)
    block = np.int64(keys.column("part")[0].as_py()) << 33 | rest << 1 | pivot
    whole, lines = keys.column("whole").to_numpy(), keys.column("n").to_numpy()
    crowded = np.repeat(lines > 0, sizes)
    open_rows = np.flatnonzero(~crowded)
    order = open_rows[np.argsort(block[open_rows], kind="stable")]
    same = block[order][1:] == block[order][:-1]
    order = order[np.append(same, False) | np.insert(same, 0, False)] if len(order) else order
    order = order[np.lexsort((numbers[order], block[order]))]
    starts = changes(block[order]) if len(order) else np.zeros(0, np.int64)
    n = np.diff(np.append(starts, len(order)))
    small = (n <= few) & (pivot[order[starts]] == 0)
    # Rows are not made one a line before pairs are counted: different runs of a line may agree in the bits that are kept.
    known, local = np.unique(numbers[order], return_inverse=True)
    found = [np.zeros(0, np.int64)]
    for left, right in pairs_within(starts[small], n[small]):
        one, other = order[left], order[right]
        close = (local[left] != local[right]) & may_align(sim[one], sim[other], place[one], place[other], similarity)
        found.append(local[left[close]] * len(known) + local[right[close]])
    found, counts = np.unique(np.concatenate(found), return_counts=True)
    a, b = np.divmod(found, max(1, len(known)))
    pairs = pa.table({"a": known[a], "b": known[b], "n": counts.astype(np.int64)})
    members = order[np.repeat(~small & (n > 1), n)]
    members = members[changes(block[members], numbers[members])] if len(members) else members
    starts = changes(block[members]) if len(members) else np.zeros(0, np.int64)
    n = np.diff(np.append(starts, len(members)))
    heads = np.zeros(len(members), bool)
    heads[starts] = True
    signs = np.bitwise_xor.reduceat(mixed(numbers[members].astype(np.uint64)), starts).view(np.int64) if len(members) else np.zeros(0, np.int64)
    rows = pa.table({
        "a": numbers[members], "sim": sim[members], "block": block[members], "n": np.repeat(n, n).astype(np.int64),
        "sign": pa.array(np.repeat(signs, n), mask=~heads),
    })
    hot = np.flatnonzero(crowded)
    blocks = np.repeat(whole, sizes)[hot]
    frequent = pa.table({"a": numbers[hot], "sim": sim[hot], "block": blocks, "n": np.repeat(lines, sizes)[hot], "sign": blocks})
    return pa.concat_tables([pairs, rows, frequent], promote_options="default").select(["a", "b", "sim", "block", "n", "sign"])


def bags(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """BAG numbers of 64 bits for each line, with a bit for each of its words by a hash; a word's second time is another word."""
    line = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(line.astype(np.uint64) << np.uint64(16) | codes, kind="stable")
    word = line[order].astype(np.uint64) << np.uint64(16) | codes[order]
    time = ranks_of(word.astype(np.int64)).astype(np.uint64)
    bit = mixed((word & np.uint64(0xFFFF)) | time << np.uint64(16)) >> np.uint64(64 - 9)
    bits = np.zeros((len(sizes), 64 * BAG), np.uint8)
    bits[line[order], bit.astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.int64)


BAGS = [f"bag{i}" for i in range(BAG)]


def kinds(codes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """How many words of each of KINDS kinds, by a hash, each line of over BULKY words has, up to 255; null for the others."""
    bulky = np.flatnonzero(sizes > BULKY)
    starts = np.cumsum(sizes) - sizes
    counts = [np.bincount((mixed(codes[at : at + size]) % np.uint64(KINDS)).astype(np.int64), minlength=KINDS) for at, size in zip(starts[bulky], sizes[bulky])]
    values = np.minimum(np.concatenate(counts), 255).astype(np.int16) if counts else np.zeros(0, np.int16)
    offsets = np.concatenate([[0], np.cumsum(np.where(sizes > BULKY, KINDS, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(sizes <= BULKY))


def with_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_node`, `_code`, its `kinds` and its `bags`."""
    for batch in batches:
        low = 0
        for nodes, codes, sizes in parts_of(batch):
            found = bags(codes, sizes)
            arrays = [nodes, batch.column(1).slice(low, len(sizes)), kinds(codes, sizes), *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(BAG))]
            yield pa.RecordBatch.from_arrays(arrays, ["_node", "_code", "kinds", *BAGS])
            low += len(sizes)


def alike(members: pa.Table, similarity: float) -> pa.Table:
    """Pairs `a`, `b` of lines with different roots whose lengths, bags and kinds allow the similarity.

    `members` has `_node`, `_sim`, `_root`, `tile`, the kinds and the bags. Of lines with different tiles all pairs of these count, else
    all pairs. An edit changes one word, so a line has at most as many words that the other lacks as there are edits.
    """
    order = np.argsort(members.column("_sim").to_numpy(), kind="stable")
    node, sim, root, tile = (members.column(name).to_numpy()[order] for name in ("_node", "_sim", "_root", "tile"))
    bag = np.stack([members.column(name).to_numpy()[order].view(np.uint64) for name in BAGS])
    full = np.bitwise_count(bag).sum(axis=0, dtype=np.int32)
    counted = pc.is_valid(members.column("kinds")).to_numpy()
    values = pc.list_flatten(members.column("kinds")).to_numpy().astype(np.int32).reshape(-1, KINDS)
    row_of = np.where(counted, np.cumsum(counted) - 1, -1)[order]
    # Most lines of a family have one root: they are not held against each other.
    roots, of, count = np.unique(root, return_inverse=True, return_counts=True)
    most = of == np.argmax(count)
    across = bool(len(tile)) and bool((tile != tile[0]).any())
    left = np.flatnonzero(~most)
    ends = np.searchsorted(sim, (sim[left] / similarity + 1e-9).astype(np.int64), "right")
    starts = np.searchsorted(sim, np.ceil(sim[left] * similarity - 1e-9).astype(np.int64), "left")
    pairs, low = [np.zeros((2, 0), np.int64)], 0
    while low < len(left):
        widths = ends[low : low + PAIRS] - starts[low]
        high = low + max(1, int(np.searchsorted(widths * np.arange(1, len(widths) + 1), PAIRS // 4, "right")))
        first, last = int(starts[low]), int(ends[high - 1])
        these = left[low:high]
        shared = np.zeros((len(these), last - first), np.int32)
        for words in bag:
            shared += np.bitwise_count(words[these][:, None] & words[first:last])
        longest = np.maximum(sim[these][:, None], sim[first:last])
        allowed = np.where(longest < SIZED, np.floor(longest * (1 - similarity) + 1e-9), 64 * BAG).astype(np.int32)
        close = (full[these][:, None] - shared <= allowed) & (full[first:last] - shared <= allowed)
        close &= np.abs(sim[these][:, None] - sim[first:last]) <= allowed
        close &= (root[these][:, None] != root[first:last]) & (most[first:last] | (these[:, None] < np.arange(first, last)))
        if across:
            close &= tile[these][:, None] != tile[first:last]
        row, column = np.nonzero(close)
        one, other, most_apart = these[row], column + first, allowed[row, column]
        both = np.flatnonzero((row_of[one] >= 0) & (row_of[other] >= 0))
        keep = np.ones(len(one), bool)
        for at in np.array_split(both, len(both) // 20_000 + 1):
            apart = values[row_of[one[at]]] - values[row_of[other[at]]]
            keep[at] = np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1)) <= most_apart[at]
        pairs.append(np.stack([one[keep], other[keep]]))
        low = high
    one, other = (node[ends] for ends in np.concatenate(pairs, axis=1))
    return pa.table({"a": np.minimum(one, other), "b": np.maximum(one, other)})
