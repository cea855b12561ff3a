"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, connected groups.

A line is normalised to its lower-case words without digits and punctuation; lines of at least MIN_WORDS of them count. Equal normalised
lines are one node. Two nodes are linked if their SimHashes over words differ in at most RADIUS of BITS bits and their
edit similarity over words, 1 - distance / longer length, is at least SIMILARITY; for the distance a word is one
character by its hash, so one in 1,792 different words counts as equal (with `whole`, one in 53,248). Cut into RADIUS + 2 blocks, two such hashes
agree on two blocks at least, so nodes are joined on every pair of blocks (half the bits).

No radius that pays reaches pairs at SIMILARITY (at 0.8 to 0.9 the SimHashes of two lines differ in 6 bits in the middle
and 12 at the ninth decile), so with `whole`, as in the query and the pipeline, parts of lines are the blocks of the
pigeonhole argument instead of parts of hashes: runs of RUN words, of which an edit breaks at most RUN. A line gives its
rarest runs, as many as its similar lines may lack and one more (`line_codes.prefix_sizes`), so that two similar lines
always meet; there is no cap. Pairs of which one line has LONGER[1] words or more meet by runs of LONGER[0] words, of which
few are shared by chance however many lines there are: the edits that SIMILARITY allows never break all of these. Lines of
up to SHORT words, where one edit is all that it allows, give themselves and themselves without each word instead or as well. How frequent runs are is counted on about SAMPLED lines; that decides
nothing but the order in which a line's runs are given, and any order that all lines share gives the same links. Keys are
shuffled once, packed in parts of the key space with about eight bytes a key, and meet there in numpy: keys of one line
alone end there, groups of up to FEW lines leave as pairs, if the places of the run allow it, larger ones as members. Runs that the sample expects in over CROWD
lines are left out of the parts, as their groups have no bound. Groups above HOT are cut by length for their first members,
those above TILE are held together in pairs of tiles.
Lines that are largely made of frequent runs are first held against one pivot for their most frequent run, which connects
large families of near copies before members are held against each other. A pair is compared by edit distance only if its
bags of words, as bits, differ by no more words than there may be edits; members of large groups that are not connected
yet are held against each other by these bits alone, in numpy.
Words and keys come from numpy kernels on Arrow batches (`line_codes`): by expressions alone they took 380 task seconds
a GB, nearly all that the operator may use. Joins, groups and edit similarity are DataFrame operations either way.

A block group is not expanded into pairs. Each member is checked against the group's smallest; only those not linked
to it are checked against the others, unless other groups have connected them already, which links the same nodes.
Groups above GROUP are first cut finer, by the same pigeonholes over the bits that their blocks leave free. Each
connected group keeps its first occurrence, by document id, then a hash of the text, then line number; all its other
lines go.

With `whole`, as in the query and the pipeline, every line that is not blank counts: digits are part of the words, so
lines that differ in numbers are compared with them; each character of a script without spaces is a word; a line without
words is linked to equal lines. Lines below MIN_WORDS words are linked only if their words are equal, as one edit
already takes them below SIMILARITY.

Null texts stay null, without `whole` short and blank lines always stay, rows with equal id and text are treated as one row and keep
the same lines, rows with a null id come first, empty tables give empty results, and other columns pass through
whatever their names. Without `whole`, everything is built from DataFrame expressions. A line of any length is one
sequence of codes, two bytes a word.
"""

from __future__ import annotations

import itertools
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from moltraj.llm.components import components
from moltraj.llm.line_codes import BAGS, MEETING, PACKED_KEYS, alike, every_run, lines_of, meeting, packed_keys, with_bags
from moltraj.llm.shared import passing, table, written
from moltraj.scale import fits

MIN_WORDS = 5
RADIUS = 2
SIMILARITY = 0.8
GROUP = 4096
LEVELS = 3
BITS = 56
#: Words in a run, and lines above which a group is cut by length and a run counts as crowded.
RUN, HOT = 3, 256
#: Words in a run of pairs of which the longer line has so many words.
LONGER = (4, 16)
#: Keys that lines share which are held against each other first, and members of a group that are held against each other in one task.
LIKELY, TILE = 4, 4096
#: Lines, about, whose runs are counted to order runs by frequency; how many of the most frequent are told apart.
SAMPLED, FREQUENT = 100_000, 200_000
#: Lines up to SHORT words are compared without one word, those from LONG on by runs.
SHORT, LONG = 9, 8
#: Options of the query and of the pipeline's stage.
WHOLE = {"whole": True}
#: Lanes of a counter word: width in bits, so that a lane holds the votes of up to 2^(width - 1) - 1 words.
LANES = (7, 8, 14)
#: Node numbers and changed rows up to these many are broadcast; beyond, both sides are shuffled.
BROADCAST_NODES, BROADCAST_ROWS = 1_000_000, 300_000
BROADCAST_KEYS = 1_000_000
#: Words whose keys meet in one part; groups up to FEW are held pair by pair at once; runs expected in over CROWD lines are no part's.
PART, FEW, CROWD = 600_000, 32, 100_000
#: Characters that stand for a word in edit distances without `whole`: the code points of two bytes from here on.
FIRST_CODE, CODES = 0x100, 0x700


def line_words(line: Column) -> Column:
    """Runs of characters other than the ASCII and Latin-1 ones that are no small letters, and general punctuation."""
    return F.filter(F.split(line, "[\\x00-\\x60\\x7b-\\xbf\\u2000-\\u206f]+"), lambda word: word != "")


def any_of(parts: list[Column]) -> Column:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.bitwiseOR(part)
    return whole


def lane_majority(hashes: Column, width: int) -> Column:
    """Bit b is set if over half the hashes have it. Bits b, b + width, ... are counted side by side in one number.

    A number holds BITS / width lanes. Adding 2^(width - 1) - 1 - n / 2 to a count of n votes sets its lane's top bit
    just if it is over half.
    """
    ones = sum(1 << at for at in range(0, BITS, width))
    half = F.lit((1 << (width - 1)) - 1) - F.floor(F.size(hashes) / 2)
    parts = []
    for place in range(width):
        votes = F.aggregate(
            hashes, F.lit(0).cast("long"), lambda done, h: done + F.shiftright(h, place).bitwiseAND(F.lit(ones)),
        )
        tops = F.shiftright(votes + half * F.lit(ones), width - 1).bitwiseAND(F.lit(ones))
        parts.append(F.shiftleft(tops, place))
    return any_of(parts)


def bit_majority(hashes: Column) -> Column:
    """The same for any number of hashes, one pass for each bit."""
    voted = lambda bit: F.size(F.filter(hashes, lambda h: F.shiftright(h, bit).bitwiseAND(F.lit(1)) == 1))
    return any_of([F.when(2 * voted(bit) > F.size(hashes), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit in range(BITS)])


def simhash(hashes: Column) -> Column:
    found = F
    for width in LANES:
        found = found.when(F.size(hashes) < F.lit(1 << (width - 1)), lane_majority(hashes, width))
    return found.otherwise(bit_majority(hashes))


def line_rows(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """`_id`, `_version` (hash of the text), `_at`, `_code` (a character a word), `_node` (hash of the words) and `_sim` of every line that counts."""
    # Short lines go inside the array, and the outer form of explode is taken: filters, also those that Spark infers for
    # the inner form, would be pushed below and split every line twice.
    worded = lambda raw, at: F.struct(at.alias("at"), line_words(raw).alias("words"))
    lines = F.transform(F.split(F.lower(F.col(text)), "\n"), worded)
    counting = F.filter(lines, lambda line: F.size(line["words"]) >= min_words)
    # The text itself is left behind before the explode, or it would be copied for every line.
    packed = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.xxhash64(text).alias("_version"), counting.alias("_lines"))
    exploded = packed.select("_id", "_version", F.explode_outer("_lines").alias("_at")).where(F.col("_at").isNotNull())
    words = exploded.select("_id", "_version", F.col("_at.at").alias("_at"), F.col("_at.words").alias("_words"))
    hashed = words.withColumn("_hashes", F.transform("_words", lambda word: F.xxhash64(word)))
    return hashed.select(
        "_id", "_version", "_at", coded(F.col("_hashes")).alias("_code"), F.xxhash64("_hashes").alias("_node"), simhash(F.col("_hashes")).alias("_sim"),
    )


def whole_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The same without `_sim` for every line that is not blank, by a numpy kernel; `_code` is UTF-16, two bytes a word."""
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.xxhash64(text).alias("_version"), F.col(text).alias("_text"))
    schema = StructType([texts.schema["_id"], *whole_types()])
    return texts.mapInArrow(lines_of, schema)


def whole_types() -> list[StructField]:
    return [StructField("_version", LongType()), StructField("_at", IntegerType()), StructField("_node", LongType()), StructField("_code", BinaryType())]


def coded(hashes: Column) -> Column:
    """A string with one character for each word."""
    alphabet = F.array(*[F.lit(chr(FIRST_CODE + at)) for at in range(CODES)])
    return F.array_join(F.transform(hashes, lambda h: F.get(alphabet, F.pmod(h, F.lit(CODES)).cast("int"))), "")


def pigeonholes(positions: list[int], radius: int) -> list[int]:
    """A mask for each pair of radius + 2 blocks of `positions`."""
    blocks = [positions[i :: radius + 2] for i in range(radius + 2)]
    return [sum(1 << at for block in pair for at in block) for pair in itertools.combinations(blocks, 2)]


def finer(masks: list[int], radius: int) -> list[int]:
    return [mask | more for mask in masks for more in pigeonholes([i for i in range(BITS) if not mask >> i & 1], radius)]


def close(a: Column, b: Column, radius: int | None, similarity: float) -> Column:
    """Whether SimHashes, or without a radius numbers of words, allow the similarity."""
    if radius is None:
        return F.abs(a - b) <= F.greatest(a, b) * F.lit(1 - similarity) + F.lit(1e-9)
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def few(rows: DataFrame, most: int) -> DataFrame:
    """`rows`, to be broadcast if there are at most `most`."""
    return F.broadcast(rows) if fits(rows, most) else rows


def bagged(lines: DataFrame) -> DataFrame:
    """`lines` with the bags of their words."""
    return lines.select("_node", "_code").mapInArrow(with_bags, ", ".join(["_node long, _code binary, kinds array<smallint>", *(f"{bag} long" for bag in BAGS)]))


def similar(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b of nodes whose lines have at least the edit similarity, written. A node is one row of `nodes`."""
    with passing(pairs) as pairs:
        wanted = pairs.select(F.col("a").alias("_node")).unionByName(pairs.select(F.col("b").alias("_node"))).distinct()
        lines = nodes.select("_node", "_code").join(few(wanted, BROADCAST_NODES), "_node", "left_semi")
        whole = isinstance(nodes.schema["_code"].dataType, BinaryType)
        bags = [F.col(bag) for bag in BAGS] if whole else []
        if whole:
            full = sum((F.bit_count(bag) for bag in bags), F.lit(0)).alias("_full")
            lines = bagged(lines).select("_node", F.decode("_code", "UTF-16BE").alias("_code"), "kinds", full, *bags)
        with passing(lines) as lines:
            left, right = (lines.select([F.col(name).alias("_node" if name == "_node" else f"{name}_{side}") for name in lines.columns]) for side in ("a", "b"))
            both = pairs.join(left.withColumnRenamed("_node", "a"), "a").join(right.withColumnRenamed("_node", "b"), "b")
            longest = F.greatest(F.length("_code_a"), F.length("_code_b"))
            most = F.floor(longest * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")
            near = F.abs(F.length("_code_a") - F.length("_code_b")) <= most
            if whole:
                shared = sum((F.bit_count(F.col(f"{bag}_a").bitwiseAND(F.col(f"{bag}_b"))) for bag in BAGS), F.lit(0))
                near = near & (F.greatest("_full_a", "_full_b") - shared <= most)
                for one, other in (("kinds_a", "kinds_b"), ("kinds_b", "kinds_a")):
                    more = F.zip_with(one, other, lambda x, y: F.greatest(x - y, F.lit(0).cast("smallint")))
                    near = near & (F.coalesce(F.aggregate(more, F.lit(0), lambda done, x: done + x), F.lit(0)) <= most)
            within = F.call_function("levenshtein", F.col("_code_a"), F.col("_code_b"), most) >= 0
            return written(both.where(near & within).select("a", "b"))


def near_lines(nodes: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links a, b that connect all nodes with close hashes and similar lines."""
    found, masks = [], pigeonholes(list(range(BITS)), radius)
    branch, level = len(masks), nodes.select("_node", "_sim", F.lit(0).alias("path"))
    for depth in range(LEVELS):
        chosen = F.slice(F.array(*[F.lit(mask) for mask in masks]), F.col("path") * branch + 1, F.lit(branch))
        keyed = level.select("_node", "_sim", "path", F.posexplode(chosen).alias("at", "mask")).select(
            "_node", "_sim", (F.col("path") * branch + F.col("at")).alias("path"), F.col("_sim").bitwiseAND(F.col("mask")).alias("block")
        )
        groups = written(keyed.groupBy("path", "block").agg(F.count("*").alias("n")).where("n > 1"))
        small = groups if depth == LEVELS - 1 else groups.where(F.col("n") <= GROUP)
        found += star_links(written(keyed.join(small.select("path", "block"), ["path", "block"])), nodes, radius, similarity)
        hot = groups.where(F.col("n") > GROUP)
        if depth == LEVELS - 1 or hot.isEmpty():
            break
        level = written(keyed.join(hot.select("path", "block"), ["path", "block"]).select("_node", "_sim", "path"))
        masks = finer(masks, radius)
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def frequent_runs(nodes: DataFrame, count: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """Hashes, sorted, and counts of the most frequent runs of one line in so many, and that number. For the order of runs only."""
    one_in = max(1, count // SAMPLED)
    sampled = nodes.where(F.pmod("_node", F.lit(one_in)) == 0).select("_node", "_code")
    runs = sampled.mapInArrow(partial(every_run, run=RUN, long=LONG, longer=LONGER), "block long")
    counted = runs.groupBy("block").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "block").limit(FREQUENT)
    found = counted.toArrow()
    block = found.column("block").to_numpy().view(np.uint64)
    order = np.argsort(block)
    return (block[order], found.column("n").to_numpy()[order]), one_in


def line_nodes(rows: DataFrame) -> DataFrame:
    """`_node`, `_code` and a `_number` of each different line that can be similar to another one."""
    counting = rows.where(F.octet_length("_code") >= 2 * MIN_WORDS).select("_node", "_code")
    return written(counting.dropDuplicates(["_node"]).withColumn("_number", F.monotonically_increasing_id()))


def band_of(words: Column, similarity: float) -> Column:
    return F.floor(F.log(words.cast("double")) / F.log(F.lit(1 / similarity))).cast("int")


def near_runs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Links a, b that connect all of the `line_nodes` with similar lines, by the runs that they share."""
    if similarity < SIMILARITY:
        raise ValueError(f"runs of {RUN} words find all pairs from a similarity of {SIMILARITY} on, not of {similarity}")
    count, words = nodes.agg(F.count("*"), F.sum(F.octet_length("_code") / 2)).first()
    frequent, one_in = frequent_runs(nodes, count)
    lines_of_run = frequent[1] * one_in
    crowded = frequent[0] >> np.uint64(1) << np.uint64(1), lines_of_run
    crowded = tuple(values[lines_of_run > CROWD] for values in crowded)
    # A long line gives about 0.8 keys a word, a short one about one a word.
    bits = max(1, int((words or 0) / PART).bit_length())
    pack = partial(
        packed_keys, bits=bits, crowded=crowded, run=RUN, most=0, long=LONG, least=MIN_WORDS, short=SHORT, similarity=similarity,
        frequent=frequent, hot=max(2, HOT / one_in), longer=LONGER,
    )
    lines = nodes.select(F.col("_number").alias("_node"), "_code")
    keys = lines.mapInArrow(pack, PACKED_KEYS)
    few_members = FEW

    def met(part: pa.Table) -> pa.Table:
        return meeting(part, few_members, similarity)

    with passing(keys.groupBy("part").applyInArrow(met, MEETING)) as found:
        counted = written(found.where(F.col("b").isNotNull()).groupBy("a", "b").agg(F.sum("n").alias("shared")))
        # Near copies share many keys: of groups with the same members, by a hash, one says all. The kind of key is part of it.
        pivot = F.col("block").bitwiseAND(F.lit(1))
        each = found.where(F.col("sign").isNotNull()).groupBy("n", "sign", pivot.alias("pivot")).agg(F.min("block").alias("block"))
        # Every member of a crowded group has its block as the sign.
        each = few(written(each.select("block", "n")), BROADCAST_KEYS)
        members = found.where(F.col("b").isNull()).select(F.col("a").alias("_node"), F.col("sim").alias("_sim"), "block")
        members = written(members.join(each, "block"))
    # Each line is held against one that shares most with it, and members against the first of their groups: what that leaves
    # apart, later against the others. Lines whose lengths allow the similarity are in the same band or in neighbouring ones.
    band = band_of(F.col("_sim"), similarity)
    banded = members.withColumn("band", F.explode(F.when((pivot == 1) | (F.col("n") > HOT), F.array(band, band + 1)).otherwise(F.array(F.lit(-1)))))
    firsts = counted.groupBy("b").agg(F.min(F.struct(F.col("shared") < LIKELY, "a")).alias("_first")).select("_first.a", "b")
    asked = firsts
    for kind, least in ((1, ["_sim", "_node"]), (0, ["_node", "_sim"])):
        asked = asked.unionByName(first_pairs(banded.where(pivot == kind), ["block", "band"], least, similarity))
    asked = written(asked.distinct())
    known = similar(asked, lines, similarity)
    roots = written(components(known))
    root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"_root_{side}"))
    apart = counted.select("a", "b").unionByName(unconnected(members.where(pivot == 0), roots, lines, similarity)).distinct()
    apart = apart.join(root("a"), "a", "left").join(root("b"), "b", "left")
    apart = apart.where(F.coalesce("_root_a", "a") != F.coalesce("_root_b", "b")).select("a", "b")
    links = known.unionByName(similar(apart.join(asked, ["a", "b"], "left_anti"), lines, similarity))
    ends = few(links.select(F.explode(F.array("a", "b")).alias("_number")).distinct(), BROADCAST_NODES)
    named = written(nodes.select("_number", "_node").join(ends, "_number", "left_semi"))
    left, right = (named.select(F.col("_number").alias(side), F.col("_node").alias(f"node_{side}")) for side in ("a", "b"))
    return links.join(left, "a").join(right, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def first_pairs(members: DataFrame, group: list[str], least: list[str], similarity: float) -> DataFrame:
    """Pairs of members with the one of their group that is least by `least`, if lengths allow the similarity."""
    first = members.groupBy(*group).agg(F.min(F.struct(*least)).alias("_first"))
    first = first.select(*group, F.col("_first._node").alias("b"), F.col("_first._sim").alias("_sim_b"))
    pairs = members.withColumnRenamed("_node", "a").join(first, group).where((F.col("a") != F.col("b")) & close(F.col("_sim"), F.col("_sim_b"), None, similarity))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def unconnected(members: DataFrame, roots: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """Pairs of members of one block with different roots whose bags allow the similarity."""

    def held(cell: pa.Table) -> pa.Table:
        return alike(cell, similarity)

    rooted = members.join(roots.select(F.col("node").alias("_node"), "root"), "_node", "left").select("block", "n", "_node", "_sim", F.coalesce("root", "_node").alias("_root"))
    several = rooted.groupBy("block").agg(F.min("_root").alias("low"), F.max("_root").alias("high")).where("low < high").select("block")
    with passing(rooted.join(few(several, BROADCAST_KEYS), "block", "left_semi")) as rooted:
        wanted = few(rooted.select("_node").distinct(), BROADCAST_NODES)
        bags = bagged(lines.join(wanted, "_node", "left_semi")).drop("_code")
        tiles = F.ceil(F.col("n") / TILE).cast("int")
        dealt = rooted.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("_node"), F.col("tiles")).cast("int"))
        cells = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda other: F.least("tile", other) * F.col("tiles") + F.greatest("tile", other))
        dealt = dealt.select("block", F.explode(cells).alias("cell"), "_node", "_sim", "_root", "tile").join(bags, "_node")
        return written(dealt.groupBy("block", "cell").applyInArrow(held, "a long, b long").distinct())


def star_links(members: DataFrame, nodes: DataFrame, radius: int, similarity: float) -> list[DataFrame]:
    """Links to each group's first member, then those of the members that have none with the others.

    Members that these links connect are not held against each other.
    """
    group = ["path", "block"]
    first = members.groupBy(*group).agg(F.min(F.struct("_node", "_sim")).alias("_first"))
    first = first.select(*group, F.col("_first._node").alias("b"), F.col("_first._sim").alias("_sim_b"))
    rayed = members.withColumnRenamed("_node", "a").join(first, group).where(F.col("a") != F.col("b"))
    rays = similar(rayed.where(close(F.col("_sim"), F.col("_sim_b"), radius, similarity)).select("a", "b").distinct(), nodes, similarity)
    roots = components(rays)
    rooted = members.join(roots.select(F.col("node").alias("_node"), "root"), "_node", "left").withColumn("_root", F.coalesce("root", "_node")).drop("root")
    alone = rayed.join(rays, ["a", "b"], "left_anti").select(*group, "a", F.col("b").alias("_first")).join(
        rooted.select(*group, F.col("_node").alias("a"), F.col("_sim").alias("_sim_a"), F.col("_root").alias("_root_a")), [*group, "a"]
    )
    others = rooted.withColumnRenamed("_node", "b").join(alone, group).where(F.col("b") != F.col("_first"))
    others = others.where((F.col("_root") != F.col("_root_a")) & close(F.col("_sim"), F.col("_sim_a"), radius, similarity))
    others = others.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return [rays, similar(others, nodes, similarity)]


def dropped_lines(rows: DataFrame, links: DataFrame) -> DataFrame:
    """`_id`, `_version` and `_drop`, the line numbers that go, for each row that loses any."""
    roots = components(links)
    repeated = rows.groupBy("_node").agg(F.count("*").alias("n")).where("n > 1").select("_node")
    grouped = repeated.unionByName(roots.select(F.col("node").alias("_node"))).unionByName(roots.select(F.col("root").alias("_node"))).distinct()
    classes = grouped.join(roots, grouped["_node"] == roots["node"], "left").select("_node", F.coalesce("root", "_node").alias("_root"))
    places = written(rows.select("_id", "_version", "_at", "_node").join(classes, "_node").drop("_node").distinct())
    first = places.groupBy("_root").agg(F.min(F.struct("_id", "_version", "_at")).alias("_first"))
    later = places.join(first, "_root").where(~F.struct("_id", "_version", "_at").eqNullSafe(F.col("_first")))
    return later.groupBy("_id", "_version").agg(F.collect_set("_at").alias("_drop"))


def deduplicated(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, radius: int = RADIUS, similarity: float = SIMILARITY,
    whole: bool = False,
) -> DataFrame:
    """`_row` (a struct of all columns, its text without the lines that go), `_lines` and `_dropped` of every row."""
    with passing(whole_rows(docs, key, text) if whole else line_rows(docs, key, text, min_words)) as rows:
        nodes = line_nodes(rows) if whole else written(rows.select("_node", "_sim", "_code").dropDuplicates(["_node"]))
        places = written(rows.select("_id", "_version", "_at", "_node"))
    gone = dropped_lines(places, near_runs(nodes, similarity) if whole else near_lines(nodes, radius, similarity))
    gone = few(written(gone), BROADCAST_ROWS)
    packed = docs.select(F.struct("*").alias("_row"))
    same = packed["_row"][key].eqNullSafe(gone["_id"]) & (F.xxhash64(packed["_row"][text]) == gone["_version"])
    joined = packed.join(gone, same, "left").select("_row", "_drop", F.split(packed["_row"][text], "\n").alias("_split"))
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.col("_drop")))
    kept = F.array_join(F.transform(left, lambda at: F.col("_split")[at]), "\n")
    new = F.when(F.size(F.coalesce("_drop", F.array().cast("array<int>"))) == 0, F.col("_row")[text]).otherwise(kept)
    fields = [new.alias(text) if name == text else F.col("_row")[name].alias(name) for name in docs.columns]
    counts = [F.coalesce(F.size("_split"), F.lit(0)).cast("long").alias("_lines"), F.size(F.coalesce("_drop", F.array().cast("array<int>"))).cast("long").alias("_dropped")]
    return joined.select(F.struct(*fields).alias("_row"), *counts)


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """`docs` with the same columns, its text without the lines that an earlier line repeats."""
    return deduplicated(docs, **options).select("_row.*")


def op6_fuzzy_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return deduplicated(docs, **WHOLE).select("_row.doc_id", "_row.text", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"))
