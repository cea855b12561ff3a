"""Fuzzy lines by runs of words against brute force over edit similarity alone."""

import itertools
import random

import pytest

from moltraj.llm import line_dedup
from tests.llm.test_duplicates import distance


def edited(words, edits, draw, vocabulary):
    words = list(words)
    for _ in range(edits):
        at, kind = draw.randrange(len(words)), draw.choice("sid")
        if kind == "s":
            words[at] = draw.choice(vocabulary)
        elif kind == "i":
            words.insert(at, draw.choice(vocabulary))
        elif len(words) > 5:
            del words[at]
    return words


def similar_lines(seed=5):
    """Lines of 5 to 80 words with a copy each that is edited as far as the similarity allows, and less."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    lines = []
    for size in [*range(5, 41), 60, 80] * 3:
        base = [draw.choice(vocabulary) for _ in range(size)]
        lines += [base, edited(base, draw.choice([size // 5, size // 5, max(1, size // 10)]), draw, vocabulary)]
    return lines


def test_recall_at_the_similarity(spark):
    lines = similar_lines()
    longest = lambda i, j: max(len(lines[i]), len(lines[j]))
    # Lines of different bases are drawn apart; those that share a third of their words are compared all the same.
    sharing = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if 3 * len(set(lines[i]) & set(lines[j])) >= longest(i, j)]
    pairs = [(i, j) for i, j in sharing if distance(lines[i], lines[j]) <= 0.2 * longest(i, j) + 1e-9]
    docs = spark.createDataFrame([(i, " ".join(line)) for i, line in enumerate(lines)], "doc_id long, text string")
    kept = {r["doc_id"]: r["_dropped"] for r in line_dedup.deduplicated(docs, **line_dedup.WHOLE).select("_row.doc_id", "_dropped").collect()}
    low = [p for p in pairs if distance(lines[p[0]], lines[p[1]]) > 0.1 * longest(*p)]
    assert len(pairs) > 90 and len(low) > 40
    for some in (pairs, low):
        assert sum(kept[j] for _, j in some) >= 0.9 * len(some)
    near = {j for _, j in pairs}
    assert not any(n for i, n in kept.items() if i not in near)


def dropped(spark, lines):
    """How many of the lines, one a document, go."""
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    return {r["doc_id"] for r in line_dedup.deduplicated(docs, **line_dedup.WHOLE).where("_dropped > 0").select("_row.doc_id").collect()}


def test_short_lines_numbers_and_scripts_without_spaces(spark):
    han = "本站所有内容均受版权保护未经许可不得转载或用于任何商业用途违者必究"
    table = [f"{n} {n + 1} {n + 2} {n + 3} {n + 4} {n + 5}" for n in (100, 100, 700)]
    sold = [f"revenue of the group in {year}: {n}" for year, n in ((2021, 5), (2022, 7), (2021, 5))]
    lines = ["Les.", "les", "All rights reserved.", "ALL RIGHTS RESERVED", "***", "***", "---", "", "", "Page 3", "Page 4", han, han, han[:9] + "新" + han[10:]]
    assert dropped(spark, lines + table + sold) == {1, 3, 5, 12, 13, 15, 19}


def crowd(seed=3):
    """Lines around one frequent passage, alone, long and edited, and short ones that differ in a word at some place."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    passage = [draw.choice(words) for _ in range(30)]
    lines = [passage + [draw.choice(words) for _ in range(draw.randrange(6))] for _ in range(60)]
    for _ in range(40):
        long = [draw.choice(words) for _ in range(draw.randrange(30, 90))]
        at = draw.randrange(len(long))
        long = long[:at] + passage + long[at:]
        lines += [long, edited(long, len(long) // 12, draw, words)] if draw.random() < 0.4 else [long]
    phrase = [draw.choice(words) for _ in range(7)]
    for at in range(7):
        lines += [phrase[:at] + [draw.choice(words)] + phrase[at + 1 :] for _ in range(6)]
        lines += [phrase[:at] + [draw.choice(words)] + phrase[at:] for _ in range(4)]
    draw.shuffle(lines)
    return lines


@pytest.mark.parametrize("entire", [False, True])
def test_crowded_groups_agree_with_brute_force(spark, monkeypatch, entire):
    lines = crowd()
    if entire:
        lines.append(next(line for line in lines if len(line) == 7)[:6])
    monkeypatch.setattr(line_dedup, "HOT", 8)
    root = list(range(len(lines)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2)
             if abs(len(lines[i]) - len(lines[j])) <= 0.2 * max(len(lines[i]), len(lines[j]))
             and distance(lines[i], lines[j]) <= 0.2 * max(len(lines[i]), len(lines[j])) + 1e-9]
    for i, j in links:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    assert len(links) > 1000
    assert dropped(spark, [" ".join(line) for line in lines]) == {i for i in range(len(lines)) if top(i) != i}


def test_a_frequent_passage_makes_no_pairs_of_all_its_lines(spark, monkeypatch):
    """Candidates grow with the lines that hold the passage, not with their square."""
    draw = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    passage = words[:25]
    monkeypatch.setattr(line_dedup, "HOT", 16)
    compared = []
    similar = line_dedup.similar
    monkeypatch.setattr(line_dedup, "similar", lambda pairs, *rest: compared.append(pairs.count()) or similar(pairs, *rest))
    made = []
    for n in (200, 400):
        compared.clear()
        assert dropped(spark, [" ".join(passage + draw.choices(words, k=40)) for _ in range(n)]) == set()
        made.append(sum(compared))
    assert made[1] < 3 * made[0] and made[1] < 10 * 400


def by_brute_force(lines):
    """Numbers of the lines that an earlier line of their component repeats."""
    root = list(range(len(lines)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(lines)), 2):
        most = 0.2 * max(len(lines[i]), len(lines[j])) + 1e-9
        if abs(len(lines[i]) - len(lines[j])) <= most and distance(lines[i], lines[j]) <= most:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return {i for i in range(len(lines)) if top(i) != i}


def spread_edits(seed=11):
    """Lines with a copy each in which every fifth word differs, or that lacks every fifth, so that few runs are left."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(8))
    lines = []
    for size in [*range(5, 41), 60, 80, 150]:
        base = [word() for _ in range(size)]
        changed = [word() if at % 5 == 2 and at // 5 < size // 5 else w for at, w in enumerate(base)]
        lines += [base, changed]
        base = [word() for _ in range(size)]
        lines += [base, [w for at, w in enumerate(base) if at % 5 != 4] if size * 4 // 5 >= 5 else base]
    return lines


@pytest.mark.parametrize("hot", [256, 4])
def test_evenly_spread_edits_lose_no_pair(spark, monkeypatch, hot):
    """ten runs of four words a line miss pairs whose edits are spread evenly; no pair may be missed."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    lines = spread_edits()
    assert dropped(spark, [" ".join(line) for line in lines]) == by_brute_force(lines)


def test_lines_of_frequent_runs_alone_lose_no_pair(spark, monkeypatch):
    """lines from a handful of words, all of whose runs are frequent."""
    monkeypatch.setattr(line_dedup, "HOT", 4)
    draw = random.Random(4)
    lines = [draw.choices("abc", k=draw.randrange(5, 24)) for _ in range(250)]
    assert dropped(spark, [" ".join(line) for line in lines]) == by_brute_force(lines)


def test_candidates_and_their_lines_are_not_left_on_disk(spark):
    """of a search, only what later steps read stays: no line's words but those of the nodes."""
    from moltraj.llm import shared

    before = set(shared.WRITTEN)
    assert dropped(spark, [" ".join(line) for line in similar_lines()[:20]])
    left = [spark.read.parquet(path).columns for path in shared.WRITTEN if path not in before]
    assert sum("_code" in columns for columns in left) == 1


def test_shuffle_files_go_when_a_written_table_is_there(spark):
    """what a step has shuffled does not stay on disk until the driver collects garbage."""
    from moltraj.llm import shared

    tracked = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    rows = spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").count()
    setting, before = spark.conf.get(shared.CLEANUP), tracked()
    assert shared.written(rows).count() == 7
    assert tracked() <= before + 1  # of the count alone
    assert spark.conf.get(shared.CLEANUP) == setting
    assert sorted(r["k"] for r in rows.collect()) == list(range(7))


@pytest.mark.parametrize("few, hot", [(1, 256), (3, 8), (32, 8)])
def test_pairs_that_share_enough_keys_anywhere_are_found(spark, monkeypatch, few, hot):
    """keys shared in small and in large groups count together, so that no similar pair is left out."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "HOT", hot)
    draw = random.Random(7)
    phrases = [draw.choices([f"w{i}" for i in range(40)], k=4) for _ in range(8)]
    lines = spread_edits()[:80]
    for _ in range(120):
        base = sum(draw.choices(phrases, k=draw.randrange(2, 6)), []) + [f"x{draw.randrange(400)}" for _ in range(draw.randrange(3))]
        lines += [base, edited(base, draw.randrange(len(base) // 5 + 2), draw, [f"y{i}" for i in range(90)])]
    lines = [line for line in lines if len(line) >= 5]
    draw.shuffle(lines)
    assert dropped(spark, [" ".join(line) for line in lines]) == by_brute_force(lines)


@pytest.mark.parametrize("few", [1, 32])
def test_lines_that_share_one_run_by_chance_are_hardly_compared(spark, monkeypatch, few):
    """similar lines share more than one of the runs that they give; one shared by chance makes no pair of two others."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    compared = []
    similar = line_dedup.similar
    monkeypatch.setattr(line_dedup, "similar", lambda pairs, *rest: compared.append(pairs.count()) or similar(pairs, *rest))
    lines = [" ".join([f"a{i}x{j}" for j in range(15)] + [f"s{i // 12}", "t", "u"] + [f"b{i}x{j}" for j in range(15)]) for i in range(120)]
    assert dropped(spark, lines) == set()
    assert sum(compared) <= len(lines)


def test_lines_that_share_most_of_their_runs_are_hardly_compared(spark, monkeypatch):
    """lines around one passage share more runs than similar lines must, but not as many words."""
    compared = []
    similar = line_dedup.similar
    monkeypatch.setattr(line_dedup, "similar", lambda pairs, *rest: compared.append(pairs.count()) or similar(pairs, *rest))
    draw = random.Random(12)
    passage = [f"p{i}" for i in range(30)]
    lines = [passage + [f"x{draw.randrange(10**6)}" for _ in range(20)] for _ in range(90)]
    lines.append(lines[0][:20] + ["other"] + lines[0][21:])
    assert dropped(spark, [" ".join(line) for line in lines]) == {90}
    assert sum(compared) <= 4 * len(lines)
