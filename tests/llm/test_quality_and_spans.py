"""Quality rules, personal data and decontamination against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from moltraj.llm import decontaminate, personal_data, quality
from tests.llm import cases


def brute_counts(text):
    found = cases.words(text)
    grams = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    often, covered = Counter(grams), set()
    for i, gram in enumerate(grams):
        if often[gram] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in (text or "").split("\n") if cases.words(line)]
    return (
        len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


@pytest.mark.parametrize("clashing", [False, True])
def test_quality_counts_of_odd_rows(spark, clashing):
    draw = random.Random(1)
    rows = cases.document_rows() + [(100 + i, " ".join(draw.choice("ab c #x d%".split(" ")) for _ in range(draw.randint(0, 40))), "en", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    if clashing:
        docs = docs.selectExpr("*", "'own' AS n_words", "'own' AS _words", "'own' AS bucket", "'own' AS _trusted")
    trusted = spark.createDataFrame([(16,), (16,), (None,), (9999,)], "doc_id bigint")
    got = quality.quality(docs, trusted).collect()
    assert Counter((r["doc_id"], *tuple(r)[1:6]) for r in got) == Counter((row[0], *brute_counts(row[1])) for row in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert (r["score"] is None) == (r["n_words"] == 0)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)
    assert quality.quality(docs.limit(0), trusted).count() == 0


def test_scores_are_mean_log_ratios(spark):
    """With the documents' own words in few buckets, against counts made by hand."""
    docs = spark.createDataFrame([(1, "a b a"), (2, "c c d"), (3, "a b")], "doc_id bigint, text string")
    trusted = spark.createDataFrame([(1,)], "doc_id bigint")
    grams = {r["doc_id"]: r["g"] for r in docs.select("doc_id", quality.hashed_grams(quality.split_words(docs["text"]), 64).alias("g")).collect()}
    raw, target = Counter(g for found in grams.values() for g in found), Counter(grams[1])
    ratio = lambda g: math.log((target[g] + 1) / (target.total() + 64)) - math.log((raw[g] + 1) / (raw.total() + 64))
    for r in quality.quality(docs, trusted, buckets=64).collect():
        assert r["score"] == pytest.approx(sum(map(ratio, grams[r["doc_id"]])) / len(grams[r["doc_id"]]))


def brute_spans(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match[0])
            holds = {
                "email": lambda: True, "ip": lambda: all(int(part) <= 255 for part in match[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and personal_data.luhn(digits), "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]
            if holds():
                out.append((*match.span(), kind))
    return sorted(out, key=lambda s: (s[0], personal_data.KINDS.index(s[2])))


def test_base_spans_equal_a_search_of_the_patterns():
    draw, finder = random.Random(3), personal_data.Finder()
    alphabets = ["a@.1290+-(5 )b:/é", "0123456789012345678 -.+", "@@..aa1"]
    for i in range(20000):
        text = "".join(draw.choice(alphabets[i % 3]) for _ in range(draw.randint(0, 40)))
        assert [s for s in finder.spans(text) if s[2] in personal_data.BASE] == brute_spans(text), text


def test_added_spans():
    text = "my account: 12345678 and IBAN DE89 3704 0044 0532 0130 00 or https://bob:pw@host.org/x passport no. AB1234567 iban DE00 3704 0044 0532 0130 00"
    found = {(kind, text[a:b]) for a, b, kind in personal_data.Finder().spans(text)}
    assert {("account", "12345678"), ("iban", "DE89 3704 0044 0532 0130 00"), ("url", "https://bob:pw@host.org/x"), ("account", "AB1234567")} <= found
    assert ("iban", "DE00 3704 0044 0532 0130 00") not in found


@pytest.mark.parametrize("clashing", [False, True])
def test_personal_data_of_odd_rows(spark, clashing):
    docs = cases.documents(spark, clashing)
    rows = spark.createDataFrame([(1, "é a@b.co 😀 +1 (555) 123-4567"), (2, None), (2, None), (3, ""), (None, "1.2.3.4")], "doc_id bigint, text string")
    got = Counter((r["doc_id"], tuple((f["start"], f["end"], f["kind"]) for f in r["found"])) for r in personal_data.personal_spans(rows).collect())
    assert got == Counter({(1, ((2, 8, "email"), (11, 28, "phone"))): 1, (2, ()): 2, (3, ()): 1, (None, ((0, 7, "ip"),)): 1})
    assert {r["text"] for r in personal_data.redacted(rows).collect()} == {"é <email> 😀 <phone>", None, "", "<ip>"}
    assert personal_data.personal_spans(docs).count() == docs.count() and personal_data.personal_spans(cases.empty(spark)).count() == 0


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items):
    found, hit, behind = plain_words(text), set(), set()
    for item, body in items:
        split = plain_words(body)
        size = min(13, len(split))
        windows = {tuple(split[j : j + size]) for j in range(len(split) - size + 1)} if size and item is not None else set()
        for j in range(len(found) - size + 1):
            if size and tuple(found[j : j + size]) in windows:
                hit |= set(range(j, j + size))
                behind.add(str(item))
    return len(found), len(hit), tuple(sorted(behind))


@pytest.mark.parametrize("most", [3, 200_000])
def test_window_hits_against_brute_force(spark, most):
    """Also in blocks of one item each."""
    draw = random.Random(6)
    vocabulary = "alpha beta GAMMA delta é5 zeta".split()
    body = " ".join(draw.choice(vocabulary) for _ in range(60))
    items = [(1, body), (10, body[60:200]), (2, "zeta, alpha!"), (3, None), (4, "..."), (None, "beta beta"), (1, "delta delta delta")]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 30))) for _ in range(30)]
    texts += [None, "", "intro " + body.replace("alpha", "ALPHA") + " outro", body[:90] + " x " + body[100:250], "é" * 3000]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)] + [(0, texts[0], "own")], "doc_id bigint, text string, n_words string").coalesce(2)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    hits = decontaminate.window_hits(docs, benchmark, most=most)
    got = [(r["doc_id"], r[hits.n_words], r["n_hit"], tuple(r[hits.items])) for r in hits.rows.withColumn("n_hit", hits.hit_words()).collect()]
    expected = [(i, *brute_hits(t, items)) for i, t in enumerate(texts)] + [(0, *brute_hits(texts[0], items))]
    assert Counter(got) == Counter(expected)
    if most > 3:
        kept = decontaminate.without_documents(docs, benchmark)
        assert kept.columns == docs.columns
        clean = Counter(i for i, n, hit, _ in expected if not (hit and 20 * hit >= n))
        assert Counter(r["doc_id"] for r in kept.collect()) == clean
        cut = {r["doc_id"]: r["text"] for r in decontaminate.without_spans(docs, benchmark).collect()}
        assert cut[32].strip() == "intro  outro" and cut[30] is None and len(cut) == len(texts)


def test_decontamination_of_empty_tables(spark):
    docs, nothing = cases.documents(spark, True), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.without_documents(docs, nothing).count() == docs.count()
    assert decontaminate.without_documents(cases.empty(spark), nothing).count() == 0


def test_contract_columns():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
