"""Token counts, the ORC store and packing against the tokenizers library."""

import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from moltraj.llm import packing, token_counts, token_store, vocabulary
from moltraj.llm.shared import shared_folder
from tests.llm import cases


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def encoded(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def random_texts(count):
    letters = list("ab'sS  \n\t.,1²\xa0 é́中ßİΣ\x1c\x85\x7f\x01\xad​😀") + ["<|endoftext|>", "<|startoftext|>", "'ll", " the"]
    draw = random.Random(7)
    return ["".join(draw.choice(letters if i % 3 else letters[:12]) for _ in range(draw.randint(0, 14))) for i in range(count)]


def test_chunks_encode_as_the_library_does():
    texts = random_texts(4000) + [t for t in cases.ODD_TEXTS if t is not None]
    for name, kind in (("byte_bpe_50k.json", vocabulary.ByteLevelIds), ("word_bpe_49k.json", vocabulary.WordIds)):
        tokenizer, ours = library(name), kind(vocabulary.vocabulary_text(name))
        for text in texts:
            assert ours.encode(text) == np.array(encoded(tokenizer, text), "<u4").tobytes(), repr(text)


def test_whole_tokens_are_proven_and_counts_agree():
    definition = vocabulary.vocabulary_text("byte_bpe_50k.json")
    whole = token_counts.whole_tokens(definition)
    tokenizer = library("byte_bpe_50k.json")
    assert len(whole) > 40_000 and "Ġthe" in whole
    ours = token_counts.ChunkCounts(definition, whole)
    for text in random_texts(4000):
        assert ours.count(text) == len(encoded(tokenizer, text)), repr(text)
    nothing = token_counts.ChunkCounts(definition, frozenset())
    assert all(nothing.count(text) == ours.count(text) for text in random_texts(300))


def test_a_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(vocabulary, "CACHE_ENTRIES", 10)
    ours = vocabulary.ByteLevelIds(vocabulary.vocabulary_text("byte_bpe_50k.json"))
    for at in range(200):
        ours.encode(f"start word{at} end")
    assert len(ours) <= 10


def test_merges_out_of_order_are_refused():
    rules = json.loads(vocabulary.vocabulary_text("byte_bpe_50k.json"))
    rules["model"]["merges"][0], rules["model"]["merges"][1] = rules["model"]["merges"][1], rules["model"]["merges"][0]
    with pytest.raises(ValueError):
        vocabulary.ByteLevelIds(json.dumps(rules))


@pytest.mark.parametrize("clashing", [False, True])
def test_token_counts_of_odd_rows(spark, clashing):
    tokenizer = library("byte_bpe_50k.json")
    got = token_counts.token_counts(cases.documents(spark, clashing)).collect()
    expected = Counter((row[0], len((row[1] or "").encode()), len(encoded(tokenizer, row[1]))) for row in cases.document_rows())
    assert Counter(tuple(row) for row in got) == expected
    assert token_counts.token_counts(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("clashing", [False, True])
def test_orc_store_round_trip(spark, clashing):
    tokenizer, path = library("word_bpe_49k.json"), shared_folder(spark)
    token_store.write_token_store(cases.documents(spark, clashing), path)
    store = token_store.read_token_store(spark, path)
    expected = Counter((row[0], tuple([*encoded(tokenizer, row[1]), 2])) for row in cases.document_rows())
    assert Counter((row["doc_id"], tuple(row["ids"])) for row in store.collect()) == expected
    rows = token_store.with_starts(token_store.document_digests(store)).collect()
    at = 0
    for row in sorted(rows, key=lambda r: r["start"]):
        assert row["start"] == at
        at += row["n_tokens"]
    keys = [row["doc_id"] for row in sorted(rows, key=lambda r: r["start"])]
    assert keys == sorted(keys, key=lambda key: (key is not None, key))
    sums = Counter((key, zlib.crc32(np.array(ids, "<u4").tobytes())) for (key, ids), n in expected.items() for _ in range(n))
    assert Counter((row["doc_id"], row["ids_crc32"]) for row in rows) == sums
    assert store.where("doc_id = 16").count() == 2


def test_orc_filters_reach_the_reader_and_empty_store(spark, capsys):
    path = shared_folder(spark)
    token_store.write_token_store(cases.documents(spark), path)
    token_store.read_token_store(spark, path).where("doc_id = 4").explain("formatted")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4)]" in capsys.readouterr().out
    path = shared_folder(spark)
    token_store.write_token_store(cases.empty(spark), path)
    assert token_store.with_starts(token_store.document_digests(spark.read.schema("shard int, doc_id bigint, ids array<int>").orc(path))).count() == 0


def test_fill_is_as_good_as_trying_all_subsets():
    draw = random.Random(3)
    for _ in range(200):
        counts = Counter(draw.randint(1, 30) for _ in range(draw.randint(0, 9)))
        room = draw.randint(0, 60)
        sums = {0}
        for length, n in counts.items():
            for _ in range(n):
                sums |= {s + length for s in sums if s + length <= room}
        chosen = packing.fill(dict(counts), room)
        assert all(n <= counts[length] for length, n in chosen.items())
        assert sum(length * n for length, n in chosen.items()) == max(sums)


def test_plan_uses_every_piece_once():
    draw = random.Random(5)
    for capacity in (1, 7, 64, 1024):
        counts = Counter(draw.randint(1, capacity) for _ in range(3000))
        used = Counter()
        for window, times in packing.minimum_bin_slack(dict(counts), capacity):
            assert times > 0 and sum(length * n for length, n in window.items()) <= capacity
            used.update({length: n * times for length, n in window.items()})
        assert used == counts


def check_packing(rows, expected, capacity):
    assert Counter(row["doc_id"] for row in rows if row["start"] == 0) == expected
    windows = {}
    for row in rows:
        windows.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return windows


@pytest.mark.parametrize("clashing", [False, True])
def test_packing_of_odd_rows(spark, clashing):
    tokenizer = library("byte_bpe_50k.json")
    cut = packing.pieces(cases.documents(spark, clashing), capacity=64)
    rows = packing.packed(cut, capacity=64).collect()
    windows = check_packing(rows, Counter(row[0] for row in cases.document_rows()), 64)
    padding = sum(64 - sum(length for _, length in parts) for parts in windows.values())
    assert padding < 64 * 2
    whole = Counter()
    for row in cases.document_rows():
        ids = [*encoded(tokenizer, row[1]), 0]
        for at in range(0, len(ids), 64):
            whole[row[0], at, len(ids), np.array(ids[at : at + 64], "<u4").tobytes()] += 1
    assert Counter((r["doc_id"], r["start"], r["doc_tokens"], bytes(r["ids"])) for r in rows) == whole
    placed = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packing.packed(cut, capacity=64)).collect()}
    assert set(placed) == set(windows)
    for row in rows:
        part = placed[row["sequence_id"]][4 * row["offset"] :]
        assert part.startswith(bytes(row["ids"]))


def test_one_length_with_most_rows_and_empty_table(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same text").otherwise(F.repeat(F.lit(" a"), (F.col("id") % 50).cast("int"))).alias("text"))
    rows = packing.packed(packing.pieces(docs, capacity=32), capacity=32).collect()
    windows = check_packing(rows, Counter(range(3000)), 32)
    tokens = sum(row["length"] for row in rows)
    assert sum(32 - sum(length for _, length in parts) for parts in windows.values()) <= 0.08 * tokens
    assert packing.packed(packing.pieces(cases.empty(spark))).count() == 0


def test_words_of_letters_need_no_tokens_of_the_library(monkeypatch):
    """op9 merges small letters by their ranks; the same ids, without an object for each token."""
    tokenizer, path = library("word_bpe_49k.json"), vocabulary.vocabulary_text("word_bpe_49k.json")
    draw = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzABCEINRSTÀÉßñöÿüŸ×÷'"
    words = ["".join(draw.choices(letters, k=draw.randrange(1, 14))) + draw.choice(["", "", ".", "!!", "%%%", ")", "<", "'s"]) for _ in range(20_000)]
    words += ["été", "don't", "a1b", "İx", "ſ", "K"]
    encoder = vocabulary.WordIds(path)
    for word in words:
        assert np.frombuffer(encoder.compute(word), "<u4").tolist() == tokenizer.encode(word, add_special_tokens=False).ids, word
    encoder = vocabulary.WordIds(path)
    monkeypatch.setattr(encoder, "model", None)
    for word in ("Thonthha", "Ètreai", "queestarrción", "größe"):
        assert np.frombuffer(encoder.compute(word), "<u4").tolist() == tokenizer.encode(word, add_special_tokens=False).ids


def test_op9_reads_its_store_once(spark):
    """starts need every document's digest twice; the ids are not read and summed again for that."""
    found = token_store.op9_orc_token_store(spark, "/root/testdata/sf0.001")
    assert not [path for path in found.inputFiles() if path.endswith(".orc")]
