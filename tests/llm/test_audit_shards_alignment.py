"""Filter audit, sharding and tokenizer alignment against plain models."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from ledgerloom.llm import alignment, interaction, sharding
from ledgerloom.session import scratch_folder

FILES = alignment.Files(
    public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
    public_tokenizers.path("piece_bpe_32k.model"),
)


# --- filter audit -------------------------------------------------------------------------


def _words(text):
    return text.translate({c: " " for c in range(9, 14)}).split(" ")


def _failed(rows):
    for doc_id, text, _ in rows:
        text = text or ""
        words = [w for w in _words(text) if w]
        failed = set()
        if len(words) < 200:
            failed.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            failed.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            failed.add("C")
        if any(c in "#$%&*|" for c in text):
            failed.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows):
            failed.add("E")
        yield failed


def _audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed = list(_failed(rows))
    result = {}
    for part in {lang or "" for _, _, lang in rows}:
        own = [(i, f) for (i, _, lang), f in zip(rows, failed) if (lang or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                shapley[letter] += len(gone)
                result[part, "".join(order), step] = [
                    len(left), len(gone), sum(letter in f for _, f in own) - len(gone),
                    sum(f == {letter} for _, f in own), sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), figures in result.items():
            if p == part:
                figures.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in result.items()}


AUDITED = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _audit_rows():
    rng = random.Random(5)
    long = " ".join(f"word{i}" for i in range(250))
    texts = [None, "", " \t\n", "ABC", long, long, long + " #", "same " * 300, long + "é", "X" * 40 + long, "\x0b".join("abc" * 90), long.upper()]
    rows = [(i, rng.choice(texts), rng.choice([None, "", "en", "de"])) for i in range(120)]
    rows += rows[:7] + [(3, long, "en"), (3, "other", "en"), (None, long, "en"), (None, None, None), (-5, long, "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(-10, 90)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("hot,known", [(1_000, 1 << 20), (2, 1 << 20), (3, 0)])
def test_audit_equals_filters_applied_in_turn(spark, monkeypatch, hot, known):
    rows, labels = _audit_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns(
        {"hash": F.lit("x"), "part": F.lit("y"), "bits": F.lit(7), "N": F.lit(1)}
    )
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit(1))
    whole = interaction.repeats
    monkeypatch.setattr(interaction, "repeats", lambda d: whole(d, hot, known))
    found = interaction.filter_interactions(docs, marks).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in AUDITED) for r in found}
    assert len(found) == len(got) == 600 * 4
    assert got == _audit(rows, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert interaction.filter_interactions(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    found = interaction.filter_interactions(one, labels).collect()
    assert len(found) == 600 and {r.part for r in found} == {""}
    assert all(r.removed == (r.filter_order[r.step - 1] == "A") for r in found)


# --- sharding -----------------------------------------------------------------------------


def _jump(key, shards):
    """The published algorithm on unsigned integers."""
    at, target = -1, 0
    while target < shards:
        at = target
        key = (key * 2862933555777941757 + 1) % 2**64
        target = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at


@pytest.mark.parametrize("shards", [1, 2, 3, 16, 17, 65, 66, 1000, 50_000])
def test_shards_equal_the_published_walk(spark, shards):
    rng = random.Random(shards)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 2**32, -(2**32)] + [rng.randrange(-(2**63), 2**63) for _ in range(300)]
    got = spark.createDataFrame([(k,) for k in keys], "k bigint").select(sharding.shard_of(F.col("k"), shards)).collect()
    assert [r[0] for r in got] == [_jump(k % 2**64, shards) for k in keys]


def test_walks_longer_than_the_first_stretch_go_on(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEPS", 2)
    keys = list(range(-200, 200))
    got = spark.createDataFrame([(k,) for k in keys], "k bigint").select(sharding.shard_of(F.col("k"), 500)).collect()
    assert [r[0] for r in got] == [_jump(k % 2**64, 500) for k in keys]


@pytest.mark.parametrize("piece", [10_000, 3])
def test_places_equal_a_plain_model(spark, monkeypatch, piece):
    monkeypatch.setattr(sharding, "PIECE", piece)
    rows = [(i, f"text {i % 7} é") for i in range(400)] + [(None, "x"), (None, None), (5, None), (5, ""), (5, "a" * 50_000)]
    rows += [(9, "hot")] * 500 + [(10**12, "far"), (-3, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {c: F.lit("z") for c in ("shard", "slot", "n", "cell", "_key", "held", "first")}
    )
    found = sharding.placed(docs).collect()
    keys = {r[0]: r[1] for r in docs.select("doc_id", sharding.key_of(F.col("doc_id"))).distinct().collect()}
    want = Counter()
    for doc_id, text in rows:
        data = (text or "").encode()
        key = keys[doc_id] % 2**64
        want[doc_id, len(data) + 1, zlib.crc32(data), _jump(key, 16), _jump(key, 17)] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in found) == want
    assert {r.law for r in found} == {"key"} and all(r.grown_shard in (r.shard, 16) for r in found)
    for shard in range(16):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_appended_shards_take_rows_only_into_themselves(spark):
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("from_shard"))
    moved = sharding.moves(docs, 10, 12).collect()
    assert docs.columns == ["doc_id", "from_shard"] and moved[0].from_shard == 1
    assert {r.to_shard for r in moved} == {10, 11} and all(r._from_shard < 10 for r in moved)
    assert abs(len(moved) / 4_000 - 2 / 12) < 0.03
    with pytest.raises(ValueError):
        sharding.moves(docs, 3, 2)


def test_written_shards_hold_every_row_once(spark):
    rows = [(i % 50, f"t{i}", "own") for i in range(300)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Shard string")
    folder = scratch_folder(spark, "shards") + "/rows"
    name = sharding.write_shards(docs, folder, 5, files=3)
    read = spark.read.parquet(folder)
    assert name == "_shard" and sorted(map(str, read.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert read.where(F.col(name) != sharding.shard_of(sharding.key_of(F.col("doc_id")), 5)).count() == 0


def test_shards_of_nothing(spark):
    assert sharding.placed(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit(1), 0)


# --- alignment ----------------------------------------------------------------------------

ends = st.lists(st.integers(1, 5), min_size=1, max_size=60)


@settings(max_examples=150, deadline=None)
@given(ends, ends, st.integers(1, 20))
def test_merge_paths_equal_every_pair_compared(a, b, work):
    a, b = np.cumsum(a), np.cumsum(b)
    # Both lists end at one place.
    a, b = (np.append(x[x < m], m) for x in (a, b) for m in [max(a[-1], b[-1])])
    spans = [list(zip([0, *x[:-1].tolist()], x.tolist())) for x in (a, b)]
    overlaps = [
        (i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if max(s, t) < min(e, f)
    ]
    of_a, of_b, cuts_a, cuts_b = alignment.merged(a, b, work)
    assert sorted(zip(of_a.tolist(), of_b.tolist())) == overlaps
    common = sorted(set(a.tolist()) & set(b.tolist()))
    assert cuts_a.tolist() == [int((a <= e).sum()) for e in common]
    assert cuts_b.tolist() == [int((b <= e).sum()) for e in common]


def test_pieces_have_equal_work():
    a, b = np.arange(3, 30_000, 3), np.arange(7, 70_000, 7)
    diagonals = np.arange(0, a.size + b.size, 500)
    at = alignment.crossings(a, b, diagonals)
    whole = np.sort(np.concatenate((a, b)), kind="stable")
    for d, i in zip(diagonals.tolist(), at.tolist()):
        taken = np.sort(np.concatenate((a[:i], b[: d - i])))
        assert taken.size == d and (taken == whole[:d]).all()


def _library(texts):
    """Tokens with their bytes, straight from the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(FILES.a)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=FILES.b)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    for b in range(256):
        if b not in printable:
            letters[chr(256 + len(letters) - len(printable))] = b
    result = []
    for text in texts:
        a = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = []
        for i in two.encode(text or ""):
            p = two.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()))
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        result.append((a, b))
    return result


def _spans(tokens):
    at, spans = 0, []
    for i, data in tokens:
        spans.append((i, at, at + len(data)))
        at += len(data)
    return spans


def _aligned(texts):
    rows, held = [], Counter()
    for a, b in map(lambda x: (_spans(x[0]), _spans(x[1])), _library(texts)):
        links = [(i, j) for i, s, e in a for j, t, f in b if max(s, t) < min(e, f)]
        groups, start = [], 0
        for end in sorted({e for _, _, e in a} & {e for _, _, e in b}):
            groups.append("|".join(",".join(str(i) for i, s, e in x if start <= s and e <= end) for x in (a, b)))
            start = end
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
        held.update(set(links))
    best = Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [
        (na, nb, ng, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links),
         hashlib.sha256(g.encode()).hexdigest() if g else "")
        for na, nb, ng, links, g in rows
    ]


def _texts():
    rng = random.Random(3)
    kinds = [(32, 127), (32, 127), (0xA0, 0x250), (0x370, 0x530), (0x4E00, 0x4F00), (0x1F300, 0x1F650), (1, 33)]
    odd = [
        None, "", " ", "  two", "a▁b", "▁", "<|endoftext|> x", "</s> <unk> <s>", "<0x41>", "line\r\n\tend ", "日本語 한국어", "a" * 3000,
        "I don't think it's 1234567 naïve", "é", "\x00", "😀👍🏽" * 40,
    ]
    odd += ["".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    return odd + ["the cat sat on the mat"] * 5


@pytest.mark.parametrize("kept", [alignment.KEPT_PAIRS, 40, 0])
def test_alignment_equals_the_libraries_and_plain_counts(spark, kept):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns(
        {c: F.lit("q") for c in ("row", "pairs", "n_a", "_sum", "rest")}
    )
    found = alignment.alignment(docs, FILES, kept)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = {r.doc_id: tuple(r)[1:] for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == _aligned(texts)


def test_groups_hold_the_same_bytes_on_both_sides(spark):
    texts = [t for t in _texts() if t]
    coder = alignment.encoders(FILES)
    found = alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), FILES).collect()
    assert len(found) == len(texts)
    for row in found:
        a = b = 0
        for i, j in zip(row.a_cuts, row.b_cuts):
            left = b"".join(coder.a_bytes[x] for x in row.a_ids[a:i])
            assert left and left == b"".join(coder.b_bytes[x] for x in row.b_ids[b:j])
            a, b = i, j
        assert (a, b) == (len(row.a_ids), len(row.b_ids))


def test_alignment_of_repeats_nulls_and_nothing(spark):
    schema = "doc_id bigint, text string"
    assert alignment.alignment(spark.createDataFrame([], schema), FILES).count() == 0
    rows = [(1, "some words"), (1, "some words"), (None, "some words"), (2, None)]
    got = alignment.alignment(spark.createDataFrame(rows, schema), FILES).collect()
    assert len(got) == 4
    full = [r for r in got if r.n_a]
    # Three rows hold each pair, the repeat too.
    assert len(full) == 3 and all(r.count_sum == 3 * r.n_links for r in full)
    assert [tuple(r)[1:] for r in got if not r.n_a] == [(0, 0, 0, 0, 0, 0, "")]
