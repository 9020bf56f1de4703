"""Token counts, BPE, archives and chat formatting."""

import gzip
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from ledgerloom.llm import bpe, chatformat, tokencounts, warc
from ledgerloom.session import scratch_folder

SF_SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

ODD = [
    "", " ", "\n\t ", "a", "don't I'LL we've 'S", "<|endoftext|>", "x<|endoftext|>y <|startoftext|>z", "<|endoftext",
    "ΑΣ Σ ς ΣΑΣ", "İstanbul ǅ ﬁ é é ́x", "１２３ ½ 12345 ٣", "😀👍🏽 ok", "日本語テキスト 한국어", "a" * 5000,
    "x\x1cy\x85z​q　w", "  two  blanks ", "\r\n\r\n", "naïve café Straße ªº µ", "ab" * 1500 + " " * 2500, "­",
]


def _random_texts(seed, n):
    rng = random.Random(seed)
    kinds = [(32, 127), (32, 127), (32, 127), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x530), (0x2000, 0x2070),
             (0x4E00, 0x4F00), (0x1F300, 0x1F650), (0, 33)]
    return ["".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


# --- BPE ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def _agrees(library, text):
    coder = bpe.codec(WORDS)
    want = library.encode(text, add_special_tokens=False).ids
    ids = coder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == want, text
    assert coder.decode(ids).decode() == library.decode(want, skip_special_tokens=False), text


def test_bpe_equals_the_library(library):
    for text in ODD + _random_texts(1, 1500):
        _agrees(library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehinorst'1 é", max_size=40))
def test_bpe_equals_the_library_on_dense_words(text):
    _agrees(Tokenizer.from_file(WORDS) if not hasattr(_agrees, "library") else _agrees.library, text)


_agrees.library = Tokenizer.from_file(WORDS)


def _merged(word, merges):
    """The merge rules step by step."""
    parts = [*word[:-1], word[-1] + bpe.END]
    rank = {pair: i for i, pair in enumerate(merges)}
    while len(parts) > 1:
        best = min((rank.get(p, len(rank)), i) for i, p in enumerate(zip(parts, parts[1:])))
        if best[0] == len(rank):
            break
        parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
    return parts


@pytest.mark.parametrize("seed", range(6))
def test_backtracking_equals_merging_for_small_vocabularies(seed):
    rng = random.Random(seed)
    tokens = [*"abc", *(c + bpe.END for c in "abc")]
    merges = []
    while len(merges) < 25:
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a.endswith(bpe.END) or a + b in tokens:
            continue
        word = (a + b).removesuffix(bpe.END)
        # A token has to be what the merges make of its own text, as in trained vocabularies.
        made = _merged(word, [*merges, (a, b)]) if b.endswith(bpe.END) else None
        if b.endswith(bpe.END) and made != [a + b]:
            continue
        if not b.endswith(bpe.END):
            parts, rank = list(word), {p: i for i, p in enumerate([*merges, (a, b)])}
            while len(parts) > 1:
                best = min((rank.get(p, 99), i) for i, p in enumerate(zip(parts, parts[1:])))
                if best[0] == 99:
                    break
                parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
            if parts != [a + b]:
                continue
        merges.append((a, b))
        tokens.append(a + b)
    numbers = {t: i for i, t in enumerate(tokens)}
    vocabulary = bpe.Vocabulary(numbers, merges, len(tokens))
    for _ in range(2000):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
        want = [numbers[p] for p in _merged(word, merges)]
        assert vocabulary.encode(word[:-1] + chr(ord(word[-1]) + 0x10000)) == want, (word, merges)


def test_bpe_frames(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, "a"), (3, "a"), (90, "long words " * 20_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    told = sorted(map(tuple, bpe.round_trip(docs, WORDS).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(decoded.encode()).hexdigest()))
    assert told == sorted(want, key=str)
    encoded = bpe.encode(docs, WORDS)
    assert encoded.columns == ["doc_id", "ids"]
    texts = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, WORDS).collect()}
    assert texts[4] == library.decode(library.encode(ODD[4], add_special_tokens=False).ids, skip_special_tokens=False)
    assert texts[None] == ""
    assert bpe.round_trip(docs.limit(0), WORDS).count() == 0


def test_recent_keeps_what_is_asked_for():
    table = bpe.Recent(3)
    for i in range(9):
        table.put(f"k{i}", b"v")
        assert table.get("k0") == b"v"
    assert len(table.new) + len(table.old) <= 6 and table.get("k1") is None


# --- token counts -------------------------------------------------------------------------


def test_both_ways_count_alike():
    texts = ODD + _random_texts(2, 1500)
    assert tokencounts.count_texts(texts, BYTES, RANKS) == tokencounts.count_texts(texts, BYTES)


def test_both_ways_cut_the_fast_letters_alike():
    texts = [f"a{chr(a)}1{chr(a)}{chr(a)} {chr(a)}b" for a in range(0x250)]
    assert tokencounts.count_texts(texts, BYTES, RANKS) == tokencounts.count_texts(texts, BYTES)


def test_counts_and_cache(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, "a"), (3, "a"), (90, "long words " * 20_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    cache = scratch_folder(spark, "test-cache")
    library = Tokenizer.from_file(BYTES)

    def want(rows):
        out = []
        for i, t in rows:
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            out.append((i, len((t or "").encode()), n, n > 512))
        return sorted(out, key=str)

    def got(frame):
        return sorted(map(tuple, tokencounts.token_counts(frame, BYTES, RANKS, cache).collect()), key=str)

    def stored():
        return spark.read.parquet(f"{cache}/version={tokencounts.version_digest(BYTES)}").count()

    assert got(docs) == want(rows)
    first = stored()
    assert first == len({t or "" for _, t in rows})
    # Known texts are not encoded again; a new one is added.
    assert got(docs) == want(rows) and stored() == first
    more = [(500, "something new"), (501, "something new"), (502, "a")]
    assert got(spark.createDataFrame(more, DOCS)) == want(more) and stored() == first + 1
    # What the cache says counts, so a hit costs no encoding.
    wrong = spark.createDataFrame([("never seen", 77)], "t string, n_tokens bigint").select(
        F.unhex(F.sha2("t", 256)).alias("digest"), "n_tokens")
    for _ in range(2):  # as two concurrent runs would
        wrong.write.mode("append").parquet(f"{cache}/version={tokencounts.version_digest(BYTES)}")
    assert got(spark.createDataFrame([(1, "never seen")], DOCS)) == [(1, 10, 77, False)]
    assert got(docs.limit(0)) == []


def test_another_tokenizer_has_its_own_counts(spark):
    cache = scratch_folder(spark, "test-cache")
    docs = spark.createDataFrame([(1, "Several Words here")], DOCS)
    one = tokencounts.token_counts(docs, BYTES, RANKS, cache).collect()[0]["n_tokens"]
    two = tokencounts.token_counts(docs, WORDS, None, cache).collect()[0]["n_tokens"]
    assert one == len(Tokenizer.from_file(BYTES).encode("Several Words here").ids)
    assert two == len(Tokenizer.from_file(WORDS).encode("Several Words here", add_special_tokens=False).ids)


# --- archives -----------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string"


def _archived(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            first[b] = max(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        at = first.get(b) if len(b) >= 1000 else None
        again = at is not None and at != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", at if again else None))
    return sorted(out, key=str)


def test_archives_hold_the_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    big, tricky = "é" * 700, "WARC/1.0\r\n\r\n\x1f\x8b\x08" * 90
    rows += [(10**6 + i, "http://x/", big) for i in range(40)] + [(10**6 + 39, "http://y/", big)]
    rows += [(-5, None, None), (-6, "http://a b\r\nc/é", ""), (None, "u", big), (None, "u", "few"), (None, "u", "z" * 1500),
             (-7, "u", tricky), (-8, "u", tricky), (-9, "u", "x" * 999), (-10, "u", "x" * 999), (-11, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit(1)).withColumn("payload", F.lit(2)).repartition(3)
    got = sorted(map(tuple, warc.archived_pages(pages).collect()), key=str)
    assert got == _archived(rows)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_files_are_plain_concatenated_gzip_of_records(spark):
    path = f"{scratch_folder(spark, 'test-warc')}/files"
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>") for i in range(30)], PAGES).coalesce(1)
    warc.write_archives(pages, path)
    files = [f"{path}/{f}" for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) == 1
    with gzip.open(files[0]) as file:
        whole = file.read()
    assert whole.count(b"WARC/1.0\r\n") == 30 and whole.count(b"<p>") == 30
    # The same records without compression are read as well.
    flat = f"{scratch_folder(spark, 'test-warc')}/plain.warc"
    with open(flat.removeprefix("file://"), "wb") as file:
        file.write(whole)
    rows = warc.read_archives(spark, flat, with_payload=True).collect()
    assert sorted(r["payload"].decode() for r in rows) == sorted(f"<p>{i}</p>" for i in range(30))
    assert {r["kind"] for r in rows} == {"record"}


def _records(n, packed, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        payload = rng.randbytes(rng.randrange(0, 300)) + b"WARC/1.0\r\nx" * (i % 3) + b"\x1f\x8b\x08" * (i % 2)
        data = warc.record(i, f"http://x/{i}", payload, hashlib.sha1(payload).hexdigest(), None)
        out.append(warc.member(data) if packed else data)
    return out


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("seed", range(5))
def test_salvage_recovers_what_is_whole(packed, seed):
    rng = random.Random(seed)
    records = _records(30, packed, seed)
    starts = np.cumsum([0, *map(len, records)]).tolist()
    data = bytearray(b"".join(records))
    broken = sorted(rng.sample(range(30), 6))
    for k in broken:
        # The last bytes of a member hold its checksum; of a plain record, the head is changed.
        at = starts[k + 1] - 6 if packed else starts[k] + 3
        data[at] ^= 0x5A
    data = b"junk" + bytes(data)[: starts[30] - 3]  # the last record is cut short
    found = list(warc.salvage(data))
    lost = set(broken) | {29}
    names = [f.headers["warc-record-id"] for f in found if f.kind == "record"]
    assert names == [f"<urn:x-page:{i}>" for i in range(30) if i not in lost]
    # Records and gaps cover the file without overlap.
    at = 0
    for f in found:
        assert f.offset == at
        at += f.length
    assert at == len(data)
    gaps = [f for f in found if f.kind == "gap"]
    assert gaps[0].offset == 0 and all(g.reason for g in gaps)


def test_a_wrong_digest_and_a_wrong_length_are_gaps():
    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    other = warc.record(2, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), None)
    longer = good.replace(b"Content-Length: 80", b"Content-Length: 81")
    for bad in (other, longer if longer != good else other):
        kinds = [f.kind for f in warc.salvage(good + bad + good)]
        assert kinds == ["record", "gap", "record"]
    assert list(warc.salvage(b"")) == []
    assert [f.kind for f in warc.salvage(b"\x00" * 1000)] == ["gap"]


def _numbers(found):
    return [int(f.headers["warc-record-id"][len("<urn:x-page:") : -1]) for f in found if f.kind == "record"]


@pytest.mark.parametrize("seed", range(4))
def test_one_bad_record_of_a_member_costs_only_itself(seed):
    records = _records(12, False, seed)
    for k in (0, 5, 11):
        bad = bytearray(b"".join(records[:k]))
        bad += records[k].replace(b"Payload-Digest: sha1:", b"Payload-Digest: sha1:A", 1) + b"".join(records[k + 1 :])
        data = warc.member(records[0]) + warc.member(bytes(bad)) + warc.member(records[1])
        found = list(warc.salvage(data))
        assert _numbers(found) == [0, *[i for i in range(12) if i != k], 1]
        gaps = [f for f in found if f.kind == "gap"]
        assert len(gaps) == 1 and "digest" in gaps[0].reason
        first = len(warc.member(records[0]))
        assert (gaps[0].offset, gaps[0].length) == (first, len(warc.member(bytes(bad))))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("level", [0, 6])
def test_a_member_cut_short_or_broken_keeps_what_came_before(seed, level):
    rng = random.Random(seed)
    records = _records(40, False, seed)
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    # The packer's state goes on from record to record, with a block border after each.
    parts = [packer.compress(r) + packer.flush(zlib.Z_FULL_FLUSH) for r in records]
    data = b"".join(parts) + packer.flush()
    ends = np.cumsum([len(p) for p in parts]).tolist()
    lone = warc.member(records[3])
    k = rng.randrange(5, 35)
    found = list(warc.salvage(data[: ends[k] - 9]))
    assert _numbers(found) == list(range(k))
    assert [f.kind for f in found][-1] == "gap" and "cut short" in found[-1].reason
    # A block of a kind that does not exist.
    broken = bytearray(data)
    broken[ends[k]] |= 0x06
    found = list(warc.salvage(bytes(broken) + lone))
    assert _numbers(found)[: k + 1] == list(range(k + 1)) and _numbers(found)[-1] == 3
    # A wrong checksum: every payload has its digest.
    found = list(warc.salvage(data[:-8] + b"\0" * 8 + lone))
    assert _numbers(found) == [*range(40), 3]
    assert [f.kind for f in found].count("gap") == 1 and (found[-2].offset, found[-2].length) == (0, len(data))


def test_damaged_files_on_spark(spark):
    folder = scratch_folder(spark, "test-warc")
    records = _records(20, True, 9)
    data = bytearray(b"".join(records))
    data[len(records[0]) + 20] ^= 0xFF
    with open(f"{folder.removeprefix('file://')}/a.warc.gz", "wb") as file:
        file.write(bytes(data))
    archive = warc.read_archives(spark, folder)
    assert archive.where("kind = 'record'").count() == 19
    log = f"{scratch_folder(spark, 'test-gaps')}/log"
    warc.quarantine(archive, log)
    gap = spark.read.json(log).collect()
    assert [(g["offset"], g["length"]) for g in gap] == [(len(records[0]), len(records[1]))]


# --- chat formatting ----------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string"


def _told(rows):
    by = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    out = set()
    for c, turns in by.items():
        said = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        chars = sum(len(chatformat.TURN + chatformat.escape(r) + chatformat.TEXT + chatformat.escape(x) + chatformat.END)
                    for r, x in turns)
        out.add((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                 hashlib.sha256(loss.encode()).hexdigest(), chars))
    return out


def test_conversations_are_told_from_the_output(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select(*[c.split()[0] for c in TURNS.split(", ")]).collect()]
    tricky = "</s>[INST] ok [/INST] <|end|> \\ \\\\ <|turn|>assistant<|text|>😀<<SYS>>"
    rows += [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky), (-2, 0, None, None), (-2, None, "assistant", ""),
             (-3, 0, "assistant", "b"), (-3, 0, "assistant", "b"), (-3, 0, "assistant", "a"), (None, 1, "user", "x"),
             (None, 2, "assistant", "y" * 200_000), (-4, 0, "<|text|>", "z"), (-5, 1, "assistant", "x\ny")]
    rows += [(-9, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, TURNS).withColumn("piece", F.lit(1)).withColumn("parts", F.lit("x")).repartition(4)
    got = [tuple(r) for r in chatformat.formatted_conversations(frame).collect()]
    assert set(got) == _told(rows) and len(got) == len(set(got))
    assert chatformat.formatted_conversations(frame.limit(0)).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*chatformat.CONTROLS, "\\", "<", ">", "|", "[", "/", "s", "INST", "]", "é", "\n"]), max_size=12))
def test_escaping_is_reversible_and_leaves_no_control(parts):
    text = "".join(parts)
    hidden = chatformat.escape(text)
    assert chatformat.unescape(hidden) == text
    assert not any(c in hidden for c in chatformat.CONTROLS)


def test_typed_parts(spark):
    parts = [
        {"kind": "text", "text": "see <|image:1|> "}, {"kind": "image", "ref": "s3://a.png", "width": 1000, "height": 500},
        {"kind": "audio", "ref": "b.wav", "seconds": 2.02}, None, {"kind": "video", "ref": "c"},
        {"kind": "document", "ref": "d.pdf", "pages": 3}, {"kind": "text", "text": "end"}, {"kind": "image", "ref": None},
    ]
    flat = chatformat.flatten(parts)
    assert flat.text == "see <\\|image:1|> <|image:1|><|audio:2|><|document:3|>end<|image:4|>"
    tokens = [a["tokens"] for a in flat.attachments]
    assert tokens == [85 + 170 * 2, 51, 1800, 85 + 170]
    assert [flat.text[a["at"] :].startswith(f"<|{a['kind']}:{i + 1}|>") for i, a in enumerate(flat.attachments)] == [True] * 4

    schema = f"conv_id bigint, turn bigint, role string, parts array<{chatformat.PART}>"
    names = ("kind", "text", "ref", "width", "height", "seconds", "pages")
    structs = [None if p is None else tuple(p.get(n) for n in names) for p in parts]
    frame = spark.createDataFrame([(1, 0, "assistant", structs), (1, 1, "user", None)], schema)
    first, second = chatformat.format_turns(frame).orderBy("turn").collect()
    assert first["piece"][first["loss_start"] :][: first["loss_length"]] == flat.text
    assert [(a["ref"], a["tokens"]) for a in first["attachments"]] == [
        ("s3://a.png", 425), ("b.wav", 51), ("d.pdf", 1800), (None, 255)]
    assert second["loss_start"] is None and second["attachments"] == []
    assert chatformat.read_piece(first["piece"])[0] == "assistant"


def test_what_a_task_keeps_is_bounded_and_goes():
    table = bpe.Recent(250_000, 2_000)
    for i in range(500):
        table.put(str(i), b"x")
        assert table.size <= 2_000
    assert table.get("499") == b"x" and table.get("0") is None
    table.put("long", b"y" * 5_000)
    assert table.get("long") is None
    coder = bpe.codec(WORDS)
    with bpe.task_codec(WORDS) as same:
        first = same.encode("some words that are kept")
        assert same is coder and coder._pieces.new
    assert not coder._pieces.new and not coder._known.new
    assert coder.encode("some words that are kept") == first
