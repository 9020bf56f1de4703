"""N-gram join, decontamination, top-k search and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import bpe, components, decontaminate, langid, ngramjoin, topk, toxicity

SF_SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"


# --- components ---------------------------------------------------------------------------


def _least(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_paths_stars_and_noise(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(1, 50)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    links += links[:5] + [(7, 7)]
    rng.shuffle(links)
    rows = components.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
    want = {n: c for n, c in _least(links).items() if n != c}
    assert {r["node"]: r["component"] for r in rows} == want and len(rows) == len(want)


def test_no_links(spark):
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# --- n-gram join --------------------------------------------------------------------------


def _set(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0D]+", lower)
    if not w:
        return set()
    return {tuple(w)} if len(w) < 4 else {tuple(w[i : i + 4]) for i in range(len(w) - 3)}


def _joined(rows):
    held, links = defaultdict(list), []
    sets = [(i, _set(t)) for i, t in rows]
    for k, (i, s) in enumerate(sets):
        shared = Counter(j for g in s for j in held[g])
        for g in s:
            held[g].append(k)
        links += [
            (i, sets[j][0]) for j, n in shared.items() if 100 * n >= 85 * (len(s) + len(sets[j][1]) - n)
        ]
    least = _least(links)
    return Counter((i, len(s), least.get(i, i)) for i, s in sets)


def _mixed_rows(seed, copies=220):
    """Near copies of one text at lengths on both sides of the index's limits, and odd texts."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(1900)]
    rows = []
    for k in range(copies):
        w = base[: rng.choice([8, 12, 50, 58, 64, 70, 120, 300])]
        for _ in range(rng.randrange(0, max(2, len(w) // 30))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    for k in range(12):
        w = base[: rng.choice([1480, 1510, 1700, 1800, 1900])]
        for _ in range(rng.randrange(0, 50)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
        rows.append((10_000 + k, " ".join(w)))
    odd = ["", None, " \t", "a", "a b", "A  b", "a b c", "a b c d", "A\x0bb c d e f g h", "a b c d e f g h", "a\x1cb c d"]
    rows += [(20_000 + k, t) for k, t in enumerate(odd)]
    rows += [rows[3], rows[3], (3, "another text under a number that is taken already"), (20_050, rows[5][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "frequent"), [(1, 5), (2, 40), (3, 1000)])
def test_join_equals_brute_force(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(ngramjoin, "FREQUENT", frequent)
    rows = _mixed_rows(seed)
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("n", F.lit(1)).withColumn("node", F.lit("x"))
    got = Counter(tuple(r) for r in ngramjoin.ngram_components(docs).collect())
    assert got == _joined(rows)


def test_join_by_shuffle_where_candidates_are_many(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "KNOWN_IDS", 10)
    monkeypatch.setattr(ngramjoin, "MOST_FREQUENT", 50)
    rows = _mixed_rows(4, 120)
    docs = spark.createDataFrame(rows, DOCS)
    assert Counter(tuple(r) for r in ngramjoin.ngram_components(docs).collect()) == _joined(rows)


def test_ranges_of_counts_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "RANGE_BYTES", 100, raising=False)
    monkeypatch.setattr(ngramjoin, "FREQUENT", 20)
    asked, count = [], ngramjoin.frequent_shingles

    def counting(docs, words, least, ranges):
        asked.append(ranges)
        return count(docs, words, least, ranges)

    monkeypatch.setattr(ngramjoin, "frequent_shingles", counting)
    rows = _mixed_rows(12, 100)
    got = Counter(tuple(r) for r in ngramjoin.ngram_components(spark.createDataFrame(rows, DOCS)).collect())
    assert got == _joined(rows)
    assert asked == [-(-sum(len(t or "") for _, t in rows) // 100)] and asked[0] > ngramjoin.RANGES


def test_join_of_nothing_and_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h"), (4, "a b c d e f g h"), (None, None)], DOCS)
    rows = {tuple(r) for r in ngramjoin.ngram_components(docs).collect()}
    assert rows == {(None, 5, None), (4, 5, 4), (None, 0, None)}
    assert ngramjoin.ngram_components(docs.limit(0)).count() == 0


def test_one_of_each_keeps_the_smallest(spark):
    rows = _mixed_rows(6, 80)
    docs = spark.createDataFrame(rows, DOCS).withColumn("__x", F.lit(1))
    kept = ngramjoin.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, c in _joined(rows) if i == c}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == want


def test_linked_prefixes_share_a_key():
    rng = np.random.default_rng(5)
    for n in (6, 20, 51, 60, 61, 200, 1499, 1500, 1764, 1766, 2500):
        for _ in range(12):
            common = rng.choice(10**9, n, replace=False).astype(np.uint64)
            cut = int(n * 0.075)
            one = np.sort(np.concatenate((common[cut:], rng.choice(10**9, cut).astype(np.uint64))))
            two = np.sort(np.concatenate((common[: n - rng.integers(0, cut + 1)],)))
            both = np.intersect1d(one, two).size
            if 100 * both < 85 * (one.size + two.size - both):
                continue
            often = np.sort(rng.choice(common, n // 2, replace=False))
            for known in (often, np.sort(common), common[:0]):
                first, second = (
                    dict(zip(*(x.tolist() for x in ngramjoin.keys_of(h, np.isin(h, known))))) for h in (one, two)
                )
                least = 85 * (one.size + two.size) / 185
                assert any(min(first[k], second[k]) >= least for k in first.keys() & second.keys())


def _near(rows, words, least):
    """The smallest doc_id of every component, by sets of ``words``-word shingles and ``least`` percent."""
    held, links, sets = defaultdict(list), [], []
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(words, len(w))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()))
    for k, (i, s) in enumerate(sets):
        shared = Counter(j for g in s for j in held[g])
        for g in s:
            held[g].append(k)
        links += [
            (i, sets[j][0]) for j, n in shared.items() if 100 * n >= least * (len(s) + len(sets[j][1]) - n)
        ]
    least_of = _least(links)
    return {i for i, _ in sets if least_of.get(i, i) == i}


@pytest.mark.parametrize("frequent", [5, 40, 1000])
def test_stage_drops_near_copies_of_five_words_and_80_percent(spark, monkeypatch, frequent):
    monkeypatch.setattr(ngramjoin, "FREQUENT", frequent)
    rng = random.Random(9)
    rows = [r for r in _mixed_rows(7, 160) if r[0] != 3]
    for k in range(40):
        # Some of a run of words replaced: near 80 percent, on either side of it.
        w = [f"z{k}_{i}" for i in range(rng.choice([8, 9, 20, 47, 48, 60, 75, 100, 400, 1700]))]
        rows.append((30_000 + 2 * k, " ".join(w)))
        cut = max(1, len(w) * rng.randrange(2, 12) // 100)
        at = rng.randrange(len(w) - cut + 1)
        w[at : at + cut] = [f"q{k}_{i}" for i in range(cut)]
        rows.append((30_001 + 2 * k, " ".join(w)))
    rows += [(40_000, "c1 c2 c3 c4 c5 c6 c7 c8"), (40_001, "c1 c2 c3 c4 c5 c6 c7 c8 c9")]  # 4 of 5 shingles
    words = [f"d{i}" for i in range(100)]
    rows += [(40_002, " ".join(words)), (40_003, " ".join(words[:40] + ["e"] * 5 + words[45:]))]
    want = _near(rows, 5, 80)
    assert want != _near(rows, 4, 85) and not {40_001, 40_003} & want
    docs = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()} == want


@pytest.mark.parametrize(("words", "least"), [(5, 80), (3, 50), (4, 85), (2, 100)])
def test_join_equals_brute_force_at_other_thresholds(spark, monkeypatch, words, least):
    monkeypatch.setattr(ngramjoin, "FREQUENT", 20)
    rows = _mixed_rows(11, 120)
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"] for r in ngramjoin.one_of_each(docs, words, least).collect()}
    assert got == _near(rows, words, least)


# --- decontamination ----------------------------------------------------------------------


def _tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def _overlaps(docs, items):
    span, slack = decontaminate.SPAN, decontaminate.SUBSTITUTED

    def windows(text):
        t = _tokens(text)
        return [t[i : i + span] for i in range(len(t) - span + 1)]

    known = defaultdict(set)
    for item, text in items:
        for w in windows(text):
            known[item].add(tuple(w))
    out = {}
    for doc, text in docs:
        n = Counter()
        for w in windows(text):
            for item, held in known.items():
                n[item] += sum(sum(a == b for a, b in zip(w, v)) >= span - slack for v in held)
        hit = sorted(i for i, k in n.items() if k)
        before = out.get(doc, (set(), 0))
        out[doc] = (before[0] | set(hit), before[1] + sum(n.values()))
    return {d: (bool(i), len(i), n, ",".join(map(str, sorted(i)))) for d, (i, n) in out.items()}


@pytest.mark.parametrize("limit", [100_000, 3])
def test_overlaps_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 20, 30])))) for i in range(12)]
    items += [(50, items[3][1]), (51, None), (52, "")]
    docs = []
    for d in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 40, 90]))]
        if d % 3 == 0:
            taken = _tokens(items[rng.randrange(12)][1])
            for _ in range(rng.randrange(0, 4)):
                taken[rng.randrange(len(taken))] = "other"
            words[len(words) // 2 : len(words) // 2] = taken
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(words).title()))
    docs += [(100, None), (101, ""), (5, "one more text"), (None, items[3][1]), (103, items[3][1] + " x " * 20_000)]
    frame = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("x")).withColumn("h", F.lit(1))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    rows = decontaminate.contamination(frame, bench).collect()
    want = _overlaps(docs, items)
    assert len(rows) == len(docs)
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want
    kept = decontaminate.decontaminated(frame, bench)
    assert kept.columns == frame.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in docs if not want[d][0])


@pytest.mark.parametrize("limit", [100_000, 1])
def test_short_items_are_found_word_for_word(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    script = "\u8fd9\u662f\u4e00\u4e2a" * 7  # 28 letters without a blank: one token
    bench = spark.createDataFrame(
        [(1, "a1 a2 a3 a4 a5 a6"), (2, "A1, a2; a3 a4 a5 a6!"), (3, "of the in a b"), (4, script), (5, None),
         (6, " ".join(f"b{i}" for i in range(11))), (7, " ".join(f"c{i}" for i in range(20)))],
        "item_id bigint, text string",
    )
    texts = {
        10: ("x a1 a2 a3 a4 a5 a6 y A1 A2 A3 A4 A5 A6", 2, 4, "1,2"), 11: ("a1 a2 a3 a4 a5 x", 0, 0, ""),
        12: ("of the in a b", 0, 0, ""), 13: (f"{script}. x", 1, 1, "4"), 14: (script[:-1], 0, 0, ""),
        15: (" ".join(f"b{i}" for i in range(11)), 1, 1, "6"), 16: (" ".join(f"b{i}" for i in range(10)) + " x", 0, 0, ""),
        17: (" ".join(f"c{i}" for i in range(12)) + " a1 a2 a3 a4 a5 a6", 3, 5, "1,2,7"), 18: (None, 0, 0, ""),
    }
    docs = spark.createDataFrame([(d, t[0]) for d, t in texts.items()], DOCS)
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {d: (n > 0, n, w, i) for d, (_, n, w, i) in texts.items()}
    assert {r["doc_id"] for r in decontaminate.decontaminated(docs, bench).collect()} == {11, 12, 14, 16, 18}


def test_clean_without_benchmark_or_documents(spark):
    docs = spark.createDataFrame([(1, "a " * 40)], DOCS)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r) for r in decontaminate.contamination(docs, none).collect()] == [(1, False, 0, 0, "")]
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


def test_every_two_substitutions_leave_a_mask():
    for a in range(decontaminate.SPAN):
        for b in range(decontaminate.SPAN):
            broken = {a % decontaminate.GROUPS, b % decontaminate.GROUPS}
            assert any(not broken & set(mask) for mask in decontaminate.MASKS)


# --- top-k --------------------------------------------------------------------------------


def _ranked(rows, k, every):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable.setdefault((i, tuple(v)), [int(np.floor(1024 * float(x))) for x in v])
    best = defaultdict(dict)
    for (q, _), a in usable.items():
        if q % every == 0:
            for (c, _), b in usable.items():
                if c != q:
                    s = sum(x * y for x, y in zip(a, b))
                    s = max(-(2**63), min(2**63 - 1, s))
                    best[q][c] = max(s, best[q].get(c, s))
    return {
        (q, n + 1, c, s)
        for q, found in best.items()
        for n, (c, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k])
    }


VECTORS = "vec_id bigint, embedding array<float>"


@pytest.mark.parametrize(("seed", "blocks", "cell"), [(1, 2, 8192), (2, 3, 40), (3, 1, 16)])
def test_top_products_equal_brute_force(spark, monkeypatch, seed, blocks, cell):
    monkeypatch.setattr(topk, "CELL_CANDIDATES", cell)
    monkeypatch.setattr(topk, "CELL_QUERIES", max(2, cell // 8))
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=7) / 3)]) for i in range(150)]
    rows += [(200 + i, rows[10][1]) for i in range(40)] + [rows[10], rows[10]]
    rows += [(300, None), (301, [None] * 7), (302, [float("nan")] * 7), (303, [float("inf")] * 7),
             (None, rows[1][1]), (304, []), (305, rows[4][1][:3]), (310, [0.0] * 7)]
    frame = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit(1)).repartition(3)
    # Without this, small shuffles end in one partition, and cells meet however they are dealt.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = [tuple(r) for r in topk.top_products(frame, k=10, every=10, blocks=blocks).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == _ranked(rows, 10, 10) and len(got) == len(set(got))


def test_top_products_of_large_and_few_vectors(spark):
    rows = [(0, [3e30, 1.0]), (1, [3e30, 2.0]), (2, [-3e30, 0.5]), (3, [5.0, 5.0])]
    frame = spark.createDataFrame(rows, VECTORS)
    got = {tuple(r) for r in topk.top_products(frame).collect()}
    floats = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == _ranked(floats, 10, 100)
    assert topk.top_products(frame.limit(0)).count() == 0
    assert topk.top_products(frame.where("vec_id = 0")).count() == 0


# --- pipeline -----------------------------------------------------------------------------


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "...", "en", "s", 3)], docs.schema)
    now = docs.union(odd)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF_SMALL)
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        after = out.collect()
        ids = {r["doc_id"] for r in after}
        assert ids <= set(before) and len(after) == len(ids)
        if name == "toxicity":
            model = toxicity.train(now, labels)
            want = {i for i, t in before.items() if model.scores([t or ""])[0] < 0.5}
        elif name == "language_id":
            model = langid.train(now)
            told = {i: model.predict([t or ""]) for i, t in before.items()}
            want = {i for i, (lang, s) in told.items() if lang[0] != "und" and s[0] >= 0.3}
        elif name == "ngram_join":
            want = {i for i, _, c in _joined(list(before.items())) if i == c}
        elif name == "decontamination":
            found = _overlaps(list(before.items()), bench)
            want = {i for i in before if not found[i][0]}
        else:
            want = set(before)
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert ids == want
        if name != "bpe":
            assert out.columns == now.columns
            assert {r["doc_id"]: r["text"] for r in after} == {i: before[i] for i in ids}
            now = spark.createDataFrame(after, docs.schema)
    assert 0 < len(after) < docs.count()


def test_pipeline_runs_and_takes_an_empty_table(spark):
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert rows and {r["doc_id"] for r in rows}
    now = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF_SMALL)
        assert now.count() == 0


def test_ids_of_the_last_stage_are_the_codecs(spark):
    import hashlib

    import public_tokenizers

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(20)
    coder = bpe.codec(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in corpus_pipeline.encode(spark, docs, SF_SMALL).collect():
        assert r["ids_sha256"] == hashlib.sha256(coder.encode(texts[r["doc_id"]])).hexdigest()
