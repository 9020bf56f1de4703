"""Toxicity, language identification and URL verdicts."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import langid, toxicity, urlfilter

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SF_MIDDLE = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string"
LABELS = "doc_id bigint, quality int, toxic int"


# --- toxicity -----------------------------------------------------------------------------


def _labelled(spark, n=400, seed=3):
    rng = random.Random(seed)
    calm = "river stone bread window garden letter music winter market bridge".split()
    rude = "vileword nastyterm foulphrase".split()
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(12)]
        toxic = i % 2
        if toxic:
            words[rng.randrange(12)] = rng.choice(rude)
        # A biased sample: a group is named far more often in the toxic texts.
        if rng.random() < (0.8 if toxic else 0.05):
            words[rng.randrange(12)] = "muslim"
        docs.append((i, " ".join(words), "en"))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def test_rude_words_tell_the_classes_apart(spark):
    docs, labels = _labelled(spark)
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right / len(rows) > 0.9


def test_the_penalty_takes_weight_off_identity_terms(spark):
    docs, labels = _labelled(spark)
    plain = toxicity.train(docs, labels, counterfactual=0.0)
    fair = toxicity.train(docs, labels)
    mention, other = "the muslim garden", "the christian garden"

    def gap(model):
        a, b = (math.log(s / (1 - s)) for s in model.scores([mention, other]))
        return abs(a - b)

    assert gap(plain) > 1.0
    assert gap(fair) < 0.3 * gap(plain)


def test_swapping_exchanges_every_term_of_its_kind():
    assert toxicity.swapped("A Muslim man") == "a christian women"
    assert toxicity.swapped("nothing here") is None


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, None, "en"), (1, None, "en"), (None, "", "en"), (2, "word " * 50_000, "en")], DOCS)
    none = spark.createDataFrame([], LABELS)
    rows = toxicity.toxicity(docs, none).collect()
    assert len(rows) == 4 and len({r["score"] for r in rows}) == 1
    assert all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in rows)
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_toxicity_ignores_odd_labels_and_extra_columns(spark):
    docs, labels = _labelled(spark, 200)
    odd = spark.createDataFrame([(1, 1, 7), (3, 1, None), (None, 1, 1)], LABELS)
    more = docs.withColumn("toxic", F.lit(5)).withColumn("score", F.lit("x")).withColumn("key", F.lit(1))
    want = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(more, labels.union(odd)).collect()}
    assert got == pytest.approx(want)
    kept = toxicity.without_toxic(more, labels)
    assert kept.columns == more.columns and 0 < kept.count() < 200


def test_held_out_accuracy_on_the_table(spark):
    docs = spark.read.parquet(f"{SF_MIDDLE}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MIDDLE}/labels.parquet")
    scored = toxicity.toxicity(docs, labels)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    clean = [r for r in rows if r["toxic"] == 0]
    assert right > 0.9
    assert sum(r["predicted"] for r in clean) <= 0.03 * len(clean)


# --- language -----------------------------------------------------------------------------


def test_grams_are_the_distinct_pieces_of_every_length():
    text = "Ab1 ab!Ç"
    spaced = re.sub(r"[^a-zç]+", "\0", "\0" + text.lower() + "\0")
    want = {spaced[i : i + n] for n in (1, 2, 3) for i in range(len(spaced) - n + 1)} - {"\0"}
    assert langid.gram_ids(text).size == len(want)
    assert np.array_equal(langid.gram_ids(text), np.unique(langid.gram_ids(text)))


def test_kernel_is_the_shared_share():
    a, b = langid.gram_ids("haus garten"), langid.gram_ids("garten tor")
    grams = np.unique(b)
    model = langid.Model(["x"], 0, grams, np.ones((grams.size, 1), np.float32), np.array([b.size]), np.ones((1, 1)))
    shared = len(set(a.tolist()) & set(b.tolist()))
    assert model.kernel([a])[0, 0] == pytest.approx(shared / math.sqrt(a.size * b.size))


def test_language_accuracy_held_out(spark):
    docs = spark.read.parquet(f"{SF_MIDDLE}/documents.parquet")
    rows = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows)
    assert right > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame(
        [(-1, None, "en"), (-2, "", None), (-3, "12 34 !!", "de"), (-4, "日本語", None), (None, "the end", "en"),
         (-5, "and the " * 20_000, "en"), (-6, "x", "en"), (-6, "x", "en")], DOCS)
    both = docs.union(odd).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit(2))
    rows = defaultdict(list)
    for r in langid.language_id(both).collect():
        rows[r["doc_id"]].append(r)
    for i in (-1, -2, -3):
        assert (rows[i][0]["lang_pred"], rows[i][0]["score"]) == ("und", 0.0)
    assert rows[-4][0]["lang_pred"] != "und" and rows[-4][0]["score"] == 0.0
    assert rows[None][0]["held_out"] and len(rows[-6]) == 2
    assert rows[-5][0]["lang_pred"] == "en"
    kept = langid.known_language(both)
    assert kept.columns == both.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not ids & {-1, -2, -3, -4} and -5 in ids


def test_language_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "words here", None)], DOCS)
    assert langid.language_id(docs).collect()[0]["lang_pred"] == "und"
    assert langid.language_id(docs.limit(0)).count() == 0


# --- URLs ---------------------------------------------------------------------------------


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def _rule(host, path):
    for verdict, rule in sorted(urlfilter.RULES, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            return verdict, rule
    return None, None


def _brute(urls, aside):
    """Verdicts and scores counted with dictionaries."""
    order, end = urlfilter.ORDER, urlfilter.END
    parts = [_parts(u) for u in urls]
    counts = {"allow": Counter(), "block": Counter()}
    around = {"allow": Counter(), "block": Counter()}
    for host, path in set(parts):
        verdict, _ = _rule(host, path)
        if verdict and not aside(host, path):
            text = urlfilter.START * order + host + path + end
            # The end of the host and the beginning of the path share a context.
            for i in range(order, len(text)):
                for n in range(order + 1):
                    counts[verdict][text[i - n : i + 1]] += 1
                    around[verdict][n, text[i - n : i]] += 1

    def chance(kind, text, i):
        p = 1 / urlfilter.SIGNS
        for n in range(order + 1):
            all_ = around[kind][n, text[i - n : i]]
            if n == 0 or all_:
                p = (counts[kind][text[i - n : i + 1]] + urlfilter.SMOOTHING * p) / (all_ + urlfilter.SMOOTHING)
        return p

    def score(host, path):
        text = urlfilter.START * order + host + path + end
        total = sum(
            math.log(chance("allow", text, i)) - math.log(chance("block", text, i)) for i in range(order, len(text))
        )
        return total / (len(text) - order)

    return {(h, p): (_rule(h, p), score(h, p)) for h, p in set(parts)}


def test_url_scores_equal_brute_force(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame(
        [(-1, None), (-2, "nothing"), (-3, "HTTP://WWW.Example.COM"), (-4, "a://x.NET/es/?q#r"), (-5, "a://com/"),
         (-6, "a://a.com?x/"), (-7, "a://é.org/" + "z" * 3000), (-8, "://"), (None, "a://b.com/"), (-5, "a://com/")],
        "page_id bigint, url string")
    both = pages.union(odd).withColumn("verdict", F.lit(1)).withColumn("host", F.lit(1))
    rows = urlfilter.url_verdicts(both).collect()
    assert len(rows) == both.count()
    aside = {
        (r["h"], r["p"])
        for r in both.select(*[c.alias(n) for c, n in zip(urlfilter.host_and_path(F.col("url")), "hp")])
        .where(F.crc32(F.concat("h", "p").cast("binary")) % urlfilter.CALIBRATION == 0).collect()
    }
    want = _brute([r["url"] for r in both.collect()], lambda h, p: (h, p) in aside)
    urls = {}
    for r in rows:
        (verdict, rule), score = want[r["host"], r["path"]]
        assert r["rule"] == rule
        assert r["score"] == pytest.approx(score, abs=1e-9)
        if verdict:
            assert r["verdict"] == verdict
        urls[r["page_id"]] = r
    assert (urls[-1]["host"], urls[-1]["path"]) == ("", "") == (urls[-2]["host"], urls[-2]["path"])
    assert (urls[-3]["host"], urls[-3]["rule"]) == ("www.example.com", None)
    assert urls[-4]["rule"] == "net/es/" and urls[-5]["rule"] == "com/" and urls[-6]["rule"] is None
    # One cut separates the verdicts of the model.
    free = [r for r in rows if r["rule"] is None]
    allowed = [r["score"] for r in free if r["verdict"] == "allow"]
    blocked = [r["score"] for r in free if r["verdict"] == "block"]
    assert allowed and blocked and min(allowed) > max(blocked)


def test_the_model_agrees_with_the_rules_it_has_not_seen(spark):
    pages = spark.read.parquet(f"{SF_MIDDLE}/pages.parquet")
    rows = urlfilter.url_verdicts(pages).where("rule is not null").collect()
    cut = 0.0
    right = sum((r["score"] >= cut) == (r["verdict"] == "allow") for r in rows) / len(rows)
    assert right > 0.9


def test_urls_without_labels(spark):
    pages = spark.createDataFrame([(1, "a://b.org/x"), (2, None)], "page_id bigint, url string")
    rows = urlfilter.url_verdicts(pages).collect()
    assert {(r["verdict"], r["score"], r["rule"]) for r in rows} == {("allow", 0.0, None)}
    assert urlfilter.url_verdicts(pages.limit(0)).count() == 0
