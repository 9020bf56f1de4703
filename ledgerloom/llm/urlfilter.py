"""URL verdicts from rules and, where no rule fits, from two character language models.

The rules label URLs. From the distinct labelled URLs one variable-order Markov model is counted for
those accepted and one for those rejected: the probability of a character after its last ``ORDER``
characters, smoothed with that after one character less, down to the uniform one. The score of a URL
is the difference of its two log-likelihoods divided by its length. The cut between both verdicts is
the one with the smallest sum of both error rates on a fifth of the labelled URLs that is not counted.

A URL is cut at the border of host and path into two strings; a string that many URLs share, such as a
common host, is counted and scored once, with its number of URLs as weight.

Defined results: a null URL, or one without ``://``, has an empty host and path; no rule fits it, and
its score comes from the end sign alone. Without labelled URLs of both kinds scores are 0 and the
verdict is allow. A score equal to the cut is allow. Of two rules of the same length that fit, the one
first in text order wins. Repeated rows get one result each; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import stored

ORDER = 4  # characters of context
SMOOTHING = 2.0  # weight of the shorter context
SIGNS = 256  # the uniform distribution's size
CALIBRATION = 5  # one of so many labelled URLs sets the cut
BIN = 0.01  # resolution of the cut
BINS = 1000  # on either side of 0
START, END = "\x02", "\x03"
ALLOW, BLOCK = "allow", "block"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

RULES = [
    (ALLOW, "com/"),
    (BLOCK, "example.com/en/"),
    (ALLOW, "www.example.com/en/"),
    (BLOCK, "net/es/"),
    (BLOCK, "net/fr/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits as a struct of ``verdict`` and ``rule``, or null. Rules are few."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    cases = []
    for verdict, rule in ordered:
        name, slash, rest = rule.partition("/")
        fits = (host == name) | host.endswith("." + name)
        cases.append(
            F.when(
                fits & path.startswith(slash + rest),
                F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule")),
            )
        )
    empty = F.lit(None).cast("struct<verdict:string,rule:string>")
    return F.coalesce(*cases, empty)


def _strings(host: Column, path: Column) -> tuple[Column, Column]:
    """The two strings of a URL: the host after start signs, the path after the host's last signs."""
    first = F.concat(F.lit(START * ORDER), host)
    return first, F.concat(F.right(first, F.lit(ORDER)), path, F.lit(END))


def _grams(strings: DataFrame) -> DataFrame:
    """A row per character that follows ``ORDER`` others, with both as ``gram``."""
    signs = F.split("string", "")
    n = F.size("signs") - ORDER
    shifted = [F.slice("signs", k + 1, F.greatest(n, F.lit(0))) for k in range(ORDER + 1)]
    zipped = F.arrays_zip(*[s.alias(f"c{k}") for k, s in enumerate(shifted)])
    return (
        strings.withColumn("signs", signs)
        .select("id", "accepted", "rejected", F.inline(zipped).alias(*[f"c{k}" for k in range(ORDER + 1)]))
        .select("id", "accepted", "rejected", F.concat(*[f"c{k}" for k in range(ORDER + 1)]).alias("gram"))
    )


def _model(grams: DataFrame) -> DataFrame:
    """For every gram the log of the ratio of its two smoothed probabilities."""
    counts = grams.groupBy("gram").agg(
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")
    )
    counts = stored(counts, "url-grams")
    total = counts.agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).first()
    if not total["a"] or not total["r"]:
        return counts.select("gram", F.lit(0.0).alias("ratio"))
    table = counts.select("gram")
    chances = {"accepted": F.lit(1.0 / SIGNS), "rejected": F.lit(1.0 / SIGNS)}
    for order in range(ORDER + 1):
        last = F.right("gram", F.lit(order + 1))
        seen = counts.groupBy(last.alias(f"seen{order}")).agg(
            F.sum("accepted").alias(f"accepted{order}"), F.sum("rejected").alias(f"rejected{order}")
        )
        table = table.join(seen, last == F.col(f"seen{order}"), "left")
        if order:
            context = F.substring(last, 1, order)
            around = counts.groupBy(context.alias(f"context{order}")).agg(
                F.sum("accepted").alias(f"all_accepted{order}"),
                F.sum("rejected").alias(f"all_rejected{order}"),
            )
            table = table.join(around, context == F.col(f"context{order}"), "left")
        else:
            table = table.withColumn("all_accepted0", F.lit(total["a"])).withColumn(
                "all_rejected0", F.lit(total["r"])
            )
        for kind, shorter in chances.items():
            table = table.withColumn(
                f"p_{kind}{order}",
                (F.col(f"{kind}{order}") + SMOOTHING * shorter)
                / (F.col(f"all_{kind}{order}") + SMOOTHING),
            )
            chances[kind] = F.col(f"p_{kind}{order}")
    return table.select("gram", (F.log(chances["accepted"]) - F.log(chances["rejected"])).alias("ratio"))


def _cut(marked: DataFrame) -> float:
    """The score with the smallest sum of error rates; ``marked`` has ``score`` and ``accepted``."""
    place = F.greatest(F.least(F.round(F.col("score") / BIN), F.lit(float(BINS))), F.lit(float(-BINS)))
    bins = marked.groupBy(place.cast("int").alias("bin")).agg(
        F.sum(F.col("accepted").cast("bigint")).alias("a"),
        F.sum((~F.col("accepted")).cast("bigint")).alias("r"),
    )
    rows = sorted((r["bin"], r["a"], r["r"]) for r in bins.collect())  # 2 * BINS + 1 rows at most
    accepted, rejected = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not accepted or not rejected:
        return 0.0
    below_a, below_r, best = 0, 0, (1.0, 0.0, 0.0)
    for i, (_, a, r) in enumerate(rows[:-1]):
        below_a, below_r = below_a + a, below_r + r
        middle = (rows[i][0] + rows[i + 1][0]) / 2 * BIN
        errors = below_a / accepted + 1 - below_r / rejected
        best = min(best, (errors, abs(middle), middle))
    return best[2]


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Host, path, rule, score and verdict of every page."""
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))

    urls = judged.groupBy("host", "path").agg(F.first("_rule.verdict").alias("verdict"))
    first, second = _strings(F.col("host"), F.col("path"))
    aside = F.pmod(F.crc32(F.concat("host", "path").cast("binary")), F.lit(CALIBRATION)) == 0
    counted = F.col("verdict").isNotNull() & ~aside
    strings = (
        urls.select(
            F.explode(F.array(first, second)).alias("string"),
            F.when(counted & (F.col("verdict") == ALLOW), 1).otherwise(0).alias("accepted"),
            F.when(counted & (F.col("verdict") == BLOCK), 1).otherwise(0).alias("rejected"),
        )
        .groupBy("string")
        .agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
        .withColumn("id", F.xxhash64("string"))
    )
    grams = stored(_grams(strings), "url-strings")
    model = stored(_model(grams), "url-model")
    scores = stored(
        grams.select("id", "gram").join(model, "gram").groupBy("id").agg(F.sum("ratio").alias("sum")),
        "url-scores",
    )

    def scored(rows: DataFrame) -> DataFrame:
        one = scores.select(F.col("id").alias("_id1"), F.col("sum").alias("_sum1"))
        two = scores.select(F.col("id").alias("_id2"), F.col("sum").alias("_sum2"))
        size = F.length("host") + F.length("path") + 1
        total = F.coalesce("_sum1", F.lit(0.0)) + F.coalesce("_sum2", F.lit(0.0))
        return (
            rows.join(one, F.xxhash64(first) == F.col("_id1"), "left")
            .join(two, F.xxhash64(second) == F.col("_id2"), "left")
            .withColumn("score", total / size)
            .drop("_id1", "_id2", "_sum1", "_sum2")
        )

    marked = scored(urls.where(F.col("verdict").isNotNull() & aside)).select(
        "score", (F.col("verdict") == ALLOW).alias("accepted")
    )
    cut = _cut(marked)
    by_model = F.when(F.col("score") >= cut, ALLOW).otherwise(BLOCK)
    return scored(judged).select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), by_model).alias("verdict"), "score",
    )

