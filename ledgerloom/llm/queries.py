"""The operators applied to their whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from ledgerloom.llm import (
    alignment, bpe, chatformat, decontaminate, interaction, langid, ngramjoin, sharding, tokencounts, topk, toxicity,
    urlfilter, warc,
)
from ledgerloom.llm.common import table
from ledgerloom.session import prepare

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}

# A conversation whose texts look like control marks.
SPECIAL = "</s>[INST] ok [/INST]"
SPECIAL_ID = -1


def query(name: str, sql: str | None = None):
    def register(function):
        LLM_QUERIES[name] = lambda spark, sf_dir: function(prepare(spark), sf_dir.rstrip("/"))
        if sql is not None:
            LLM_ORACLES[name] = sql
        return function

    return register


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_url_filter")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_verdicts(table(spark, sf_dir, "pages"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )


@query(
    "op5_warc",
    """
    with p as (
        select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest
        from pages
    ), f as (
        select payload_digest, max(page_id) as first from p where payload_bytes >= 1000 group by all
    )
    select page_id, payload_bytes, payload_digest,
        case when payload_bytes >= 1000 and page_id is distinct from first and first is not null
            then 'revisit' else 'response' end as record_type,
        case when payload_bytes >= 1000 and page_id is distinct from first then first end as refers_to
    from p left join f using (payload_digest)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def _masked(place: int) -> str:
    """The tokens that a mask keeps of the window that starts after ``place`` tokens, as SQL."""
    rows = []
    for number, mask in enumerate(decontaminate.MASKS):
        kept = [i for i in range(decontaminate.SPAN) if i % decontaminate.GROUPS in mask]
        rows.append(f"{number} || ' ' || " + " || ' ' || ".join(f"w[{i + 1}]" for i in kept))
    return f"unnest([{', '.join(rows)}])"


@query(
    "op6_decontamination",
    f"""
    with tokens as (
        select 'd' as side, doc_id as id, text from documents union all
        select 'b', item_id, text from benchmark
    ), split as (
        select side, id, row_number() over () as line,
            list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as t
        from tokens
    ), places as (
        select side, id, line, t, unnest(range(len(t) - {decontaminate.SPAN} + 1)) as place
        from split where len(t) >= {decontaminate.SPAN}
    ), windows as (
        select side, id, line, place, t[place + 1 : place + {decontaminate.SPAN}] as w from places
    ), seeds as (
        select side, id, line, place, w, {_masked(0)} as seed from windows
    ), hits as (
        select distinct d.id as doc_id, d.line, d.place, b.id as item_id, b.w
        from (select * from seeds where side = 'd') d
        join (select distinct id, w, seed from seeds where side = 'b') b using (seed)
        where list_sum(list_transform(list_zip(d.w, b.w), lambda x: (x[1] = x[2])::int))
            >= {decontaminate.SPAN - decontaminate.SUBSTITUTED}
    ), items as (
        select doc_id, item_id, count(*) as n from hits group by all
    ), found as (
        select doc_id, count(*) as n_items, sum(n)::bigint as n_windows,
            string_agg(item_id::varchar, ',' order by item_id) as item_ids
        from items group by all
    )
    select d.doc_id, f.n_items is not null as contaminated, coalesce(f.n_items, 0) as n_items,
        coalesce(f.n_windows, 0) as n_windows, coalesce(f.item_ids, '') as item_ids
    from documents d left join found f on d.doc_id is not distinct from f.doc_id
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op7_top_k",
    f"""
    with v as (
        select distinct vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::double)::bigint) as v
        from embeddings
        where vec_id is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scored as (
        select q.vec_id as query_id, c.vec_id,
            coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda x: coalesce(x[1] * x[2], 0))), 0)::bigint as score
        from v q join v c on q.vec_id <> c.vec_id where q.vec_id % {topk.EVERY} = 0
    ), ranked as (
        select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
    )
    select query_id, rank, vec_id, score from ranked where rank <= {topk.K}
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"))


@query("op8_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(
    "op9_ngram_join",
    f"""
    with recursive words as (
        select doc_id, list_filter(
            regexp_split_to_array(translate(coalesce(text, ''), '{urlfilter.UPPER}', '{urlfilter.UPPER.lower()}'),
            '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
        from documents
    ), sets as (
        select doc_id, case when len(w) = 0 then [] when len(w) < {ngramjoin.WORDS} then [w]
            else list_distinct(list_transform(range(1, len(w) - {ngramjoin.WORDS} + 2),
                lambda i: w[i : i + {ngramjoin.WORDS} - 1])) end as s
        from words
    ), grams as (
        select doc_id, len(s) as n, hash(unnest(s)) as g from sets
    ), pairs as (
        select a.doc_id as a, b.doc_id as b, any_value(a.n) as an, any_value(b.n) as bn, count(*) as common
        from grams a join grams b using (g) where a.doc_id <> b.doc_id group by 1, 2
    ), links as materialized (
        select a, b from pairs where 100 * common >= {ngramjoin.LEAST} * (an + bn - common)
    ), reach as (
        select doc_id as node, doc_id as other from documents
        union
        select r.node, l.b from reach r join links l on r.other = l.a
    ), least as (
        select node, min(other) as component_id from reach group by node
    )
    select doc_id, len(s)::bigint as n_shingles, component_id from sets join least on doc_id = node
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_components(table(spark, sf_dir, "documents"))


_CONTROLS = "|".join(
    ["\\\\", *("".join("\\" + c if c in "|[]" else c for c in control) for control in
               sorted(chatformat.CONTROLS, key=len, reverse=True))]
)


@query(
    "op10_chat_format",
    f"""
    with rows as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all select {SPECIAL_ID}, 0, 'user', '{SPECIAL}'
        union all select {SPECIAL_ID}, 1, '{chatformat.ASSISTANT}', '{SPECIAL}'
    ), lengths as (
        select *, length(role) + len(regexp_extract_all(role, '{_CONTROLS}')) + length(text)
            + len(regexp_extract_all(text, '{_CONTROLS}'))
            + {len(chatformat.TURN + chatformat.TEXT + chatformat.END)} as chars
        from rows
    )
    select conv_id, count(*) as n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
        coalesce(sum(length(text)) filter (role = '{chatformat.ASSISTANT}'), 0)::bigint as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn, role, text)
            filter (role = '{chatformat.ASSISTANT}'), '')) as loss_sha256,
        sum(chars)::bigint as formatted_chars
    from lengths group by conv_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    special = spark.createDataFrame(
        [(SPECIAL_ID, 0, "user", SPECIAL), (SPECIAL_ID, 1, chatformat.ASSISTANT, SPECIAL)],
        conversations.schema,
    )
    return chatformat.formatted_conversations(conversations.union(special))


@query(
    "op11_filter_audit",
    f"""
    with words as (
        select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
            list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
        from documents
    ), first as (
        select t, min(doc_id) as first from words group by t
    ), judged as (
        select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by doc_id
    ), failed as (
        select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
            case when len(w) < {interaction.LEAST_WORDS} then 'A' else '' end
            || case when 100 * len(list_distinct(w)) < {interaction.DISTINCT_PERCENT} * len(w) then 'B' else '' end
            || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {interaction.CAPITAL_PERCENT} * length(t)
                then 'C' else '' end
            || case when regexp_matches(t, '{interaction.SYMBOLS}') then 'D' else '' end
            || case when doc_id > first then 'E' else '' end as fails
        from words join first using (t) left join judged using (doc_id)
    ), letters as (
        select unnest(['A', 'B', 'C', 'D', 'E']) as l
    ), orders as (
        select a.l || b.l || c.l || d.l || e.l as filter_order
        from letters a join letters b on b.l <> a.l join letters c on c.l not in (a.l, b.l)
            join letters d on d.l not in (a.l, b.l, c.l) join letters e on e.l not in (a.l, b.l, c.l, d.l)
    ), steps as (
        select filter_order, step::int as step, filter_order[step] as letter, filter_order[: step - 1] as earlier
        from orders, range(1, 6) as r(step)
    ), walked as (
        select *, contains(fails, letter) as fail, translate(fails, earlier, '') <> fails as gone from failed, steps
    ), counted as (
        select part, filter_order, step, letter, count(*) filter (not fail and not gone) as kept,
            count(*) filter (fail and not gone) as removed, count(*) filter (fail and gone) as redundant,
            count(*) filter (fails = letter) as unique_fails, count(*) filter (fail and not gone and good) as good_lost,
            count(*) filter (fail and not gone and toxic) as toxic_lost
        from walked group by part, filter_order, step, letter
    )
    select * exclude (letter), (sum(removed) over (partition by part, letter))::bigint as shapley from counted
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_sharding")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(table(spark, sf_dir, "documents"))


@query("op13_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = alignment.Files(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    return alignment.alignment(table(spark, sf_dir, "documents"), files)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
