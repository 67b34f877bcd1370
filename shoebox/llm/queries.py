"""The operators bound to the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chunks, decontaminate, html_text, lloyd, minhash, packing, perplexity, pieces, quality, tool_calls, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(table(spark, sf_dir, "pages"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.linked(*tool_calls.from_chat(table(spark, sf_dir, "conversations")))


def chat_call_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of calls that need later ones: each the next two of its block of four turns."""
    calls = tool_calls.from_chat(table(spark, sf_dir, "conversations"))[0]
    name = lambda k: F.when(F.floor((F.col("turn") + k) / 4) == F.floor(F.col("turn") / 4), F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") + k).cast("string")))
    return tool_calls.ordered(calls.withColumn("after", F.array_compact(F.array(name(1), name(2))))).select("conv_id", "call_id", "topo_order")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(table(spark, sf_dir, "embeddings"))


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), piece_path())


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), piece_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_minhash_near_dedup,
        op3_warc_derivatives,
        op4_packing,
        op5_quality_classifier,
        op6_substring_dedup,
        op7_quality_rules,
        op8_html_extraction,
        op9_chat_formatting,
        chat_call_order,
        op10_benchmark_decontamination,
        op11_centroid_clustering,
        op12_sentencepiece_codec,
        op13_tokenizer_alignment,
    )
}

#: Chats that hold no JSON of their own: each ask is a call, its order the turn.
_CHAT = """
with asks as (select conv_id, turn, case role when 'user' then 'reply' else 'instruct' end as name, text from conversations where role in ('user', 'system')),
answers as (select conv_id, turn, text, row_number() over (partition by conv_id, turn - 1 order by turn, text) as k from conversations where role = 'assistant')
select a.conv_id, a.conv_id || ':' || a.turn as call_id, a.turn, case when r.conv_id is null then 'unanswered' else 'linked' end as status, row_number() over (partition by a.conv_id order by a.turn, a.conv_id || ':' || a.turn, a.name, a.text) - 1 as topo_order,
  case when a.text is null then 'wrong type of prompt' else '' end as problems, a.text is not null as valid,
  '{"arguments":{"prompt":' || coalesce(to_json(a.text)::varchar, 'null') || ',"turn":' || a.turn || '},"id":"' || a.conv_id || ':' || a.turn || '","name":"' || a.name || '","result":' || coalesce(to_json(r.text)::varchar, 'null') || '}' as record
from asks a left join answers r on r.conv_id = a.conv_id and r.turn = a.turn + 1 and r.k = 1
union all
select r.conv_id, r.conv_id || ':' || (r.turn - 1), r.turn, 'orphan', null, '', false, '{"id":"' || r.conv_id || ':' || (r.turn - 1) || '","result":' || coalesce(to_json(r.text)::varchar, 'null') || '}'
from answers r where not exists (select 1 from asks a where a.conv_id = r.conv_id and a.turn = r.turn - 1)
"""

_ORDER = """
with recursive asks as (select conv_id, turn from conversations where role in ('user', 'system')),
needs as (select a.conv_id, a.turn, b.turn as needed from asks a join asks b on a.conv_id = b.conv_id and b.turn in (a.turn + 1, a.turn + 2) and a.turn // 4 = b.turn // 4),
walk(conv_id, turn, depth) as (select conv_id, turn, 0 from asks union select n.conv_id, n.turn, w.depth + 1 from walk w join needs n on n.conv_id = w.conv_id and n.needed = w.turn),
level as (select conv_id, turn, max(depth) as depth from walk group by 1, 2),
odd as (select distinct conv_id from needs)
select a.conv_id, a.conv_id || ':' || a.turn as call_id, row_number() over (partition by a.conv_id order by case when a.conv_id in (select conv_id from odd) then depth else 0 end, a.turn) - 1 as topo_order
from asks a join level l on l.conv_id = a.conv_id and l.turn = a.turn
"""

_NEAR = """
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
sets as materialized (
  select doc_id, unnest(list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from words),
sizes as (select d.doc_id, count(s.s) as n from documents d left join sets s on s.doc_id = d.doc_id group by d.doc_id),
met as (select a.doc_id as x, b.doc_id as y, count(*) as c from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as materialized (select x, y from met join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
reach(x, y) as (select doc_id, doc_id from documents union select r.x, l.y from reach r join links l on r.y = l.x),
least as (select x as doc_id, min(y) as component_id from reach group by x)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from least join sizes using (doc_id)
"""

#: Assignment to centroids c{k}, and the centroids that follow from it.
_ASSIGNED = """
a{k} as materialized (select r, any_value(vec_id) as vec_id, any_value(v) as v, min({{'d': d, 'c': c}}) as b from (select r, vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::bigint as d from kept, c{k}) group by r)"""
_MOVED = """
c{n} as materialized (select o.c, coalesce(n.m, o.m) as m from c{k} o left join (
  select c, list(((s - ((s % n + n) % n)) // n)::bigint order by i) as m from (select b.c as c, i, sum(v[i]) as s, count(*) as n from a{k}, range(1, 65) t(i) group by 1, 2) group by c) n using (c))"""
_LLOYD = (
    """
with kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by sha256('1:' || vec_id), v) - 1 as c, v as m from kept order by c limit 16),"""
    + ",".join(_ASSIGNED.format(k=k) + ("," + _MOVED.format(k=k, n=k + 1) if k < 3 else "") for k in range(4))
    + """
select vec_id, b.c::int as cluster, b.d as distance, (sum(b.d) over (partition by b.c))::bigint as cluster_inertia, (sum(b.d) over ())::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a3 join c3 on c3.c = b.c
"""
)

ORACLE: dict[str, str] = {"op2_minhash_near_dedup": _NEAR, "op11_centroid_clustering": _LLOYD, "op9_chat_formatting": _CHAT, "chat_call_order": _ORDER}
