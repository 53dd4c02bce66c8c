"""The numbered queries over the test tables, with SQL texts where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import alignment, chat_repair, classifier, decontamination, language_model, link_graph, minhash, packing, revisits, rules, sharding, structure_repair, substrings
from ledgerlark.llm.tables import table


def op1_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.judged(table(spark, sf_dir, "pages"))


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op3_fourier_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Four captures of each page: two full responses, each followed by a 304 with validators of some kind.

    Times are hours counted from the page id; every fifth page sends no entity tag and every seventh one
    that does not fit.
    """
    day, n = F.col("page_id") * 24, F.col("page_id")
    page = pages.select("page_id", "url", "html", n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part"))
    version = F.floor(F.col("part") / 2)
    payload = F.md5(F.concat(F.coalesce("html", F.lit("")), F.lit("#"), version.cast("string")))
    tag = F.concat(F.lit('"'), F.substring(payload, 1, 16), F.lit('"'))
    full = F.col("part") % 2 == 0
    fresh_tag = F.when(n % 5 == 0, F.lit(None).cast("string")).when(n % 7 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    changed = F.concat(F.lit("day "), (n + version).cast("string"))
    entries = {
        "ETag": F.when(full, tag).otherwise(fresh_tag),
        "Last-Modified": F.when(n % 11 != 0, changed),
        "Content-Type": F.when(full, F.lit("text/html")).otherwise(F.lit("text/plain")),
        "Cache-Control": F.concat(F.lit("max-age="), (F.col("part") * 60).cast("string")),
        "Date": F.concat(F.lit("hour "), (day + F.col("part")).cast("string")),
    }
    headers = F.map_filter(F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return page.select(
        (n * 4 + F.col("part")).alias("record_id"), "url", (day + F.col("part")).alias("captured_at"), F.when(full, "response").otherwise("revisit").alias("kind"),
        F.when(full, 200).otherwise(304).alias("status"), headers.alias("headers"), F.when(full, payload).alias("payload"),
    )


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolved_revisits(page_captures(table(spark, sf_dir, "pages")))
    names = {"etag": "etag", "last_modified": "last-modified", "content_type": "content-type", "cache_control": "cache-control", "date_header": "date"}
    return found.select("record_id", "url_key", "outcome", "base_id", "status", *[F.col("headers")[h].alias(c) for c, h in names.items()], "payload")


def op6_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op8_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat_repair.repaired_turns(table(spark, sf_dir, "conversations"))
    return found.withColumn("conv_id", F.col("conv_id").cast("bigint"))


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_scores(table(spark, sf_dir, "documents"))


def op10_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op11_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digests(table(spark, sf_dir, "documents"))


def op12_gallop_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(table(spark, sf_dir, "documents"))


def op13_coalescent_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repair_digests(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_link_graph": op1_link_graph,
    "op2_decision_list": op2_decision_list,
    "op3_fourier_classifier": op3_fourier_classifier,
    "op4_bbit_minhash": op4_bbit_minhash,
    "op5_revisits": op5_revisits,
    "op6_cgk_decontamination": op6_cgk_decontamination,
    "op7_bounded_ring": op7_bounded_ring,
    "op8_role_repair": op8_role_repair,
    "op9_deleted_interpolation": op9_deleted_interpolation,
    "op10_bin_completion": op10_bin_completion,
    "op11_fm_index": op11_fm_index,
    "op12_gallop_alignment": op12_gallop_alignment,
    "op13_coalescent_repair": op13_coalescent_repair,
}

_CAPTURES = """
with page as (
    select page_id as n, url, html, part, part // 2 as version, page_id * 24 + part as hour,
           md5(coalesce(html, '') || '#' || (part // 2)) as payload
    from pages, (select unnest(range(4)) as part)
), capture as (
    select n * 4 + part as record_id, hour, part % 2 = 0 as is_full, payload,
           regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') as bare,
           case when part % 2 = 0 then '"' || substr(payload, 1, 16) || '"' when n % 5 = 0 then null when n % 7 = 0 then '"other"'
                else 'W/"' || substr(payload, 1, 16) || '"' end as etag,
           case when n % 11 <> 0 then 'day ' || (n + version) end as last_modified,
           'max-age=' || (part * 60) as cache_control, 'hour ' || hour as date_header
    from page
), keyed as (
    select *, regexp_replace(translate(regexp_extract(bare, '^([^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)$', '') as host,
           regexp_extract(bare, '^[^/?]*([^?]*)', 1) as path,
           regexp_replace(regexp_replace(regexp_extract(bare, '\\?(.*)$', 1), '(^|&)(utm_[a-z]+|gclid|fbclid)=[^&]*', '', 'g'), '^&', '') as query
    from capture
), named as (
    select *, host || case when path = '' then '/' else path end || case when query = '' then '' else '?' || query end as url_key from keyed
)"""

_COMPONENTS = r"""
with recursive worded as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
    from documents
), shingle as (
    select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                        when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as s
    from worded
), size as (
    select doc_id, count(*) as n from shingle group by doc_id
), common as (
    select a.doc_id as x, b.doc_id as y, count(*) as c from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by all
), link as (
    select x, y from common join size p on p.doc_id = x join size q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)
), edge as (
    select x, y from link union all select y, x from link
), reach as (
    select doc_id, doc_id as seen from documents union select reach.doc_id, edge.y from reach join edge on edge.x = reach.seen
), lowest as (
    select doc_id, min(seen) as component_id from reach group by doc_id
)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join lowest using (doc_id) left join size using (doc_id)"""

_REPEATS = r"""
with worded as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), place as (
    select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from worded
), spot as (
    select doc_id, i, array_to_string(ws[i:i + 12], ' ') as w from place
), least as (
    select w, min(doc_id) as low from spot group by w
), gone as (
    select distinct doc_id, unnest(range(i, i + 13)) as i from spot join least using (w) where low < doc_id
), cut as (
    select doc_id, list(i) as removed from gone group by doc_id
)
select doc_id, len(ws)::bigint as n_words, coalesce(len(removed), 0)::bigint as n_removed,
       sha256(array_to_string([w for w, i in ws if not list_contains(coalesce(removed, []), i)], ' ')) as kept_sha256
from worded left join cut using (doc_id)"""

ORACLES: dict[str, str] = {
    "op11_fm_index": _REPEATS,
    "op4_bbit_minhash": _COMPONENTS,
    "op5_revisits": _CAPTURES + """, latest as (
    select r.record_id, r.url_key, r.etag as r_etag, r.last_modified as r_mod, r.cache_control as r_cache, r.date_header as r_date,
           b.record_id as base, b.etag as b_etag, b.last_modified as b_mod, b.payload as b_payload
    from named r left join named b on b.is_full and b.url_key = r.url_key and b.hour < r.hour
    where not r.is_full
    qualify row_number() over (partition by r.record_id order by b.hour desc nulls last, b.record_id desc nulls last) = 1
), judged as (
    select *, case when base is null then 'no_base'
                   when b_etag is not null and r_etag is not null
                       then case when regexp_replace(b_etag, '^W/', '') = regexp_replace(r_etag, '^W/', '') then 'resolved' else 'validator_mismatch' end
                   when b_mod is not null and r_mod is not null then case when b_mod = r_mod then 'resolved' else 'validator_mismatch' end
                   else 'no_validator' end as outcome
    from latest
)
select record_id, url_key, outcome, case when outcome = 'resolved' then base end as base_id, case when outcome = 'resolved' then 200 end as status,
       case when outcome = 'resolved' then coalesce(r_etag, b_etag) end as etag, case when outcome = 'resolved' then b_mod end as last_modified,
       case when outcome = 'resolved' then 'text/html' end as content_type, case when outcome = 'resolved' then r_cache end as cache_control,
       case when outcome = 'resolved' then r_date end as date_header, case when outcome = 'resolved' then b_payload end as payload
from judged""",
}
