"""The registered query of each corpus operator, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, langid, mixing, pii, secret_scan, simhash, spotsigs, token_files, toxicity
from .common import table


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edit_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs, langid.train(docs))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_groups(docs, digest="text_sha256")


OP5_SQL = """
with d as (select doc_id, sha256(coalesce(text, '')) h from documents),
g as (select h, max(doc_id) keep_id, count(*) group_size from d group by h)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, d.h as text_sha256
from d join g using (h)
"""


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP6_SQL = r"""
with d as (
  select doc_id, source, size, case when i = 0 then h else md5(h || ':' || i) end h
  from (
    select *, row_number() over (partition by source, h) - 1 i
    from (
      select doc_id, source, md5('mix:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) h,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size
      from documents))),
p as (select source, sum(size)::bigint total from d group by source),
n as (select source, total, row_number() over (order by source nulls last) - 1 s from p),
w as (select source, total, s, case s % 3 when 0 then 5 when 1 then 2 else 1 end w, total * 2 cap from n),
v as (
  select *, (1.5::double * sum(total) over ()::double - coalesce(sum(cap) over (order by cap::double / w, s rows between unbounded preceding and 1 preceding), 0)::double)
         / (sum(w) over () - coalesce(sum(w) over (order by cap::double / w, s rows between unbounded preceding and 1 preceding), 0))::double as lvl
  from w),
o as (
  select *, first_value(case when w * lvl < cap then lvl end ignore nulls) over (order by cap::double / w, s rows between unbounded preceding and current row) as opened
  from v),
t as (select source, total, s, case when opened is null then cap::double else w * opened end target from o),
r as (
  select d.doc_id, d.size, d.h, t.s, t.total, t.target,
         row_number() over (partition by t.s order by d.h) k,
         sum(d.size) over (partition by t.s order by d.h rows unbounded preceding)::bigint cum
  from d join t on d.source is not distinct from t.source),
x as (
  select r.*, e, case when target > 0 then (cum + total * e)::double / target else 0.0::double end vt
  from r, (select unnest([0, 1]) e)),
y as (select *, sum(size) over (order by vt, s, k, e rows unbounded preceding)::bigint upto from x),
b as (select sum(target) budget from t)
select doc_id, size, total as source_size, target,
       (sum(case when upto <= budget then size else 0 end))::bigint as taken
from y, b group by doc_id, s, k, size, total, target
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secret_scan.scan(docs, secret_scan.train(secret_scan.labelled(spark)), path_col="source")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), end_id=2)


def queries() -> dict:
    """The queries by name, ``op<number>_<name>``."""
    own = [op1_spotsigs, op2_langid, op3_pii, op4_bpe, op5_exact_dedup, op6_mix, op7_toxicity, op8_secrets, op9_simhash, op10_token_files]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op6_mix": OP6_SQL}
