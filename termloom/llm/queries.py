"""Queries p2 to p8 and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import canonical, encoding, frequency, neardup, packing, subjects, tokens

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id of every document with characters read in a wrong encoding."""
    return encoding.garbled(table(spark, d, "documents"))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with their encoding chain and the text as far as it can be restored."""
    return encoding.judged(table(spark, d, "documents")).where("garbled").select("doc_id", "chain", "restored", "complete")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with at least half of their three-word runs in common."""
    return neardup.duplicate_pairs(table(spark, d, "documents"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its class of copies, its group and the number of links of its class."""
    return neardup.groups(table(spark, d, "documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and index rows that hold disguised characters."""
    return canonical.disguised(table(spark, d, "documents"), table(spark, d, "inverted_index"))


def p4_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in canonical form, with what was changed."""
    return canonical.canonical(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "canonical", "kinds", "changed")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every stored term in canonical form, with what was changed."""
    return canonical.canonical(table(spark, d, "inverted_index"), "entry_id", "term").select("entry_id", "term", "canonical", "kinds", "changed")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms of too few or too many documents, with their mark."""
    return frequency.marked(table(spark, d, "inverted_index")).where("mark is not null").select("term", "mark")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents, occurrences and list entries of every term."""
    return frequency.counted(table(spark, d, "inverted_index"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encoded(table(spark, d, "documents"))


def p6_multi_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by the vocabulary for many languages."""
    return tokens.encoded(table(spark, d, "documents"), "byte_bpe_multi_50k")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents larger than a container."""
    return packing.split_documents(table(spark, d, "documents"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document's pieces with their containers."""
    return packing.packed(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are and how full they are."""
    return packing.containers(table(spark, d, "documents"))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return subjects.classified(*(table(spark, d, name) for name in ("documents", "subject_labels", "subject_areas")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The subject areas of every document."""
    return _classified(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """The make-up of the collection: documents and summed share of text of each subject."""
    return _classified(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.sum("share"), 3).alias("share"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p2_found, p2_restored, p3_found, p3_groups, p4_found, p4_documents, p4_terms, p5_found, p5_counts, p6_ids, p6_multi_ids, p7_found, p7_packed, p7_containers, p8_found, p8_composition)}


_PAIRS = r"""
with recursive words as (
    select distinct on (doc_id) doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null
), runs as (
    select distinct doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as run
    from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from words where len(w) >= 3)
), sizes as (
    select doc_id, count(*) as n from runs group by doc_id
), pairs as (
    select doc_id_a, doc_id_b
    from (select x.doc_id as doc_id_a, y.doc_id as doc_id_b, count(*) as common
          from runs x join runs y on x.run = y.run and x.doc_id < y.doc_id group by all)
    join sizes a on a.doc_id = doc_id_a join sizes b on b.doc_id = doc_id_b
    where common >= 0.5 * (a.n + b.n - common)
)"""

_COUNTS = """
with entries as (
    select term, segment_id, p.doc_id as doc_id, coalesce(p.tf, 0)::bigint as tf
    from (select term, segment_id, unnest(posting_list) as p from inverted_index where term is not null)
    where p.doc_id is not null
), merged as (
    select term, doc_id, arg_max(tf, {'s': coalesce(segment_id, -1), 't': tf}) as tf, count(*) as n from entries group by all
), counts as (
    select term, count(*)::bigint as doc_frequency, sum(tf)::bigint as occurrences, sum(n)::bigint as deliveries from merged group by term
)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _PAIRS + " select doc_id_a, doc_id_b from pairs",
        "p3_groups": _PAIRS
        + """, links as (select doc_id_a as x, doc_id_b as y from pairs union select doc_id_b, doc_id_a from pairs),
        signs as (select doc_id, string_agg(run, '|' order by run) as sign from runs group by doc_id),
        reps as (select doc_id, min(doc_id) over (partition by sign) as rep from signs),
        reach(x, y) as (select x, y from links union select r.x, l.y from reach r join links l on l.x = r.y),
        classes as (select distinct a.rep as rep, b.rep as other from links join reps a on a.doc_id = x join reps b on b.doc_id = y where a.rep <> b.rep),
        degrees as (select rep, count(*) as n from classes group by rep)
        select d.doc_id, coalesce(reps.rep, d.doc_id) as rep, least(d.doc_id, coalesce(min(reach.y), d.doc_id)) as group_id, coalesce(any_value(degrees.n), 0)::bigint as n_links
        from (select distinct doc_id from documents where doc_id is not null) d left join reps using (doc_id) left join degrees on degrees.rep = reps.rep left join reach on reach.x = d.doc_id
        group by d.doc_id, reps.rep""",
        "p5_found": _COUNTS
        + """ select term, case when doc_frequency <= 2 then 'rare' else 'common' end as mark
        from counts, (select count(distinct p.doc_id) as n_all from (select unnest(posting_list) as p from inverted_index))
        where doc_frequency <= 2 or doc_frequency > 0.30 * n_all""",
        "p5_counts": _COUNTS + " select * from counts",
    }
