"""Queries of the training-data operators (problems 3, 5, 6, 7 and 8) and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methyloom.functions.modcodes import canonical_mod_type
from methyloom.llm import langid, packing, quantiles, tokenise, topn
from methyloom.session import checkpointed, table

SHARES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
CAPACITY = 2048
_GROUPS = ["mod_type", "in_motif"]


COARSE = 0.2
_VALUES = ["n_mod", "n_valid_cov"]


def _by_group() -> dict:
    mod_type = F.col("mod_type")
    return {"mod_type": F.coalesce(canonical_mod_type(mod_type), mod_type), "in_motif": F.col("in_motif")}


def _digests(spark: SparkSession, sf_dir: str, eps: float = quantiles.EPS) -> DataFrame:
    records = table(spark, sf_dir, "annotated_records_multiple")
    return quantiles.digests(records, F.to_date("called_at"), _by_group(), _VALUES, eps)


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of every day, every month and all days, all from the digests of the days."""
    day = F.col("period").cast("string")
    spans = F.array(
        F.struct(F.lit("day").alias("span"), day.alias("of")),
        F.struct(F.lit("month").alias("span"), F.substring(day, 1, 7).alias("of")),
        F.struct(F.lit("all").alias("span"), F.lit("all").alias("of")),
    )
    nodes = _digests(spark, sf_dir).select("*", F.explode(spans).alias("s"))
    groups = ["span", "period", *_GROUPS]
    merged = quantiles.merge(nodes.select("s.span", F.col("s.of").alias("period"), *_GROUPS, "metric", "node", "n", "rank_error"), groups)
    return quantiles.percentiles(merged, groups, SHARES).drop("low")


def p3_rank_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles over all days from digests that compress strongly, each held against the rows: is its rank within the bound?"""
    found = quantiles.percentiles(quantiles.merge(_digests(spark, sf_dir, COARSE), _GROUPS), _GROUPS, SHARES)
    ranked = quantiles.ranks(table(spark, sf_dir, "annotated_records_multiple"), _by_group(), checkpointed(found))
    target = F.greatest(F.lit(1), F.ceil(F.round(F.col("share") * F.col("n"), 6)))
    within = (F.col("n_upto") >= target) & (F.col("n_below") < target + F.greatest("rank_error", F.lit(1)))
    bounded = F.col("rank_error") <= COARSE * F.col("n")
    return ranked.select(*_GROUPS, "metric", "share", "n", "rank_error", (within & bounded).alias("within_bound"))


def p3_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the intermediate results: values and nodes per day, group and metric."""
    return (
        _digests(spark, sf_dir)
        .groupBy(F.col("period").alias("day"), *_GROUPS, "metric")
        .agg(F.sum("n").alias("n"), F.count("*").alias("n_nodes"), F.sum("rank_error").alias("rank_error"))
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "motif_result").select("contig_id", "result_id", "motif", "score")
    return topn.top_n(results, "contig_id", "score", ["motif", "result_id"], 5).select("contig_id", "result_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise.encode(table(spark, sf_dir, "documents"), "text", ["doc_id"])


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids decoded again: bytes of the text that comes back, and whether it is the text."""
    documents = table(spark, sf_dir, "documents")
    back = tokenise.decode(tokenise.encode(documents, "text", ["doc_id", "text"]), "ids", ["doc_id", "text"], "decoded")
    return back.select("doc_id", F.octet_length("decoded").alias("n_bytes"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokenise.count_tokens(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY).withColumnsRenamed({"first": "first_token", "size": "n_tokens"})


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for the containers: all documents with tokens are in, whole or in full parts, no container overflows, little is unused."""
    placed = checkpointed(p7_containers(spark, sf_dir))
    per_document = placed.groupBy("doc_id").agg(
        F.sum("n_tokens").alias("n"), F.count("*").alias("parts"), F.countDistinct("part").alias("distinct_parts"),
        F.max(F.col("first_token") + F.col("n_tokens")).alias("end"),
    )
    minimal = (F.col("parts") == F.ceil(F.col("n") / CAPACITY)) & (F.col("parts") == F.col("distinct_parts")) & (F.col("end") == F.col("n"))
    documents = per_document.agg(F.count("*").alias("n_documents"), F.count(F.when(~minimal, 1)).alias("n_badly_split"))
    filled = placed.groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    least = F.ceil(F.sum("fill") / CAPACITY)
    used = F.count("*")
    containers = filled.agg(
        F.count(F.when(F.col("fill") > CAPACITY, 1)).alias("n_overfull"),
        (F.max("container") + 1 == used).alias("numbered_without_gaps"),
        (used - least <= F.greatest(F.lit(1), F.floor(least / 100))).alias("within_1_percent"),
    )
    return documents.select("*", *(containers.select(c).scalar().alias(c) for c in containers.columns))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.text_model(table(spark, sf_dir, "lang_samples"))
    names = langid.language_names(table(spark, sf_dir, "lang_codes"))
    return langid.passages(table(spark, sf_dir, "documents"), model, names)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.wrong_labels(_passages(spark, sf_dir))


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of each document with their letters and confidence."""
    return langid.languages_of(_passages(spark, sf_dir)).drop("label", "total")


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage in one language: where it stands, its letters, language and confidence."""
    return _passages(spark, sf_dir).select("doc_id", F.posexplode("passages").alias("passage", "p")).select("doc_id", "passage", "p.*")


QUERIES = {
    "p3_percentiles": p3_percentiles,
    "p3_daily": p3_daily,
    "p3_rank_bound": p3_rank_bound,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_languages": p8_languages,
    "p8_passages": p8_passages,
}

_LEVELS = quantiles.LONG.levels
_K, _K_COARSE = (math.ceil(_LEVELS / eps) for eps in (quantiles.EPS, COARSE))
_MOD = "case mod_type when 'a' then '6mA' when 'm' then '5mC' when '21839' then '4mC' else mod_type end"
_LONG = f"""
  long as (select cast(called_at as date) as day, {_MOD} as mod_type, in_motif, 'n_mod' as metric, n_mod as v from annotated_records_multiple where n_mod is not null
           union all select cast(called_at as date), {_MOD}, in_motif, 'n_valid_cov', n_valid_cov from annotated_records_multiple where n_valid_cov is not null)"""

SQL = {
    # exact percentiles, then the upper edge of the cell: equal as long as no day holds _K values of a group
    "p3_percentiles": f"""with {_LONG},
      spans as (select *, 'day' as span, strftime(day, '%Y-%m-%d') as period from long union all
                select *, 'month', strftime(day, '%Y-%m') from long union all select *, 'all', 'all' from long),
      daily as (select span, period, mod_type, in_motif, metric, cast(sum(n // {_K}) * {_LEVELS} as bigint) as rank_error
                from (select span, period, day, mod_type, in_motif, metric, count(*) as n from spans group by all) group by all),
      ranked as (select span, period, mod_type, in_motif, metric, v, row_number() over (partition by span, period, mod_type, in_motif, metric order by v) as r,
                        count(*) over (partition by span, period, mod_type, in_motif, metric) as n from spans),
      wanted as (select span, period, mod_type, in_motif, metric, share, n, v from ranked, (select unnest([{', '.join(map(str, SHARES))}]::double[]) as share)
                 where r = greatest(1, ceil(round(share * n, 6))))
      select w.span, w.period, w.mod_type, w.in_motif, w.metric, w.share, w.n,
             cast(case when v < 2048 then v else (((v >> s) + 1) << s) - 1 end as bigint) as value, d.rank_error
      from (select *, cast(case when v < 2048 then 0 else floor(log2(v)) - 10 end as integer) as s from wanted) w
      join daily d on d.span = w.span and d.period = w.period and d.metric = w.metric
        and d.mod_type is not distinct from w.mod_type and d.in_motif is not distinct from w.in_motif""",
    # the nodes of a day are its cells as long as no day holds _K values of a group
    "p3_daily": f"""with {_LONG}, edged as (select *, case when v < 2048 then v else (((v >> s) + 1) << s) - 1 end as edge from
        (select *, cast(case when v < 2048 then 0 else floor(log2(v)) - 10 end as integer) as s from long))
      select day, mod_type, in_motif, metric, count(*) as n, count(distinct edge) as n_nodes, cast(count(*) // {_K} * {_LEVELS} as bigint) as rank_error
      from edged group by day, mod_type, in_motif, metric""",
    "p3_rank_bound": f"""with {_LONG},
      daily as (select mod_type, in_motif, metric, cast(sum(n) as bigint) as n, cast(sum(n // {_K_COARSE}) * {_LEVELS} as bigint) as rank_error
                from (select day, mod_type, in_motif, metric, count(*) as n from long group by all) group by all)
      select mod_type, in_motif, metric, share, n, rank_error, true as within_bound
      from daily, (select unnest([{', '.join(map(str, SHARES))}]::double[]) as share)""",
    "p5_found": """select contig_id, result_id from (select contig_id, result_id,
        row_number() over (partition by contig_id order by score desc, motif, result_id) as r
        from motif_result where contig_id is not null and score is not null and not isnan(score)) where r <= 5""",
    "p7_fill": """select count(*) as n_documents, cast(0 as bigint) as n_badly_split, cast(0 as bigint) as n_overfull,
        true as numbered_without_gaps, true as within_1_percent from documents where text <> ''""",
    "p6_round_trip": "select doc_id, cast(strlen(coalesce(text, '')) as integer) as n_bytes, true as same from documents",
}
