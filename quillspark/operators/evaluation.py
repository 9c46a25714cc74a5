"""Criterion evaluation: cache, judge, citation check. Models are pluggable.

A judge is a function of a DataFrame of misses (texto, criterio_*) that adds
``atende``, ``score``, ``justificativa`` and ``trecho_citado``; the default is
deterministic and needs no model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import citation_verified

KEYS = ["chunk_id", "criterio_id", "criterio_versao"]


def keyword_judge(misses: DataFrame) -> DataFrame:
    """Default judge: the share of a key's words that the text holds."""
    words = F.filter(F.split("criterio_chave", "_"), lambda w: F.length(w) > 3)
    share = F.size(F.filter(words, lambda w: F.contains(F.lower("texto"), F.substring(w, 1, 5)))) / F.greatest(F.size(words), F.lit(1))
    return misses.withColumns({"atende": share >= 0.5, "score": share.cast("decimal(4,3)"), "justificativa": F.lit("palavras da chave"), "trecho_citado": F.lit("")})


def recall(candidates: DataFrame, criteria: DataFrame, cache: DataFrame, judge: Callable[[DataFrame], DataFrame] = keyword_judge) -> tuple[DataFrame, DataFrame]:
    """(evaluations that the cache has, fresh ones to append). Candidates are few: what a top-k left."""
    active = criteria.filter("ativo")
    # Every candidate left by a top-k meets every active criterion by definition; the criteria are a handful.
    names = ["criterio_id", "criterio_chave", "criterio_versao"]
    each = active.agg(F.collect_list(F.struct(*names)).alias("__all"))
    wanted = candidates.join(F.broadcast(each)).withColumn("__c", F.explode("__all")).select(*candidates.columns, "__c.*")
    misses = wanted.join(cache.select(*KEYS), KEYS, "left_anti")
    fresh = judge(misses).withColumn("citacao_verificada", citation_verified(F.col("texto"), F.col("trecho_citado")))
    fresh = fresh.select(*KEYS, "atende", F.col("score").cast("decimal(4,3)").alias("score"), "trecho_citado", "citacao_verificada")
    return cache.join(wanted.select(*KEYS), KEYS, "left_semi").select(*fresh.columns), fresh


def evaluate(candidates: DataFrame, criteria: DataFrame, cache: DataFrame, judge: Callable[[DataFrame], DataFrame] = keyword_judge) -> tuple[DataFrame, DataFrame]:
    """(all evaluations, fresh ones to append)."""
    known, fresh = recall(candidates, criteria, cache, judge)
    return known.unionByName(fresh), fresh


def unverified_share(evaluations: DataFrame) -> DataFrame:
    """(citacoes, percentual): citations given, and how many of a hundred do not stand in the text; 0 without any."""
    cited = evaluations.filter(F.coalesce("trecho_citado", F.lit("")) != "")
    return cited.agg(F.count("*").alias("citacoes"), F.coalesce(100.0 * F.avg((~F.col("citacao_verificada")).cast("double")), F.lit(0.0)).alias("percentual"))


def attach(rows: DataFrame, evaluations: DataFrame, criteria: DataFrame) -> DataFrame:
    """Rows with their evaluations as a sorted list, empty where none."""
    named = evaluations.join(criteria.filter("ativo").select("criterio_id", "criterio_versao", F.col("criterio_chave").alias("chave")), ["criterio_id", "criterio_versao"])
    lists = named.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("criterio_id", "chave", "atende", "score"))).alias("avaliacoes"))
    return rows.join(lists, "chunk_id", "left").withColumn("avaliacoes", F.coalesce("avaliacoes", F.array().cast(lists.schema["avaliacoes"].dataType)))
