"""Ranked retrieval: lexical and vector legs, reciprocal rank fusion, enrichment.

Each leg is cut to its candidates by a top-k before anything is numbered, so no
global window sees more than a few dozen rows. Long columns join after the cut.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import rules
from quillspark.functions.text import sql_double, tokens
from quillspark.session import materialise


def prefilter(rows: DataFrame, equals: dict[str, str | None] | None = None, flag: str | None = None, include_flagged: bool = False) -> DataFrame:
    """Optional equalities (null or empty: no filter) and the boilerplate exclusion."""
    for name, value in (equals or {}).items():
        if value:
            rows = rows.filter(F.col(name) == value)
    return rows if include_flagged or flag is None else rows.filter(~F.col(flag))


def _count_of(term: str) -> Column:
    return F.size(F.filter("w", lambda x: x == term))


def bm25(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, all_terms: bool = False, test: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(key, score) of documents with any (or all) of ``terms``, or that pass ``test`` of (tokens, lower-cased text); one pass over the texts, sums only are shared.

    Term counts are columns, so nothing is exploded; document frequencies and
    the mean length are one aggregate joined back as a single row.
    """
    words = docs.select(key, tokens(F.col(text)).alias("w"), *([] if test is None else [F.lower(F.coalesce(F.col(text), F.lit(""))).alias("l")]))
    passed = [] if test is None else [test(F.col("w"), F.col("l")).alias("passed")]
    # A few numbers a document, written once: statistics and scores do not cut the texts into words again.
    counted = materialise(words.select(key, F.size("w").alias("dl"), *passed, *[_count_of(t).alias(f"tf{i}") for i, t in enumerate(terms)]), "term-counts")
    stats = counted.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hit = [F.col(f"tf{i}") > 0 for i in range(len(terms))]
    matched = counted.filter(reduce((lambda x, y: x & y) if all_terms else (lambda x, y: x | y), hit) if test is None else F.col("passed"))
    joined = matched.join(F.broadcast(stats))  # one row by construction

    def part(i: int) -> Column:
        idf = F.log(1 + (F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        return idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))

    return joined.select(key, F.round(reduce(lambda x, y: x + y, [part(i) for i in range(len(terms))] or [F.lit(0.0)]), 6).alias("score"))


def cosine(vector: str, query: list[float]) -> Column:
    """Cosine of a column of vectors and one vector, in double precision."""
    q = f"array({', '.join(sql_double(x) for x in query)})"
    dot = f"aggregate(zip_with({vector}, {q}, (a, b) -> cast(a AS double) * b), 0.0D, (s, x) -> s + x)"
    norm = f"sqrt(aggregate({vector}, 0.0D, (s, x) -> s + cast(x AS double) * cast(x AS double)))"
    return F.expr(f"{dot} / ({norm} * {sql_double(sum(float(x) ** 2 for x in query) ** 0.5)})")


def vector_scores(rows: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return rows.filter(F.col(vector).isNotNull()).select(F.col(key), F.round(cosine(vector, query), 6).alias("score"))


def top_k(scored: DataFrame, k: int, key: str) -> DataFrame:
    return scored.orderBy(F.desc("score"), key).limit(k)


def ranked(leg: DataFrame, key: str, name: str) -> DataFrame:
    """Number a leg that is cut already."""
    return leg.select(F.col(key).alias("id"), F.row_number().over(Window.orderBy(F.desc("score"), key)).alias(f"{name}_pos"), F.col("score").alias(f"{name}_score"))


def fuse(lexical: DataFrame, vector: DataFrame, k: int = rules.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two numbered legs, with provenance; ties keep lexical order first.

    Both legs are cut already, a few dozen rows on one partition each, so they are merged there without a shuffle.
    """
    legs = lexical.unionByName(vector, allowMissingColumns=True).coalesce(1)
    both = legs.groupBy("id").agg(*[F.min(c).alias(c) for c in ("lex_pos", "vec_pos")], *[F.max(c).alias(c) for c in ("lex_score", "vec_score")])
    rrf = f"round(coalesce(1.0D / ({k} + lex_pos), 0.0D) + coalesce(1.0D / ({k} + vec_pos), 0.0D), 6) AS rrf_score"
    found = "array_compact(array(CASE WHEN lex_pos IS NOT NULL THEN 'lexical' END, CASE WHEN vec_pos IS NOT NULL THEN 'vetorial' END)) AS encontrado_em"
    return both.selectExpr("id", "lex_pos", "vec_pos", "lex_score", "vec_score", rrf, found)


def fused_top(fused: DataFrame, limit: int) -> DataFrame:
    return fused.orderBy(F.desc("rrf_score"), F.asc_nulls_last("lex_pos"), F.asc_nulls_last("vec_pos"), "id").limit(limit)


def leg(scored: DataFrame, key: str, k: int, named: DataFrame | None = None) -> DataFrame:
    """Top-k of a leg. ``named`` (id, own): rows that hold a pseudonym of what the query names; own ones, whose
    document gives it that meaning, stand first, the others count 1."""
    hits = top_k(scored, k, key)
    if named is None:
        return hits
    best = hits.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("best"))
    extra = named.join(F.broadcast(best)).select(F.col("id").alias(key), F.when(F.col("own"), F.greatest(F.col("best"), F.lit(1.0)) + 1).otherwise(F.lit(1.0)).alias("score"))
    return merge_extra_hits(hits, extra, key, k)


def hybrid(docs: DataFrame | None, vectors: DataFrame, terms: list[str], query: list[float], limit: int, leg_limit: int = rules.LEG_LIMIT, test: Callable[[Column, Column], Column] | None = None, lex_named: DataFrame | None = None, vec_named: DataFrame | None = None, scored: DataFrame | None = None) -> DataFrame:
    """Fused top of both legs. ``scored`` (doc_id, score), as a stored index gives it, stands for the scan of ``docs``."""
    lexical = ranked(leg(bm25(docs, terms, test=test) if scored is None else scored, "doc_id", leg_limit, lex_named), "doc_id", "lex")
    vector = ranked(leg(vector_scores(vectors, query), "vec_id", leg_limit, vec_named), "vec_id", "vec")
    return fused_top(fuse(lexical, vector), limit)


def search(mode: str, docs: DataFrame, vectors: DataFrame, terms: list[str], query: list[float], limit: int, test: Callable[[Column, Column], Column] | None = None, lex_named: DataFrame | None = None, vec_named: DataFrame | None = None, scored: DataFrame | None = None) -> DataFrame:
    """Mode dispatch: lexico, vetorial or hibrido."""
    if mode == "lexico":
        return leg(bm25(docs, terms, test=test) if scored is None else scored, "doc_id", limit, lex_named)
    if mode == "vetorial":
        return leg(vector_scores(vectors, query), "vec_id", limit, vec_named)
    if mode == "hibrido":
        return hybrid(docs, vectors, terms, query, limit, test=test, lex_named=lex_named, vec_named=vec_named, scored=scored)
    raise ValueError(f"unknown mode: {mode}")


def merge_extra_hits(main: DataFrame, extra: DataFrame, key: str, k: int) -> DataFrame:
    """Union of two scored lists; a row in both keeps its larger score. (An extra hit counts 1 or stands above all, so
    the larger score is that of the lexical row, or of a row whose own document means the query.)"""
    return top_k(main.unionByName(extra).groupBy(key).agg(F.max("score").alias("score")), k, key)


def visible(rows: DataFrame, level: str, cleared: bool) -> DataFrame:
    """Row visibility, to be applied after the limit."""
    return rows if cleared else rows.filter(F.coalesce(F.col(level), F.lit("sigiloso")) != "sigiloso")


def rerank(rows: DataFrame, evaluations: str, position: str) -> DataFrame:
    """Largest evaluation score (0 if none), then the order of retrieval."""
    best = F.coalesce(F.array_max(F.transform(evaluations, lambda e: e["score"])), F.lit(0).cast("decimal(4,3)"))
    return rows.withColumn("score_criterios", best).orderBy(F.desc("score_criterios"), position)


def first_seen(hits: DataFrame, group: str, position: str) -> DataFrame:
    """Distinct groups in the order of their best position."""
    return hits.groupBy(group).agg(F.min(position).alias(position)).orderBy(position, group)


def recall_precision(retrieved: DataFrame, relevant: DataFrame, keys: list[str]) -> DataFrame:
    """Per query: recall and precision over distinct documents; ``keys`` is [query, document]."""
    got, want = retrieved.select(*keys).distinct(), relevant.select(*keys).distinct()
    hits = got.join(want, keys, "left_semi").groupBy(keys[0]).agg(F.count("*").alias("hits"))
    sizes = want.groupBy(keys[0]).agg(F.count("*").alias("wanted")).join(got.groupBy(keys[0]).agg(F.count("*").alias("shown")), keys[0], "left").join(hits, keys[0], "left")
    h = F.coalesce("hits", F.lit(0))
    return sizes.select(keys[0], (h / F.col("wanted")).alias("recall"), F.coalesce(h / F.nullif("shown", F.lit(0)), F.lit(0.0)).alias("precision"))


def mode_report(measured: DataFrame, by: list[str]) -> DataFrame:
    """Means of recall, precision and latency over questions, by mode, or by mode and kind of question."""
    return measured.groupBy(*by).agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("latencia").alias("latencia"), F.count("*").alias("perguntas"))


def top_and_rest(rows: DataFrame, order: list[Column], first: int = 6) -> tuple[DataFrame, DataFrame]:
    """The first rows of a short ranked list, and what comes after them."""
    numbered = rows.withColumn("posicao", F.row_number().over(Window.orderBy(*order)))
    return numbered.filter(F.col("posicao") <= first), numbered.filter(F.col("posicao") > first)
