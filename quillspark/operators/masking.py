"""Pseudonyms that are stable inside a document, and their way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions.text import let, letters, person_like


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)


def mask_category(text: Column, name: str, pattern: str) -> Column:
    """Each distinct match, in order of first sight, becomes [NAME_A], [NAME_B], ..."""

    def build(ms: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda seg: let(F.array_distinct(ms), lambda vals: F.concat(
            F.array_join(F.transform(ms, lambda v, i: F.concat(F.get(seg, i), F.lit(f"[{name}_"), letters(F.array_position(vals, v) - 1), F.lit("]"))), ""),
            F.element_at(seg, -1))))

    return let(matches(text, pattern), lambda ms: F.when(F.size(ms) == 0, text).otherwise(build(ms)))


def entities(text: Column, name: str, pattern: str) -> Column:
    """array<struct<categoria, pseudonimo, valor>> in order of first sight."""
    return let(F.array_distinct(matches(text, pattern)), lambda vals: F.transform(vals, lambda v, i: F.struct(F.lit(name).alias("categoria"), F.concat(F.lit(f"[{name}_"), letters(i), F.lit("]")).alias("pseudonimo"), v.alias("valor"))))


def mask_names(text: Column) -> Column:
    """Upper-case runs that read as a person's name become [PESSOA_A], ..."""

    def build(ms: Column) -> Column:
        people = F.array_distinct(F.filter(ms, person_like))
        return let(F.split(text, rules.UPPER_NAME, -1), lambda seg: let(people, lambda vals: F.concat(
            F.array_join(F.transform(ms, lambda v, i: F.concat(F.get(seg, i), F.when(F.array_contains(vals, v), F.concat(F.lit("[PESSOA_"), letters(F.array_position(vals, v) - 1), F.lit("]"))).otherwise(v))), ""),
            F.element_at(seg, -1))))

    return let(matches(text, rules.UPPER_NAME), lambda ms: F.when(F.size(ms) == 0, text).otherwise(build(ms)))


def mask_tagged(text: Column, found: Column, tagged: Column) -> Column:
    """struct<text, entities>: names that a tagger gave become further [PESSOA_X], numbered on from those in ``found``.

    Longer names go first, so that one inside another does not break it.
    """
    real = F.filter(F.array_distinct(F.coalesce(tagged, F.array().cast("array<string>"))), lambda n: (F.trim(n) != "") & ~n.rlike(rules.PLACEHOLDER))
    order = F.transform(F.array_sort(F.transform(real, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n")))), lambda s: s["n"])
    start = F.struct(text.alias("text"), found.alias("entities"))

    def add(acc: Column, name: Column) -> Column:
        mark = F.concat(F.lit("[PESSOA_"), letters(F.size(F.filter(acc["entities"], lambda e: e["categoria"] == "PESSOA"))), F.lit("]"))
        one = F.struct(F.lit("PESSOA").alias("categoria"), mark.alias("pseudonimo"), name.alias("valor"))
        hit = F.contains(acc["text"], name)
        return F.struct(F.when(hit, F.replace(acc["text"], name, mark)).otherwise(acc["text"]).alias("text"), F.when(hit, F.concat(acc["entities"], F.array(one))).otherwise(acc["entities"]).alias("entities"))

    return F.aggregate(order, start, add)


def mask(docs: DataFrame, text: str = "text", categories: list[tuple] = rules.CATEGORIES, names: bool = True, tagged: str | None = None) -> DataFrame:
    """``docs`` with ``masked`` text and its ``entities``; categories in order, each over the text left by the one before.

    ``tagged`` names a column of names that an entity tagger found.
    """
    out = docs.withColumn("masked", F.col(text)).withColumn("entities", F.expr("cast(array() as array<struct<categoria:string,pseudonimo:string,valor:string>>)"))
    if names:
        people = let(F.array_distinct(F.filter(matches(F.col("masked"), rules.UPPER_NAME), person_like)), lambda vals: F.transform(vals, lambda v, i: F.struct(F.lit("PESSOA").alias("categoria"), F.concat(F.lit("[PESSOA_"), letters(i), F.lit("]")).alias("pseudonimo"), v.alias("valor"))))
        out = out.withColumn("entities", people).withColumn("masked", mask_names(F.col("masked")))
    if tagged:
        out = out.withColumn("__t", mask_tagged(F.col("masked"), F.col("entities"), F.col(tagged))).withColumns({"masked": F.col("__t.text"), "entities": F.col("__t.entities")}).drop("__t")
    for name, pattern, *_ in categories:
        out = out.withColumn("entities", F.concat("entities", entities(F.col("masked"), name, pattern))).withColumn("masked", mask_category(F.col("masked"), name, pattern))
    return out


def unmask(text: Column, found: Column) -> Column:
    """Literal replacement of every pseudonym, in order."""
    return F.aggregate(found, text, lambda t, e: F.replace(t, e["pseudonimo"], e["valor"]))


def restriction_level(found: Column) -> Column:
    """CPF or RG: sigiloso; a person: restrito; else publico."""
    kinds = F.transform(found, lambda e: e["categoria"])
    return F.when(F.arrays_overlap(kinds, F.array(F.lit("CPF"), F.lit("RG"))), "sigiloso").when(F.array_contains(kinds, "PESSOA"), "restrito").otherwise("publico")


def resolve(query: str, index: DataFrame, shortest: int = 4) -> DataFrame:
    """Entity rows whose value the query names, of at least ``shortest`` characters."""
    q = F.lower(F.lit(query))
    return index.filter((F.length("valor") >= shortest) & F.contains(q, F.lower("valor"))).dropDuplicates(["valor", "pseudonimo"])


def audit_rows(results: DataFrame, index: DataFrame, key: str, user: str) -> DataFrame:
    """One row per result and entity of its document, for the caller to append once: pseudonyms only, never what they stand for."""
    return results.join(index, key).select(key, "pseudonimo", F.lit(user).alias("perfil"))
