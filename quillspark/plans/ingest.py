"""The ingestion plan: pages to documents, entities, chunks and quarantine, in one DAG."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import documents as D
from quillspark.operators import gazetteer
from quillspark.operators import masking as M
from quillspark.operators import store as S
from quillspark.session import materialise
from quillspark.sources.snapshots import SnapshotStore

#: Characters of a document that a describing model sees.
DESCRIBED_CHARS = 3000


@dataclass
class Ingested:
    documentos: DataFrame
    entidades: DataFrame
    chunks: DataFrame
    quarentena: DataFrame


def ingest(pages: DataFrame, manifest: DataFrame, known_hashes: DataFrame | None = None, versions: dict[str, str] | None = None, tagger: Callable[[DataFrame], DataFrame] | None = None, describe: Callable[[DataFrame], DataFrame] | None = None, known_names: DataFrame | None = None) -> Ingested:
    """``pages``: arquivo_local, pagina, native, ocr, tables. ``manifest``: one row per file. ``versions``: by extraction method.

    ``known_names`` (valor) are names that the store has seen; with those in capitals of this run they are found in
    any case, unless another ``tagger`` is given. ``tagger`` adds a column ``nomes`` of names to (hash_sha256, text); ``describe`` adds ``titulo`` and ``sintese`` to
    (documento_id, inicio), the masked beginning of each document; a missing title becomes the readable name.

    Quarantined files stop at the classifier; contents already known (or met
    twice in this run) are skipped; the whole corpus, not one run, decides what
    is boilerplate when ``chunks`` of all runs go through mark_boilerplate().
    """
    read = D.extraction_cascade(pages)
    fate = D.quarantine_documents(read, "arquivo_local")
    bad = fate.filter("tipo_erro IS NOT NULL")
    good = read.join(fate.filter("tipo_erro IS NULL").select("arquivo_local"), "arquivo_local", "left_semi")
    clean = good.withColumn("texto", T.normalise_page(F.col("texto")))
    clean = D.drop_repeated_edges(clean, D.repeated_edges(clean, "arquivo_local", "pagina", "texto"), "arquivo_local", "texto")
    whole = clean.groupBy("arquivo_local").agg(F.collect_list(F.struct("pagina", "texto")).alias("paginas"), F.map_from_entries(F.collect_set(F.struct(F.col("pagina").cast("int"), "metodo"))).alias("metodos"), F.count("*").alias("num_paginas"))
    whole = whole.withColumn("text", D.assemble(F.col("paginas"))).withColumn("hash_sha256", F.sha2("text", 256))
    whole = whole.groupBy("hash_sha256").agg(F.min_by(F.struct("arquivo_local", "num_paginas", "metodos", "text"), "arquivo_local").alias("d")).select("hash_sha256", "d.*")
    if known_hashes is not None:
        whole = whole.join(known_hashes.select("hash_sha256"), "hash_sha256", "left_anti")
    if tagger is None and known_names is not None:
        # Read once more by the tagger and the masks.
        whole = materialise(whole, "whole")
        tagger = gazetteer.tagger(known_names.select("valor").unionByName(gazetteer.upper_names(whole)))
    if tagger is not None:
        whole = whole.join(tagger(whole.select("hash_sha256", "text")).select("hash_sha256", "nomes"), "hash_sha256", "left")
    masked = M.mask(whole, tagged="nomes" if tagger is not None else None).join(D.main_method(good, "arquivo_local"), "arquivo_local").join(manifest, "arquivo_local", "left")
    docs = S.with_key(masked, "documento_id", "hash_sha256").withColumns({
        "tipo_documento": T.act_type(F.col("masked")),
        "nivel_restricao": M.restriction_level(F.col("entities")),
    })
    readable = T.readable_name(F.col("municipio"), F.col("tipo_documento"), F.to_date("data"))
    if describe is None:
        docs = docs.withColumns({"titulo": readable, "sintese": F.lit(None).cast("string")})
    else:
        told = describe(docs.select("documento_id", F.substring("masked", 1, DESCRIBED_CHARS).alias("inicio"))).select("documento_id", F.col("titulo").alias("__titulo"), "sintese")
        docs = docs.join(told, "documento_id", "left").withColumn("titulo", F.coalesce(F.nullif(T.strip(F.col("__titulo")), F.lit("")), readable)).drop("__titulo")
    # Written once: four outputs come from it, and a model sees each document once.
    docs = materialise(docs.drop("paginas", "text", "nomes"), "ingested")
    chunks = D.chunk_table(docs, "documento_id", "masked", methods="metodos", versions=versions)
    chunks = D.mark_boilerplate(S.with_key(chunks, "chunk_id", "documento_id", "indice"), "documento_id", "texto")
    entities = docs.select("documento_id", F.explode("entities").alias("e")).select("documento_id", "e.*")
    kept = ["documento_id", "arquivo_local", "hash_sha256", "num_paginas", "municipio", "data", "metodo", "tipo_documento", "nivel_restricao", "titulo", "sintese"]
    return Ingested(docs.select(*kept), entities, chunks, bad)


def save(made: Ingested, store: SnapshotStore) -> int:
    """Put all four outputs into the tables of ``store`` with one commit; files and contents that are there stay as they are."""
    change = store.transaction()
    change.insert_if_absent("documentos", made.documentos, ["hash_sha256"])
    change.insert_if_absent("quarentena", made.quarentena, ["arquivo_local"])
    change.insert_if_absent("entidades", made.entidades, ["documento_id", "categoria", "pseudonimo"])
    change.insert_if_absent("chunks", made.chunks, ["chunk_id"])
    return change.commit()


def method_report(pages: DataFrame) -> DataFrame:
    """Pages per extraction method, with their share in percent."""
    counts = pages.groupBy("metodo").agg(F.count("*").alias("paginas"))
    return counts.join(F.broadcast(counts.agg(F.sum("paginas").alias("__all")))).select("metodo", "paginas", F.round(100.0 * F.col("paginas") / F.col("__all"), 6).alias("percentual"))
