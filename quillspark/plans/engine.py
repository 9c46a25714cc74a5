"""The request surface: each method returns a DataFrame, or the table that a change results in.

Reads that must leave a trace return the audit rows too; the caller appends
them once, so a plan that runs twice does not log twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import documents as D
from quillspark.operators import embedding as V
from quillspark.operators import evaluation as E
from quillspark.operators import masking as M
from quillspark.operators import retrieval as R
from quillspark.operators import store as S
from quillspark.operators.text_index import TextIndex
from quillspark.session import materialise

MOST_CASES = 10


@dataclass
class Request:
    """``consulta`` decides what matches and is ranked by; without it any of ``terms`` does."""

    terms: list[str]
    vector: list[float]
    consulta: str = ""
    modo: str = "hibrido"
    limite: int = 8
    perfil: str = "sem_clearance"
    municipio: str | None = None
    tipo_documento: str | None = None
    avaliar: bool = True
    incluir_padronizados: bool = False


@dataclass
class Answer:
    resultados: DataFrame
    auditoria: DataFrame | None
    novas_avaliacoes: DataFrame | None


class SearchEngine:
    """Tables: documentos, entidades, chunks (chunk_id, documento_id, texto, eh_padronizado, embedding), criterios, avaliacoes.

    ``embed`` makes the vector of a query text; without it the request's vector is used as it is, and for a request
    without one the text is hashed as ``operators.embedding`` hashes chunks. ``index`` over the chunks' texts, by
    chunk_id, spares the lexical leg its scan; its scores then weigh words by all chunks, not by those that a filter leaves.
    """

    def __init__(self, documentos: DataFrame, entidades: DataFrame, chunks: DataFrame, criterios: DataFrame, avaliacoes: DataFrame, embed: Callable[[str], list[float]] | None = None, judge: Callable[[DataFrame], DataFrame] = E.keyword_judge, index: TextIndex | None = None):
        self.embed, self.judge, self.index = embed, judge, index
        self.documentos, self.entidades, self.chunks, self.criterios, self.avaliacoes = documentos, entidades, chunks, criterios, avaliacoes

    def filtros(self) -> tuple[DataFrame, DataFrame]:
        return filter_values(self.documentos, "municipio"), filter_values(self.documentos, "tipo_documento")

    def search(self, request: Request) -> Answer:
        """Retrieve, then drop what may not be seen, unmask if cleared, evaluate the masked text, re-rank."""
        wanted = R.prefilter(self.documentos, {"municipio": request.municipio, "tipo_documento": request.tipo_documento})
        pool = R.prefilter(self.chunks.join(wanted.select("documento_id"), "documento_id", "left_semi"), None, "eh_padronizado", request.incluir_padronizados)
        docs, vectors = pool.select("chunk_id", F.col("chunk_id").alias("doc_id"), F.col("texto").alias("text")), pool.select(F.col("chunk_id").alias("vec_id"), "embedding")
        terms, vector, test, named = request.terms, request.vector, None, None
        if request.consulta.strip():
            terms, test = T.query_terms(request.consulta), T.parse_query(request.consulta)
            pseudonyms, named = self._named(request.consulta, pool)
            embed = self.embed if self.embed is not None or request.vector else self._hashed
            if embed is not None:
                vector = embed(" ".join([request.consulta, *pseudonyms]))
        scored = None
        if self.index is not None and request.modo != "vetorial":
            # What a filter leaves is known only after scoring, so nothing is cut before it.
            scored = self.index.scores(terms, "doc_id", query=request.consulta if request.consulta.strip() else None).join(pool.select(F.col("chunk_id").alias("doc_id")), "doc_id", "left_semi")
        # A vector of the enriched text leads to the pseudonyms by itself; one that came with the request cannot.
        hits = R.search(request.modo, docs, vectors, terms, vector, request.limite, test, named, named if self.embed is None else None, scored)
        if request.modo == "lexico":
            hits = hits.withColumnRenamed("doc_id", "id")
        elif request.modo == "vetorial":
            hits = hits.withColumnRenamed("vec_id", "id")
        score = "rrf_score" if request.modo == "hibrido" else "score"
        # A few rows, written once: answer, audit and evaluations do not search again, and the judge runs once.
        ranked = materialise(hits.select(F.col("id").alias("chunk_id"), F.col(score).alias("pontuacao")), "ranked")
        rows = ranked.join(self.chunks.drop("embedding"), "chunk_id").join(self.documentos.select("documento_id", "municipio", "tipo_documento", "nivel_restricao", "titulo"), "documento_id")
        cleared = request.perfil == "com_clearance"
        rows = R.visible(rows, "nivel_restricao", cleared)
        fresh = None
        if request.avaliar:
            known, fresh = E.recall(rows.select("chunk_id", "texto"), self.criterios, self.avaliacoes, self.judge)
            fresh = materialise(fresh, "evaluations")
            found = known.unionByName(fresh)
            rows = E.attach(rows, found, self.criterios)
        else:
            rows = rows.withColumn("avaliacoes", F.expr("cast(array() as array<struct<criterio_id:int,chave:string,atende:boolean,score:decimal(4,3)>>)"))
        audit = None
        if cleared:
            rows = self._unmasked(rows)
            audit = M.audit_rows(rows.select("documento_id", "chunk_id"), self.entidades, "documento_id", request.perfil)
        best = F.coalesce(F.array_max(F.transform("avaliacoes", lambda e: e["score"])), F.lit(0).cast("decimal(4,3)"))
        rows = rows.withColumns({"score_criterios": best, "resumo": T.summary_line(F.col("texto"))})
        return Answer(rows.orderBy(F.desc("score_criterios"), F.desc("pontuacao"), "chunk_id"), audit, fresh)

    @staticmethod
    def _hashed(consulta: str) -> list[float]:
        return V.hashed([consulta])[0].tolist()

    def _named(self, consulta: str, pool: DataFrame) -> tuple[list[str], DataFrame | None]:
        """Pseudonyms of what the query names, and (id, own) of the chunks of ``pool`` that hold one."""
        meant = M.resolve(consulta, self.entidades).select("valor", "pseudonimo")
        pseudonyms = [r[0] for r in meant.select("pseudonimo").distinct().orderBy("pseudonimo").collect()]
        if not pseudonyms:
            return [], None
        holds = reduce(lambda a, b: a | b, [F.contains("texto", F.lit(p)) for p in pseudonyms])
        own = self.entidades.join(meant, ["valor", "pseudonimo"], "left_semi").groupBy("documento_id").agg(F.collect_set("pseudonimo").alias("__own"))
        found = pool.filter(holds).join(own, "documento_id", "left")
        return pseudonyms, found.select(F.col("chunk_id").alias("id"), F.coalesce(F.exists("__own", lambda p: F.contains("texto", p)), F.lit(False)).alias("own"))

    def documento_completo(self, documento_id: str, perfil: str) -> tuple[str, DataFrame | None, DataFrame | None]:
        """("ok", text, audit rows) or ("proibido"/"ausente", None, None); who is cleared sees the real values."""
        row = self.documentos.filter(F.col("documento_id") == documento_id).select("nivel_restricao").first()
        if row is None:
            return "ausente", None, None
        if row[0] == "sigiloso" and perfil != "com_clearance":
            return "proibido", None, None
        mine = F.col("documento_id") == documento_id
        parts = self.chunks.filter(mine)
        text = D.whole_text(parts, "documento_id", "indice", "texto").join(parts.groupBy("documento_id").agg(F.count("*").alias("num_chunks")), "documento_id")
        if perfil != "com_clearance":
            return "ok", text, None
        known = self.entidades.filter(mine)
        return "ok", self._unmasked(text), M.audit_rows(self.documentos.filter(mine).select("documento_id"), known, "documento_id", perfil)

    def _unmasked(self, rows: DataFrame) -> DataFrame:
        # Only the entities of what is shown are gathered; ``rows`` are few.
        shown = self.entidades.join(rows.select("documento_id").distinct(), "documento_id", "left_semi")
        lists = shown.groupBy("documento_id").agg(F.array_sort(F.collect_list(F.struct("pseudonimo", "valor"))).alias("__e"))
        return rows.join(lists, "documento_id", "left").withColumn("texto", F.when(F.col("__e").isNotNull(), M.unmask(F.col("texto"), F.col("__e"))).otherwise(F.col("texto"))).drop("__e")

    def padronizados(self) -> DataFrame:
        flags = F.count_if("eh_padronizado")
        return self.chunks.agg(flags.alias("padronizados"), F.count("*").alias("total"), F.coalesce(100.0 * flags / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("percentual"))


def new_case(casos: DataFrame, row: DataFrame) -> DataFrame:
    return S.bounded_insert(casos, row, MOST_CASES)


def rename_case(casos: DataFrame, caso_id: int, nome: str) -> tuple[int, DataFrame]:
    """(affected rows, table); an empty name becomes the default."""
    name = F.coalesce(F.nullif(T.strip(F.lit(nome)), F.lit("")), F.lit("Novo caso"))
    return casos.filter(F.col("id") == caso_id).count(), S.update(casos, F.col("id") == caso_id, {"nome": name})


def dossier(itens: DataFrame, chunks: DataFrame, documentos: DataFrame, avaliacoes: DataFrame, criterios: DataFrame, caso_id: int) -> DataFrame:
    rows = itens.filter(F.col("caso_id") == caso_id).join(chunks.select("chunk_id", "documento_id", "texto"), "chunk_id").join(documentos.select("documento_id", "titulo"), "documento_id")
    return E.attach(rows, avaliacoes, criterios).orderBy("criado_em", "chunk_id")


def judge_relevance(avaliacoes: DataFrame, row: DataFrame) -> DataFrame:
    """Thumbs: the last one per case and chunk holds; null removes it."""
    keys = ["caso_id", "chunk_id"]
    return S.upsert(avaliacoes, row, keys, "criado_em").filter("relevante IS NOT NULL")


def list_cases(casos: DataFrame) -> DataFrame:
    return casos.orderBy("criado_em", "id")


def add_item(itens: DataFrame, row: DataFrame) -> tuple[bool, DataFrame]:
    """(whether the case already had the chunk, table)."""
    keys = ["caso_id", "chunk_id"]
    return not S.already_there(itens, row, keys).isEmpty(), S.insert_if_absent(itens, row, keys, [F.col("criado_em")])


def remove_item(itens: DataFrame, caso_id: int, chunk_id: str) -> DataFrame:
    return itens.filter(~F.coalesce((F.col("caso_id") == caso_id) & (F.col("chunk_id") == chunk_id), F.lit(False)))


def annotate_item(itens: DataFrame, caso_id: int, chunk_id: str, nota: str | None) -> tuple[int, DataFrame]:
    """(affected rows, table); none means that the case has no such item."""
    hit = (F.col("caso_id") == caso_id) & (F.col("chunk_id") == chunk_id)
    return itens.filter(hit).count(), S.update(itens, hit, {"nota": F.lit(nota).cast("string")})


def list_judgements(avaliacoes: DataFrame, caso_id: int) -> DataFrame:
    return avaliacoes.filter(F.col("caso_id") == caso_id).select("chunk_id", "relevante")


def listing(rows: DataFrame, search: list[str], date: str, key: str, q: str | None = None, kind: str | None = None, kind_column: str = "tipo_documento", limit: int = 200) -> DataFrame:
    """The newest rows, undated ones last, that have ``q`` in one of the ``search`` columns and are of a ``kind``."""
    if q:
        rows = rows.filter(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{q}%") for c in search]))
    rows = R.prefilter(rows, {kind_column: kind})
    return rows.orderBy(F.desc_nulls_last(date), key).limit(limit)


def acervo(documentos: DataFrame, quarentena: DataFrame, q: str | None = None, tipo: str | None = None, limite: int = 200) -> tuple[DataFrame, DataFrame]:
    """(processed, unprocessed): the newest documents that match, and the newest files in quarantine."""
    done = listing(documentos, ["arquivo_local", "municipio"], "data", "documento_id", q, tipo, limit=limite).withColumn("status", F.lit("Processado"))
    newest = [F.desc_nulls_last("criado_em")] if "criado_em" in quarentena.columns else []
    return done, quarentena.orderBy(*newest, "arquivo_local").limit(limite)


def give_feedback(feedback: DataFrame, row: DataFrame) -> DataFrame:
    return feedback.unionByName(row)


def approval_stats(feedback: DataFrame, keyed: DataFrame, on: str, key: str, useful: str) -> DataFrame:
    """(key, aprovados, total) by key, every version of a criterion pooled."""
    return feedback.join(keyed.select(on, key).distinct(), on).groupBy(key).agg(F.count_if(F.col(useful)).alias("aprovados"), F.count("*").alias("total")).orderBy(key)


def quarantine_stats(documentos_ok: DataFrame, quarentena: DataFrame) -> DataFrame:
    """(tipo_erro, total, total_ok, total_quarentena, percentual): one row per class of error, the most frequent first."""
    by_kind = quarentena.groupBy("tipo_erro").agg(F.count("*").alias("total"))
    sums = documentos_ok.agg(F.count("*").alias("total_ok")).join(by_kind.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total_quarentena")))  # one row each
    share = F.coalesce(100.0 * F.col("total_quarentena") / F.nullif(F.col("total_ok") + F.col("total_quarentena"), F.lit(0)), F.lit(0.0))
    return by_kind.join(F.broadcast(sums)).withColumn("percentual", share).orderBy(F.desc("total"), "tipo_erro")


def filter_values(rows: DataFrame, column: str) -> DataFrame:
    """The values that a filter offers, sorted."""
    return rows.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column)
