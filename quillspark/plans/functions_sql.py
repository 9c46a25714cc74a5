"""The SQL form of vector search: a table function over registered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHUNKS, DOCUMENTS = "quill_chunks", "quill_documentos"


def register_match_chunks(spark: SparkSession, chunks: DataFrame, documentos: DataFrame) -> None:
    """``SELECT * FROM match_chunks(vector, n, municipio, tipo[, incluir_padronizados])``, both forms.

    ``chunks``: chunk_id, documento_id, texto, eh_padronizado, embedding. ``documentos``: documento_id, municipio,
    tipo_documento. A null filter is none. The best n are kept on every partition before they meet.
    """
    chunks.createOrReplaceTempView(CHUNKS)
    documentos.createOrReplaceTempView(DOCUMENTS)
    dot = "aggregate(zip_with({0}, {1}, (a, b) -> cast(a AS double) * cast(b AS double)), 0.0D, (s, x) -> s + x)"
    cosine = f"{dot.format('c.embedding', 'match_chunks.consulta')} / (sqrt({dot.format('c.embedding', 'c.embedding')}) * sqrt({dot.format('match_chunks.consulta', 'match_chunks.consulta')}))"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION match_chunks(consulta ARRAY<DOUBLE>, quantos INT, filtro_municipio STRING, filtro_tipo STRING, incluir_padronizados BOOLEAN DEFAULT false)
        RETURNS TABLE (chunk_id STRING, documento_id STRING, texto STRING, municipio STRING, tipo_documento STRING, similaridade DOUBLE)
        RETURN SELECT chunk_id, documento_id, texto, municipio, tipo_documento, similaridade FROM (
          SELECT *, row_number() OVER (ORDER BY similaridade DESC, chunk_id) AS posicao FROM (
            SELECT cast(c.chunk_id AS string) AS chunk_id, cast(d.documento_id AS string) AS documento_id, c.texto, d.municipio, d.tipo_documento, round({cosine}, 6) AS similaridade
            FROM {CHUNKS} c JOIN {DOCUMENTS} d ON c.documento_id = d.documento_id
            WHERE c.embedding IS NOT NULL AND (match_chunks.filtro_municipio IS NULL OR d.municipio = match_chunks.filtro_municipio)
              AND (match_chunks.filtro_tipo IS NULL OR d.tipo_documento = match_chunks.filtro_tipo) AND (match_chunks.incluir_padronizados OR NOT c.eh_padronizado)))
        WHERE posicao <= match_chunks.quantos""")
