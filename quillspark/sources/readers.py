"""Sources and sinks: documents by path, JSON manifests, page adapters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import slug, squeeze
from quillspark.session import ship_code

MANIFEST = "municipio string, territory_id string, data string, edicao string, url_origem string, arquivo_local string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as there are partitions."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, sha256) of binary files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))


def not_landed(manifest: DataFrame, landed: DataFrame, key: str = "arquivo_local") -> DataFrame:
    """Catalogue rows whose file is not there yet."""
    return manifest.join(landed.select(key), key, "left_anti")


def landing_name(place: Column, date: Column, base: Column) -> Column:
    return F.concat_ws("_", slug(place), date, base)


def extract_with(files: DataFrame, extractor: Callable[[bytes], list[tuple[int, str]]]) -> DataFrame:
    """(path, pagina, texto, tipo_erro): a page extractor over file contents; its errors become rows."""

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out += [(path, n, t, None) for n, t in extractor(bytes(content))]
                except UnicodeError as e:
                    out.append((path, None, str(e), "encoding_invalido"))
                except ValueError as e:
                    out.append((path, None, str(e), "pdf_corrompido"))
                except Exception as e:  # an extractor may fail in any way; its document is quarantined
                    out.append((path, None, str(e), "outro"))
            yield pd.DataFrame(out, columns=["path", "pagina", "texto", "tipo_erro"])

    ship_code(files.sparkSession)
    return files.select("path", "content").mapInPandas(body, "path string, pagina int, texto string, tipo_erro string")


def html_text(html: Column) -> Column:
    """Visible text of simple markup, without a parser."""
    bare = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return squeeze(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))
