"""Truth tables of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T


def value(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first()["v"]


def t():
    return F.col("t")


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.join_hyphens, "recebi-\nmento", "recebimento"),
        (T.mark_fields, "Nome: ______ RG: .....", "Nome: [CAMPO] RG: [CAMPO]"),
        (T.collapse_breaks, "a\nb\n\nc\n\n\nd", "a b\n\nc\n\nd"),
        (T.normalise_page, "a\n \nb", "a b"),
        (T.header_key, "Diário Oficial - página 12", "diário oficial - página #"),
        (T.header_key, "p 1", None),
        (T.squeeze, " a  \n b ", "a b"),
        (T.slug, "São João del Rei", "sao-joao-del-rei"),
        (T.act_type, "PORTARIA decreto", "Portaria"),
        (T.act_type, "nada", "Outro"),
        (T.act_type, "resolução e RESOLUÇÃO, portaria", "Resolução"),
        (T.person_like, "JOAO DA SILVA", True),
        (T.person_like, "PREFEITURA MUNICIPAL", False),
        (T.person_like, "JOAO E", False),
        (T.person_like, "JOAO A SILVA", False),
        (T.form_like, "[CAMPO] " * 4 + "w " * 26, True),
        (T.form_like, "[CAMPO] " * 4 + "w " * 27, False),
        (T.form_like, "[CAMPO] " * 3 + "w", False),
        (T.criterion_label, "valores_financeiros", "Valores financeiros"),
        (T.criterion_label, "novo_criterio", "Novo Criterio"),
        (T.good_page, "a" * 39, False),
        (T.good_page, "a" * 40, True),
        (T.good_page, "a" * 20 + "1" * 21, False),
        (T.summary_line, "____\n[TABELA] aaaaaaaaaaaaaaaaaaaaaa\numa linha com bastante texto", "uma linha com bastante texto"),
    ],
)
def test_scalars(spark, f, text, want):
    assert value(spark, f(t()), text) == want


def test_letters(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 25, 26, 701, 702)], "n int").select(T.letters(F.col("n")).alias("v")).collect()
    assert [r.v for r in rows] == ["A", "Z", "AA", "ZZ", "AAA"]


@pytest.mark.parametrize(("cited", "want"), [("a b", True), ("", True), (None, True), ("A b", False)])
def test_citation(spark, cited, want):
    assert value(spark, T.citation_verified(t(), F.lit(cited)), "x a\n  b y") is want


def test_readable_name(spark):
    assert value(spark, T.readable_name(F.lit("Niteroi"), F.lit("Portaria"), F.lit("2026-07-18").cast("date"))) == "Niteroi · Portaria · 18/07/2026"
    assert value(spark, T.readable_name(F.lit("Niteroi"), F.lit(None).cast("string"), F.lit(None).cast("date"))) == "Niteroi · Diário Oficial"


@pytest.mark.parametrize(("score", "legs", "want"), [(0.7, 1, "Alta"), (0.35, 1, "Média"), (0.34, 2, "Média"), (0.34, 1, "Baixa")])
def test_tiers(spark, score, legs, want):
    assert value(spark, T.score_tier(F.lit(score), F.array(*[F.lit("l")] * legs))) == want


def test_blocks_and_segments(spark):
    blocks = value(spark, T.block_list(t()), "corpo do texto DECRETO N 12 segue. conforme Decreto nº 5 cita. Art. 1 fim")
    assert [b.texto[:9] for b in blocks] == ["corpo do ", "DECRETO N", "Art. 1 fi"]
    parts = value(spark, T.display_segments(t()), "o [CPF_A] e [RG_B]")
    assert [(p.protegido, p.texto) for p in parts] == [(False, "o "), (True, "dado protegido"), (False, " e "), (True, "dado protegido")]


def test_lenient_json(spark):
    default = F.struct(F.lit(False).alias("atende"), F.lit(0.0).alias("score"))
    got = [value(spark, T.lenient_json(t(), "atende boolean, score double", "atende", default), x) for x in ('{"atende": true, "score": 1}', 'ok: {"atende": true, "score": 0.5} .', "nada")]
    assert [(g.atende, g.score) for g in got] == [(True, 1.0), (True, 0.5), (False, 0.0)]


def test_slug_decomposes(spark):
    import unicodedata

    texts = ["Žlutý kůň Øre ﬁm Ångström ½ ǆ", "Çedilha São Tomé", "日本 x", "ẞ ĳ Ŀ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.slug(F.col("t")).alias("s")).collect()
    for r in rows[:3]:
        if "½" not in r.t:
            assert r.s == unicodedata.normalize("NFKD", r.t).encode("ascii", "ignore").decode().lower().replace(" ", "-")
    assert rows[1].s == "cedilha-sao-tome"
