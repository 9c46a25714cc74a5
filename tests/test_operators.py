"""Operators against hand-derived expectations."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import documents as D
from quillspark.operators import masking as M
from quillspark.operators import retrieval as R
from quillspark.operators import store as S


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first()["v"]


def test_mask_and_back(spark):
    text = "CPF 123.456.789-09 e 123.456.789-09 e 987.654.321-00, RG 12.345.678-9, 04.122.001, JOAO DA SILVA assina"
    row = M.mask(spark.createDataFrame([(text,)], "text string")).select("masked", "entities", M.unmask(F.col("masked"), F.col("entities")).alias("back"), M.restriction_level(F.col("entities")).alias("level")).first()
    assert "CPF [CPF_A] e [CPF_A] e [CPF_B]" in row.masked and "[RG_A]" in row.masked and "04.122.001" in row.masked and "[PESSOA_A]" in row.masked
    assert row.back == text and row.level == "sigiloso"


def test_mask_plain_text(spark):
    row = M.mask(spark.createDataFrame([("nada aqui",)], "text string")).first()
    assert row.masked == "nada aqui" and row.entities == []


def test_rrf(spark):
    lex = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 1.0)], "id string, lex_pos int, lex_score double")
    vec = spark.createDataFrame([("b", 1, 0.9), ("c", 2, 0.8)], "id string, vec_pos int, vec_score double")
    got = R.fused_top(R.fuse(lex, vec), 3).collect()
    assert [(r.id, r.rrf_score) for r in got] == [("b", 0.032522), ("a", 0.016393), ("c", 0.016129)]
    assert got[0].encontrado_em == ["lexical", "vetorial"]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        R.search("outro", None, None, [], [], 1)


@pytest.mark.parametrize(("chars", "low", "want"), [(None, None, "texto_vazio"), (99, 0.0, "texto_vazio"), (299, 0.0, "texto_insuficiente"), (300, 0.8, "falha_ocr"), (300, 0.6, None)])
def test_quarantine(spark, chars, low, want):
    assert one(spark, D.quarantine(F.lit(chars).cast("int"), F.lit(low).cast("double")), "") == want


def test_cascade(spark):
    good = "texto bom " * 6
    rows = [(1, good, "x", []), (2, "x", good, ["t1"]), (3, "", "..", [])]
    got = {r.p: (r.texto, r.metodo) for r in D.extraction_cascade(spark.createDataFrame(rows, "p int, native string, ocr string, tables array<string>")).collect()}
    assert got == {1: (good, "nativo"), 2: (good + "\n\n[TABELA]\nt1", "ocr"), 3: ("..", "ocr_baixa_confianca")}


def test_chunks(spark):
    assert len(one(spark, D.chunks(F.col("t")), "a" * 999 + "\n\n" + "b" * 999)) == 2
    assert len(one(spark, D.chunks(F.col("t")), "a" * 999 + "\n\n" + "b" * 997)) == 1
    assert one(spark, D.chunks(F.col("t")), "c" * 79) == [] and len(one(spark, D.chunks(F.col("t")), "c" * 80)) == 1
    long = ". ".join("S" + "x" * 700 for _ in range(4))
    assert [len(c) for c in one(spark, D.chunks(F.col("t")), long)] == [1405, 1404]


def test_pages(spark):
    got = one(spark, D.strip_markers(F.col("t")), "<<PAGINA:3>>" + "a" * 50 + "<<PAGINA:4>>bb")
    assert got.texto == "a" * 50 + "bb" and [(p.off, p.pagina) for p in got.paginas] == [(0, 3), (50, 4)]
    at = lambda n: one(spark, D.page_at(D.strip_markers(F.col("t"))["paginas"], F.lit(n)), "<<PAGINA:3>>" + "a" * 50 + "<<PAGINA:4>>bb")
    assert (at(49), at(50)) == (3, 4) and one(spark, D.page_at(D.strip_markers(F.col("t"))["paginas"], F.lit(5)), "zz") == 1


def test_headers(spark):
    pages = spark.createDataFrame([(1, p, f"Diario Oficial {p}\ncorpo {p} de texto\nfim da pagina {p * 7}") for p in range(1, 4)], "d int, p int, texto string")
    edges = D.repeated_edges(pages, "d", "p", "texto", depth=1)
    assert {r.linha for r in edges.collect()} == {"diario oficial #", "fim da pagina #"}
    assert {r.texto for r in D.drop_repeated_edges(pages, edges, "d", "texto").collect()} == {f"corpo {p} de texto" for p in range(1, 4)}


def test_boilerplate(spark):
    rows = [(d, f"Declaro que [PESSOA_{chr(65 + d)}] leu") for d in range(5)] + [(9, "outro texto")]
    got = D.mark_boilerplate(spark.createDataFrame(rows, "d int, t string"), "d", "t")
    assert {r.d: r.eh_padronizado for r in got.collect()} == {**{d: True for d in range(5)}, 9: False}


def test_columns(spark):
    words = [(1, 600.0, 10.0 + 300 * (i % 2) + i % 5, 60.0 + 300 * (i % 2) + i % 5, f"w{i}", 10.0 * (i // 2), 10.0 * (i // 2) + 8) for i in range(40)]
    frame = spark.createDataFrame(words, "p int, largura double, x0 double, x1 double, text string, top double, bottom double")
    assert 64 < D.column_gap(frame, "p").first().corte < 335
    assert D.column_gap(frame.limit(28), "p").count() == 0
    assert {r.texto for r in D.column_lines(frame, "p").collect()} == {f"w{i} w{i + 1}" for i in range(0, 40, 2)}


def test_store(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ts int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2), (3, "e", 3)], "k int, v string, ts int")
    rows = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert rows(S.insert_if_absent(table, new, ["k"], [F.col("ts")])) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(S.upsert(table, new, ["k"], "ts")) == [(1, "a"), (2, "c"), (3, "e")]
    assert rows(S.delete(table, new, ["k"])) == [(1, "a")]
    assert rows(S.update(table, F.col("k") == 1, {"v": F.lit("z")})) == [(1, "z"), (2, "b")]
    assert S.already_there(table, new, ["k"]).count() == 1
    with pytest.raises(ValueError):
        S.bounded_insert(table, new, 4)


def test_visibility_and_rerank(spark):
    rows = spark.createDataFrame([(1, "publico", 0.2), (2, "sigiloso", 0.9), (3, "restrito", 0.5)], "pos int, nivel string, s double")
    assert R.visible(rows, "nivel", False).count() == 2 and R.visible(rows, "nivel", True).count() == 3
    scored = rows.withColumn("av", F.array(F.struct(F.col("s").cast("decimal(4,3)").alias("score"))))
    assert [r.pos for r in R.rerank(scored, F.col("av"), "pos").collect()] == [2, 3, 1]


def test_streaming(spark, tmp_path):
    from quillspark.streaming import ingest

    rows = spark.sql("select timestamp'2024-01-01 00:00:00' as ts, 'a' as texto union all select timestamp'2024-01-01 00:01:00', 'a' union all select timestamp'2024-01-01 00:02:00', 'b'")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.once_per_content(ingest.landing_stream(spark, str(tmp_path / "in"), "ts timestamp, texto string"), "texto", "ts")
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain_chunks(text, least=80, limit=2000):
    """Paragraphs of one line, packed, located one behind the other, written out plainly."""
    import re

    def pack(pieces, gap):
        done, cur = [], None
        for p in pieces:
            if cur is not None and len(cur) + len(gap) + len(p) + len(gap) > limit:
                done.append(cur)
                cur = p
            else:
                cur = p if cur is None else cur + gap + p
        return done + ([cur] if cur is not None else [])

    groups, run = [], []
    for p in [p for p in text.split("\n") if p.strip()]:
        if len(p) > limit:
            groups += pack(run, "\n")
            run = []
            sentences = re.split(r"(?<=[.!?])\s+(?=[A-ZÀ-Ú0-9\[])", p)
            groups += pack(sentences if len(sentences) > 1 else re.split(r"\s+", p), " ")
        else:
            run.append(p)
    groups += pack(run, "\n")
    out, cursor = [], 0
    for g in (g.strip() for g in groups):
        at = text.find(g, cursor)
        at = cursor if at < 0 else at
        cursor = at + len(g)
        if g and len(g) >= least:
            out.append((g, at))
    return out


def test_chunk_query_against_plain_code(spark):
    from quillspark.plans import catalogue

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in catalogue.QUERIES["greedy_chunks"](spark, sf).orderBy("doc_id", "indice").collect():
        assert r.offset_fim == r.offset_inicio + len(r.texto) and r.pagina == 1
        got.setdefault(r.doc_id, []).append((r.texto, r.offset_inicio))
    assert got == {i: c for i, t in texts.items() if (c := plain_chunks(t))}


def test_repeated_chunks_have_their_own_offsets(spark):
    a, b = "a" * 1990, "b" * 1000
    text = f"<<PAGINA:1>>{a}\n\n{b}\n\n<<PAGINA:2>>x{'c' * 1500}\n\n<<PAGINA:3>>{a}"
    rows = D.chunk_table(spark.createDataFrame([(1, text, {1: "nativo", 3: "ocr"})], "doc_id int, text string, m map<int,string>"), methods="m", versions={"ocr": "ocr-5"}).orderBy("indice").collect()
    assert [(r.offset_inicio, r.pagina, r.metodo_extracao, r.metodo_extracao_versao) for r in rows] == [(0, 1, "nativo", "nativo"), (1992, 1, "nativo", "nativo"), (2994, 2, "nativo", "nativo"), (4497, 3, "ocr", "ocr-5")]


def test_headers_leave_the_body_alone(spark):
    """A body line that equals the header, or the last line that equals it, stays; pages of one line have no footer."""
    pages = spark.createDataFrame([(1, p, f"Diario Oficial\ncorpo {p}\nDiario Oficial\nfim {p}") for p in range(1, 4)] + [(1, 4, "Diario Oficial")], "d int, p int, texto string")
    edges = D.repeated_edges(pages, "d", "p", "texto")
    assert {(r.lado, r.linha, r.paginas) for r in edges.collect()} == {("cabecalho", "diario oficial", 4)}
    assert {r.p: r.texto for r in D.drop_repeated_edges(pages, edges, "d", "texto").collect()} == {**{p: f"corpo {p}\nDiario Oficial\nfim {p}" for p in range(1, 4)}, 4: ""}


def test_upsert_of_null_versions(spark):
    table = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, v string, ts int")
    new = spark.createDataFrame([(1, "c", None), (2, "d", None), (3, "e", None)], "k int, v string, ts int")
    assert sorted((r.k, r.v) for r in S.upsert(table, new, ["k"], "ts").collect()) == [(1, "c"), (2, "b"), (3, "e")]
