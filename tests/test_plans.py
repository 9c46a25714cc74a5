"""The ingestion plan and the request surface on a small corpus."""

import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.operators.text_index import TextIndex
from quillspark.plans import catalogue, engine, harness, ingest
from quillspark.session import materialise


@pytest.fixture(scope="module")
def corpus(spark):
    body = "PORTARIA N 1 nomeia servidora para o cargo publico de analista, com efeitos financeiros e valores de contratacao. " * 3
    rows = [("a.pdf", 1, body + "CPF 123.456.789-09", "", []), ("b.pdf", 1, body.replace("PORTARIA", "DECRETO"), "", []), ("c.pdf", 1, "x", "", []), ("d.pdf", 1, body.replace("PORTARIA", "DECRETO"), "", [])]
    pages = spark.createDataFrame(rows, "arquivo_local string, pagina int, native string, ocr string, tables array<string>")
    manifest = spark.createDataFrame([(f"{x}.pdf", "Niteroi", "2026-07-18") for x in "abcd"], "arquivo_local string, municipio string, data string")
    made = ingest.ingest(pages, manifest)
    # Stored tables, as a service reads them.
    return ingest.Ingested(*[materialise(t, "t") for t in (made.documentos, made.entidades, made.chunks, made.quarentena)])


def test_ingest(corpus):
    docs = {r.arquivo_local: r for r in corpus.documentos.collect()}
    assert set(docs) == {"a.pdf", "b.pdf"}
    assert (docs["a.pdf"].nivel_restricao, docs["a.pdf"].tipo_documento, docs["a.pdf"].titulo) == ("sigiloso", "Portaria", "Niteroi · Portaria · 18/07/2026")
    assert docs["b.pdf"].tipo_documento == "Decreto"
    assert [(r.arquivo_local, r.tipo_erro) for r in corpus.quarentena.collect()] == [("c.pdf", "texto_vazio")]
    assert {r.valor for r in corpus.entidades.filter("categoria = 'CPF'").collect()} == {"123.456.789-09"}
    assert all("123.456.789-09" not in r.texto and r.pagina == 1 for r in corpus.chunks.collect())


@pytest.mark.parametrize("mode", ["lexico", "vetorial", "hibrido"])
def test_search(spark, corpus, mode):
    chunks = corpus.chunks.withColumn("embedding", F.array(F.lit(1.0), F.col("indice").cast("double")))
    criteria = spark.createDataFrame(rules.CRITERIA, "criterio_id int, criterio_chave string, criterio_versao int, ativo boolean")
    cache = spark.createDataFrame([], "chunk_id string, criterio_id int, criterio_versao int, atende boolean, score decimal(4,3), trecho_citado string, citacao_verificada boolean")
    search = engine.SearchEngine(corpus.documentos, corpus.entidades, chunks, criteria, cache)
    seen = search.search(engine.Request(["cargo"], [1.0, 0.0], modo=mode))
    assert {r.tipo_documento for r in seen.resultados.collect()} == {"Decreto"} and seen.auditoria is None
    cleared = search.search(engine.Request(["cargo"], [1.0, 0.0], modo=mode, perfil="com_clearance"))
    rows = cleared.resultados.collect()
    assert {r.tipo_documento for r in rows} == {"Decreto", "Portaria"} and any("123.456.789-09" in r.texto for r in rows)
    assert all(len(r.avaliacoes) == 4 for r in rows) and cleared.auditoria.count() >= 1
    secret = corpus.documentos.filter("nivel_restricao = 'sigiloso'").first().documento_id
    assert search.documento_completo(secret, "sem_clearance")[0] == "proibido" and search.documento_completo("?", "x")[0] == "ausente"
    assert search.documento_completo(secret, "com_clearance")[1].count() == 1


def engine_of(spark, embed=None):
    """Documents that call two numbers [CPF_A], and one without any; d is boilerplate, e of another place."""
    docs = spark.createDataFrame([(x, "Niteroi" if x != "e" else "Marica", "Portaria", "sigiloso", x) for x in "abcde"], "documento_id string, municipio string, tipo_documento string, nivel_restricao string, titulo string")
    entities = spark.createDataFrame([(x, "CPF", "[CPF_A]", ("2" if x == "b" else "1") + "23.456.789-09") for x in "abde"], "documento_id string, categoria string, pseudonimo string, valor string")
    texts = {"a": "servidora inscrita sob [CPF_A] nomeada", "b": "contrato firmado por [CPF_A] ontem", "c": "contrato firmado ontem na sede", "d": "formulario de [CPF_A]", "e": "outro lugar de [CPF_A]"}
    chunks = spark.createDataFrame([(f"{9 - i}{x}", x, i, t, x == "d", [1.0, float(i)] if x != "b" else [-1.0, 0.0]) for i, (x, t) in enumerate(texts.items())], "chunk_id string, documento_id string, indice int, texto string, eh_padronizado boolean, embedding array<double>")
    criteria = spark.createDataFrame(rules.CRITERIA, "criterio_id int, criterio_chave string, criterio_versao int, ativo boolean")
    cache = spark.createDataFrame([], "chunk_id string, criterio_id int, criterio_versao int, atende boolean, score decimal(4,3), trecho_citado string, citacao_verificada boolean")
    return engine.SearchEngine(docs, entities, chunks, criteria, cache, embed)


def found(search, consulta, **options):
    rows = search.search(engine.Request([], [1.0, 0.0], consulta, perfil="com_clearance", avaliar=False, municipio="Niteroi", **options)).resultados.collect()
    return [r.documento_id for r in rows]


@pytest.mark.parametrize("mode", ["lexico", "vetorial", "hibrido"])
def test_search_for_a_masked_value(spark, mode):
    search = engine_of(spark)
    assert found(search, "quem e 223.456.789-09", modo=mode, limite=1) == ["b"]
    assert found(search, "quem e 123.456.789-09", modo=mode, limite=1) == ["a"]
    assert {"a", "b"} <= set(found(search, "quem e 223.456.789-09", modo=mode)) <= {"a", "b", "c"}


def test_search_embeds_the_pseudonyms(spark):
    asked = []
    found(engine_of(spark, lambda text: asked.append(text) or [1.0, 0.0]), "quem e 223.456.789-09", modo="vetorial")
    assert asked == ["quem e 223.456.789-09 [CPF_A]"]


def test_search_grammar(spark):
    search = engine_of(spark)
    assert sorted(found(search, "contrato ontem", modo="lexico")) == ["b", "c"]
    assert found(search, "contrato sede", modo="lexico") == ["c"] and found(search, "contrato -sede", modo="lexico") == ["b"]
    assert found(search, '"por cpf"', modo="lexico") == ["b"] and found(search, '"ontem por"', modo="lexico") == []
    assert sorted(found(search, "sede or nomeada", modo="lexico")) == ["a", "c"] and found(search, "-contrato", modo="lexico") == ["a"]


def test_cases(spark):
    cases = spark.createDataFrame([(i, f"caso {i}") for i in range(10)], "id int, nome string")
    with pytest.raises(ValueError):
        engine.new_case(cases, cases.limit(1))
    hit, renamed = engine.rename_case(cases, 3, "  ")
    assert hit == 1 and renamed.filter("id = 3").first().nome == "Novo caso"
    thumbs = spark.createDataFrame([(1, "x", True, 1), (1, "y", True, 1)], "caso_id int, chunk_id string, relevante boolean, criado_em int")
    new = spark.createDataFrame([(1, "x", None, 2)], thumbs.schema)
    assert [r.chunk_id for r in engine.judge_relevance(thumbs, new).collect()] == ["y"]


def test_whole_document_is_unmasked_and_audited(spark):
    search = engine_of(spark)
    status, text, audit = search.documento_completo("b", "com_clearance")
    assert status == "ok" and [(r.texto, r.num_chunks) for r in text.collect()] == [("contrato firmado por 223.456.789-09 ontem", 1)]
    assert [(r.documento_id, r.pseudonimo) for r in audit.collect()] == [("b", "[CPF_A]")]


def test_judge_runs_once(spark, tmp_path):
    """The evaluations to store are those that were shown, and the judge is not asked again for them."""
    calls = spark.sparkContext.accumulator(0)

    def judge(misses):
        def body(parts):
            for part in parts:
                calls.add(len(part))
                yield part.assign(atende=True, score=0.5, justificativa="", trecho_citado="")

        return misses.mapInPandas(body, "chunk_id string, texto string, criterio_id int, criterio_chave string, criterio_versao int, atende boolean, score double, justificativa string, trecho_citado string")

    search = engine_of(spark)
    search.judge = judge
    answer = search.search(engine.Request([], [1.0, 0.0], "contrato", modo="lexico", perfil="com_clearance"))
    shown, fresh = answer.resultados.collect(), answer.novas_avaliacoes.collect()
    assert len(shown) == 2 and len(fresh) == 8 and calls.value == 8


def test_hashed_vectors_lead_to_the_text(spark):
    from quillspark.operators import embedding

    search = engine_of(spark)
    search.chunks = embedding.with_embedding(search.chunks.drop("embedding"), "texto")
    rows = search.search(engine.Request([], [], "contrato firmado ontem na sede", modo="vetorial", limite=1, perfil="com_clearance", avaliar=False)).resultados.collect()
    assert [r.documento_id for r in rows] == ["c"]
    one, two = embedding.hashed(["a b b", ""])
    assert abs((one * one).sum() - 1) < 1e-9 and not two.any()


def test_hooks_of_ingestion(spark):
    body = "Portaria que nomeia Maria Souza para o cargo, e Maria Souza Lima como suplente, com efeitos a partir de hoje. " * 4
    pages = spark.createDataFrame([("a.pdf", 1, body, "", []), ("b.pdf", 1, body.replace("hoje", "amanha"), "", [])], "arquivo_local string, pagina int, native string, ocr string, tables array<string>")
    manifest = spark.createDataFrame([(f"{x}.pdf", "Niteroi", "2026-07-18") for x in "ab"], "arquivo_local string, municipio string, data string")
    tagger = lambda rows: rows.withColumn("nomes", F.array(F.lit("Maria Souza"), F.lit("Maria Souza Lima"), F.lit("Ninguem")))
    describe = lambda rows: rows.select("documento_id", F.when(F.contains("inicio", F.lit("hoje")), "Nomeacao").otherwise(" ").alias("titulo"), F.lit("s").alias("sintese"))
    made = ingest.ingest(pages, manifest, tagger=tagger, describe=describe, versions={"nativo": "nativo-2"})
    assert {r.titulo for r in made.documentos.collect()} == {"Nomeacao", "Niteroi · Portaria · 18/07/2026"}
    chunks = made.chunks.collect()
    assert all("Maria" not in r.texto and r.metodo_extracao_versao == "nativo-2" for r in chunks)
    assert {(r.pseudonimo, r.valor) for r in made.entidades.collect()} == {("[PESSOA_A]", "Maria Souza Lima"), ("[PESSOA_B]", "Maria Souza")}


def test_dossier_and_listings(spark):
    items = spark.createDataFrame([(1, "x", None, 1), (1, "y", None, 2), (2, "x", None, 3)], "caso_id int, chunk_id string, nota string, criado_em int")
    row = spark.createDataFrame([(1, "x", None, 9)], items.schema)
    there, same = engine.add_item(items, row)
    assert there and same.count() == 3
    new, more = engine.add_item(items, spark.createDataFrame([(2, "y", None, 9)], items.schema))
    assert not new and more.count() == 4
    assert {(r.caso_id, r.chunk_id) for r in engine.remove_item(items, 1, "x").collect()} == {(1, "y"), (2, "x")}
    hit, noted = engine.annotate_item(items, 1, "y", "lido")
    assert hit == 1 and [r.chunk_id for r in noted.filter("nota = 'lido'").collect()] == ["y"] and engine.annotate_item(items, 9, "y", "")[0] == 0
    docs = spark.createDataFrame([("d1", "a.pdf", "Niteroi", "Portaria", "2026-01-02"), ("d2", "b.pdf", "Marica", "Edital", None), ("d3", "c.pdf", "Niteroi", "Edital", "2026-01-03")], "documento_id string, arquivo_local string, municipio string, tipo_documento string, data string")
    held = spark.createDataFrame([("x.pdf", "texto_vazio"), ("y.pdf", "texto_vazio"), ("z.pdf", "outro")], "arquivo_local string, tipo_erro string")
    done, undone = engine.acervo(docs, held)
    assert [r.documento_id for r in done.collect()] == ["d3", "d1", "d2"] and undone.count() == 3
    assert [r.documento_id for r in engine.acervo(docs, held, q="NITE", tipo="Edital")[0].collect()] == ["d3"]
    assert [(r.tipo_erro, r.total, r.total_ok, r.percentual) for r in engine.quarantine_stats(docs, held).collect()] == [("texto_vazio", 2, 3, 50.0), ("outro", 1, 3, 50.0)]


def test_catalogue_source(spark):
    """Pages of a catalogue served on this machine."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    from quillspark.session import ship_code
    from quillspark.sources.catalogue import CatalogueSource

    held = {"1": 5, "2": 0}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            rows = [{"territory_id": q["territory_ids"], "territory_name": "Niteroi", "date": f"2026-01-{9 - i:02}", "edition": i, "url": f"u{i}"} for i in range(held[q["territory_ids"]])]
            at = int(q["offset"])
            body = json.dumps({"gazettes": rows[at : at + int(q["size"])]} if rows else {}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ship_code(spark)
    spark.dataSource.register(CatalogueSource)
    rows = spark.read.format("catalogue").option("url", f"http://127.0.0.1:{server.server_port}/gazettes").option("territory_ids", "1, 2").option("size", "2").load().collect()
    server.shutdown()
    assert [(r.territory_id, r.edicao, r.url_origem) for r in sorted(rows, key=lambda r: r.edicao)] == [("1", str(i), f"u{i}") for i in range(5)]


def test_search_with_a_stored_index(spark, tmp_path):
    plain, indexed = engine_of(spark), engine_of(spark)
    indexed.index = TextIndex(spark, f"file://{tmp_path}/index", key_type="string", buckets=4)
    indexed.index.append(indexed.chunks, "chunk_id", "texto")
    for consulta in ("contrato", "firmado -sede", '"firmado por"', "123.456.789-09 servidora", "nada"):
        for options in ({"modo": "lexico"}, {"modo": "hibrido"}, {"modo": "lexico", "incluir_padronizados": True}):
            assert sorted(found(indexed, consulta, **options)) == sorted(found(plain, consulta, **options)), (consulta, options)


def test_harness_measures_each_search(spark):
    questions = [harness.Question("contrato ontem", "semantico", ("b", "c")), harness.Question("formulario", "exato", ("d", "zz")), harness.Question("nomeada", "exato", ("a",))]
    began = time.perf_counter()
    rows = harness.measure(spark, engine_of(spark), questions, ("lexico", "hibrido")).collect()
    spent = time.perf_counter() - began
    by = {(r.modo, r.pergunta): r for r in rows}
    assert len(by) == 6 and all(r.latencia > 0 for r in rows) and sum(r.latencia for r in rows) < spent
    assert by["lexico", "contrato ontem"].recall == 1.0 and by["lexico", "contrato ontem"].precision == 1.0
    assert by["lexico", "formulario"].recall == 0.0 and by["lexico", "nomeada"].precision == 1.0
    modes, kinds = harness.report(spark.createDataFrame(rows))
    assert {r.modo: r.perguntas for r in modes.collect()} == {"lexico": 3, "hibrido": 3} and kinds.count() == 4


def test_citations_without_a_broadcast(spark):
    sf = "/root/testdata/sf0.001"
    assert sorted(catalogue._cited(spark, sf, most=0).collect()) == sorted(catalogue._cited(spark, sf).collect())


def test_act_words_are_counted_where_they_overlap_and_alone(spark, tmp_path):
    """Words that share letters count each, as in the SQL, and act words of the texts themselves count as nothing."""
    texts = ["erthe the", "erthand erth", "erthing", "decreto aviso portaria", "hand decreto decreto thing", "The HAND the", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.tipo for r in catalogue.act_type_mode(spark, f"file://{tmp_path}").orderBy("doc_id").collect()]
    assert got == ["Aviso", "Edital", "Portaria", "Outro", "Portaria", "Aviso", "Aviso", "Outro"]
