"""The name tagger against a search of every name at every word."""

import random
import re

from pyspark.sql import functions as F

from quillspark.operators import gazetteer as G
from quillspark.plans.ingest import ingest, save
from quillspark.sources.snapshots import SnapshotStore

NAMES = ["Ana Lima", "ana lima SOUZA", "Lima Souza", "João de Deus", "Deus João", "só", "", None, "Ana Ana", "Zé 3 Lima", "Ana-Lima"]


def brute(text, names):
    words = list(G.WORD.finditer(text))
    out = []
    for name in {tuple(w.lower() for w in G.WORD.findall(n or "")) for n in names}:
        for i in range(len(words) - len(name) + 1):
            part = words[i : i + len(name)]
            if len(name) > 1 and tuple(w.group().lower() for w in part) == name and all(text[a.end() : b.start()].isspace() for a, b in zip(part, part[1:], strict=False)):
                out.append((part[0].start(), part[-1].end()))
    return sorted(out)


def test_automaton():
    rng = random.Random(1)
    automaton = G.Automaton([n for n in NAMES if n])
    for _ in range(400):
        text = "".join(rng.choice(["Ana", "LIMA", "lima", "Souza", "João", "de", "Deus", "Zé", "x"]) + rng.choice([" ", " ", "\n", "  ", ", ", "-", "3 "]) for _ in range(rng.randrange(25)))
        assert sorted(automaton.spans(text)) == brute(text, NAMES), text


def test_tagger(spark):
    rng = random.Random(2)
    texts = [(str(i), " ".join(rng.choice(["Ana", "Lima", "Souza", "João", "de", "Deus", "🎉", "fim."]) for _ in range(30))) for i in range(60)] + [("n", None), ("e", ""), ("l", "Ana Lima " * 5000)]
    docs = spark.createDataFrame(texts, "hash_sha256 string, text string").repartition(4)
    names = spark.createDataFrame([(n,) for n in NAMES], "valor string")
    got = {r.hash_sha256: r.nomes for r in G.tagger(names)(docs).collect()}
    for key, text in texts:
        want = list(dict.fromkeys(text[a:b] for a, b in G.leftmost_longest(brute(text, NAMES)))) if text and key != "l" else ["Ana Lima"] if text else []
        assert got.get(key, []) == want, key


def test_waves(spark, monkeypatch):
    monkeypatch.setattr(G, "WAVE", 2)
    docs = spark.createDataFrame([("a", "Ana Lima Souza e João de Deus")], "k string, text string")
    names = spark.createDataFrame([(n,) for n in NAMES], "valor string")
    (row,) = G.name_spans(docs, names, "k").collect()
    assert sorted((s.start, s.stop) for s in row.spans) == brute("Ana Lima Souza e João de Deus", NAMES)


def test_ingested_names_and_saved_tables(spark, tmp_path):
    body = "a servidora {} foi designada para o cargo de analista, e o processo segue conforme as normas vigentes do municipio. " * 4
    pages = spark.createDataFrame([("a", 1, body.replace("{}", "MARIA SOUZA"), "", []), ("b", 1, body.replace("{}", "Maria Souza") + "visto por Carlos  Prado.", "", [])], "arquivo_local string, pagina int, native string, ocr string, tables array<string>")
    manifest = spark.createDataFrame([(k, "Niteroi", "2026-07-18") for k in "ab"], "arquivo_local string, municipio string, data string")
    known = spark.createDataFrame([("CARLOS PRADO",)], "valor string")
    seen = []

    def describe(docs):
        rows = docs.collect()
        seen.extend(r.documento_id for r in rows)
        return spark.createDataFrame([(r.documento_id, "T " + r.documento_id, "s") for r in rows], "documento_id string, titulo string, sintese string")

    made = ingest(pages, manifest, describe=describe, known_names=known)
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    assert save(made, store) == 1
    assert len(seen) == 2  # each document is described once
    values = {r.valor for r in store.read("entidades").collect()}
    assert values == {"MARIA SOUZA", "Maria Souza", "Carlos Prado"}
    assert store.read("chunks").filter(F.lower("texto").rlike("maria souza|carlos")).count() == 0
    save(ingest(pages, manifest, known_names=known), store)  # a second run adds nothing
    assert store.read("documentos").count() == 2 and store.read("entidades").count() == 3
    assert re.fullmatch("T .*", store.read("documentos").first().titulo)
