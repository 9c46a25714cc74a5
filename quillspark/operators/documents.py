"""Document processing: cascade, quarantine, headers, chunks, boilerplate, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import rules
from quillspark.functions.text import chunk_hash, form_like, good_page, header_key, let, strip


def extraction_cascade(pages: DataFrame, native: str = "native", ocr: str = "ocr", tables: str = "tables") -> DataFrame:
    """Native text if good, else OCR if good, else what there is, marked as of low confidence."""
    use_native, use_ocr = good_page(F.col(native)), good_page(F.col(ocr))
    rest = F.coalesce(F.nullif(ocr, F.lit("")), F.nullif(native, F.lit("")), F.lit(""))
    body = F.when(use_native, F.col(native)).when(use_ocr, F.col(ocr)).otherwise(rest)
    extra = F.when(F.size(tables) > 0, F.concat(F.lit(rules.TABLE_MARK), F.array_join(tables, rules.TABLE_MARK))).otherwise("")
    return pages.withColumns({
        "texto": F.concat(body, extra),
        "metodo": F.when(use_native, "nativo").when(use_ocr, "ocr").otherwise("ocr_baixa_confianca"),
        "colunas": F.when(use_native, F.col("colunas")) if "colunas" in pages.columns else F.lit(None).cast("int"),
    })


def quarantine(chars: Column, low_share: Column) -> Column:
    """Error class of a document by its characters and share of low-confidence pages; null if fine."""
    return F.when(chars.isNull() | (chars < rules.EMPTY_BELOW), "texto_vazio").when(chars < rules.SHORT_BELOW, "texto_insuficiente").when(low_share >= rules.LOW_CONFIDENCE_SHARE, "falha_ocr")


def quarantine_documents(pages: DataFrame, key: str) -> DataFrame:
    low = (F.col("metodo") == "ocr_baixa_confianca").cast("double")
    sums = pages.groupBy(key).agg(F.sum(F.length("texto")).alias("chars"), F.avg(low).alias("low_share"))
    return sums.select(key, quarantine(F.col("chars"), F.col("low_share")).alias("tipo_erro"))


def main_method(pages: DataFrame, key: str) -> DataFrame:
    """Most frequent extraction method of a document; ties by name."""
    return pages.groupBy(key, "metodo").agg(F.count("*").alias("n")).groupBy(key).agg(F.max_by("metodo", F.struct("n", "metodo")).alias("metodo"))


def _edges(text: Column, depth: int) -> Column:
    """array<struct<at, lado, linha>>: places and keys of the first and last non-blank lines of a page; no line is both."""
    lines = F.transform(F.split(text, "\n", -1), lambda l, i: F.struct(i.alias("at"), header_key(l).alias("linha"), (strip(l) != "").alias("full")))
    side = lambda some, name: F.transform(some, lambda l: F.struct(l["at"].alias("at"), F.lit(name).alias("lado"), l["linha"].alias("linha")))
    return let(F.filter(lines, lambda l: l["full"]), lambda ls: F.concat(
        side(F.slice(ls, 1, depth), "cabecalho"), side(F.slice(F.reverse(F.slice(ls, depth + 1, 1 << 30)), 1, depth), "rodape")))


def repeated_edges(pages: DataFrame, key: str, page: str, text: str, depth: int = 1) -> DataFrame:
    """(key, lado, linha): header keys (of first lines) and footer keys (of last ones) on half of a document's pages, three at least."""
    edge = F.array_distinct(F.filter(F.transform(_edges(F.col(text), depth), lambda e: F.struct(e["lado"].alias("lado"), e["linha"].alias("linha"))), lambda e: e["linha"].isNotNull()))
    total = pages.groupBy(key).agg(F.count("*").alias("pages"))
    seen = pages.select(key, F.explode(edge).alias("e")).groupBy(key, "e.lado", "e.linha").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(3), F.bround(F.col("pages") * 0.5))
    return seen.join(total, key).filter((F.col("pages") >= 3) & (F.col("n") >= least)).select(key, "lado", "linha", F.col("n").alias("paginas"))


def drop_repeated_edges(pages: DataFrame, edges: DataFrame, key: str, text: str, depth: int = 1) -> DataFrame:
    """Pages without the first and last lines that repeated_edges() found; other lines stay, whatever they say."""
    found = edges.groupBy(key).agg(F.collect_set(F.struct("lado", "linha")).alias("__edges"))
    joined = pages.join(found, key, "left")
    known = lambda e: F.array_contains("__edges", F.struct(e["lado"].alias("lado"), e["linha"].alias("linha")))
    doomed = F.transform(F.filter(_edges(F.col(text), depth), lambda e: e["linha"].isNotNull() & known(e)), lambda e: e["at"])
    kept = let(doomed, lambda d: F.filter(F.split(text, "\n", -1), lambda l, i: ~F.array_contains(d, i)))
    clean = strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))
    return joined.withColumn(text, F.when(F.col("__edges").isNull(), F.col(text)).otherwise(clean)).drop("__edges")


def assemble(pages: Column) -> Column:
    """array<struct<pagina, texto>> to one text with page markers."""
    return F.array_join(F.transform(F.array_sort(pages), lambda p: F.concat(F.lit("<<PAGINA:"), p["pagina"].cast("string"), F.lit(">>"), p["texto"])), "\n\n")


def strip_markers(text: Column) -> Column:
    """struct<texto, paginas array<struct<off, pagina>>>: marker-free text and where pages begin in it."""
    numbers, parts = F.regexp_extract_all(text, F.lit(rules.PAGE_MARK), 1), F.split(text, rules.PAGE_MARK, -1)
    offsets = lambda ns, ps: F.aggregate(
        F.sequence(F.lit(0), F.size(ns) - 1),
        F.struct(F.length(F.get(ps, F.lit(0))).alias("at"), F.expr("cast(array() as array<struct<off:int,pagina:int>>)").alias("out")),
        lambda acc, i: F.struct((acc["at"] + F.length(F.get(ps, i + 1))).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("off"), F.get(ns, i).cast("int").alias("pagina")))).alias("out")),
        lambda acc: acc["out"],
    )
    none = F.expr("cast(array() as array<struct<off:int,pagina:int>>)")
    return let(numbers, lambda ns: let(parts, lambda ps: F.struct(F.array_join(ps, "").alias("texto"), F.when(F.size(ns) > 0, offsets(ns, ps)).otherwise(none).alias("paginas"))))


def page_at(pages: Column, start: Column) -> Column:
    """The last page that begins at or before ``start``; the first before all; 1 without markers."""
    before = F.filter(pages, lambda p: p["off"] <= start)
    return F.when(F.size(pages) == 0, 1).otherwise(F.coalesce(F.try_element_at(before, F.lit(-1))["pagina"], F.get(pages, F.lit(0))["pagina"]))


def pack(pieces: Column, separator: str, limit: int = rules.CHUNK_CHARS) -> Column:
    """Greedy packing of an array of strings; the overflow test counts a separator per piece, the last included."""
    gap = len(separator)
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("cur"), F.lit(False).alias("open"))

    def add(acc: Column, p: Column) -> Column:
        over = acc["open"] & (F.length(acc["cur"]) + gap + F.length(p) + gap > limit)
        return F.struct(
            F.when(over, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(over | ~acc["open"], p).otherwise(F.concat(acc["cur"], F.lit(separator), p)).alias("cur"),
            F.lit(True).alias("open"),
        )

    return F.aggregate(pieces, start, add, lambda acc: F.when(acc["open"], F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))


def packed(text: Column, paragraph: str = r"\n{2,}", limit: int = rules.CHUNK_CHARS) -> Column:
    """Paragraphs packed up to ``limit``; longer ones by sentence, else by word."""
    joiner = "\n\n" if paragraph == r"\n{2,}" else "\n"
    paragraphs = F.filter(F.split(text, paragraph, -1), lambda p: p.rlike(r"(?U)\S"))

    def broken(p: Column) -> Column:
        return let(F.split(p, rules.SENTENCE_GAP, -1), lambda s: F.when(F.size(s) > 1, pack(s, " ", limit)).otherwise(pack(F.split(p, " ", -1), " ", limit)))

    # A long paragraph ends the open group, so runs of short ones are packed between long ones.
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("cur"), F.lit(False).alias("open"))

    def add(acc: Column, p: Column) -> Column:
        long = F.length(p) > limit
        over = acc["open"] & (long | (F.length(acc["cur"]) + len(joiner) + F.length(p) + len(joiner) > limit))
        done = F.when(over, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        return F.struct(
            F.when(long, F.concat(done, broken(p))).otherwise(done).alias("done"),
            F.when(long, F.lit("")).when(over | ~acc["open"], p).otherwise(F.concat(acc["cur"], F.lit(joiner), p)).alias("cur"),
            (~long).alias("open"),
        )

    return F.aggregate(paragraphs, start, add, lambda acc: F.when(acc["open"], F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))


def chunks(text: Column, paragraph: str = r"\n{2,}", limit: int = rules.CHUNK_CHARS, least: int = rules.MIN_CHUNK_CHARS) -> Column:
    """The packed texts of ``least`` characters or more."""
    return F.filter(F.transform(packed(text, paragraph, limit), strip), lambda c: F.length(c) >= least)


def located(pieces: Column, text: Column) -> Column:
    """array<struct<texto, off>>: each piece where it is found behind the one before, or there if it is not."""
    start = F.struct(F.lit(0).alias("cursor"), F.expr("cast(array() as array<struct<texto:string,off:int>>)").alias("out"))

    def add(acc: Column, piece: Column) -> Column:
        at = F.call_function("locate", piece, text, acc["cursor"] + 1) - 1
        return let(F.when(at >= 0, at).otherwise(acc["cursor"]), lambda off: F.struct(
            (off + F.length(piece)).alias("cursor"), F.concat(acc["out"], F.array(F.struct(piece.alias("texto"), off.alias("off")))).alias("out")))

    return F.aggregate(pieces, start, add, lambda acc: acc["out"])


def chunk_table(docs: DataFrame, key: str = "doc_id", text: str = "text", paragraph: str = r"\n{2,}", methods: str | None = None, versions: dict[str, str] | None = None) -> DataFrame:
    """(key, indice, texto, offset_inicio, offset_fim, pagina, metodo_extracao, metodo_extracao_versao): chunks with their lineage.

    ``methods`` names a column map<pagina, metodo>; a method without a version is its own.
    """
    by_page = F.col(methods) if methods else F.lit(None).cast("map<int,string>")
    plain = docs.select(key, by_page.alias("methods"), strip_markers(F.col(text)).alias("t"))
    pieces = F.filter(F.transform(packed(F.col("t.texto"), paragraph), strip), lambda p: p != "")
    long = F.filter(located(pieces, F.col("t.texto")), lambda c: F.length(c["texto"]) >= rules.MIN_CHUNK_CHARS)
    out = plain.select(key, "methods", "t.paginas", F.posexplode(long).alias("indice", "c"))
    out = out.select(key, "methods", "indice", "c.texto", F.col("c.off").alias("offset_inicio"), (F.col("c.off") + F.length("c.texto")).alias("offset_fim"), page_at(F.col("paginas"), F.col("c.off")).alias("pagina"))
    version = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (versions or {}).items() for x in kv]), F.col("metodo_extracao")), F.col("metodo_extracao")) if versions else F.col("metodo_extracao")
    return out.withColumn("metodo_extracao", F.coalesce(F.try_element_at("methods", F.col("pagina")), F.lit("nativo"))).withColumn("metodo_extracao_versao", version).drop("methods")


def mark_boilerplate(chunked: DataFrame, key: str, text: str, least: int = rules.BOILERPLATE_DOCS) -> DataFrame:
    """Flag chunks whose normalised text stands in ``least`` documents, or that read as a blank form."""
    hashed = chunked.withColumn("hash_normalizado", chunk_hash(F.col(text)))
    common = hashed.groupBy("hash_normalizado").agg(F.count_distinct(key).alias("docs")).filter(F.col("docs") >= least).select("hash_normalizado", F.lit(True).alias("__common"))
    return hashed.join(common, "hash_normalizado", "left").withColumn("eh_padronizado", F.coalesce("__common", F.lit(False)) | form_like(F.col(text))).drop("__common")


def whole_text(parts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """A document's parts in order, joined by blank lines."""
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda p: p[text]), "\n\n").alias("texto"))


def column_gap(words: DataFrame, key: str, width: str = "largura") -> DataFrame:
    """(key, corte): the column gap of pages that have two columns.

    Words have x0 and x1. The widest gap between neighbouring centres counts if
    its middle lies in 30-70 % of the width, it is 4 % wide, and 15 of 30 words
    stand on either side; of equal gaps the leftmost one.
    """
    centre = words.select(key, width, ((F.col("x0") + F.col("x1")) / 2).alias("c"))
    order = Window.partitionBy(key).orderBy("c")
    gaps = centre.withColumns({"prev": F.lag("c").over(order), "left": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy(key))})
    gaps = gaps.withColumns({"gap": F.col("c") - F.col("prev"), "mid": (F.col("c") + F.col("prev")) / 2})
    fit = gaps.filter((F.col("n") >= 30) & F.col("mid").between(0.3 * F.col(width), 0.7 * F.col(width)) & (F.col("gap") >= 0.04 * F.col(width)))
    best = fit.groupBy(key).agg(F.max_by(F.struct("mid", "left", "n"), F.struct(F.col("gap"), -F.col("mid"))).alias("b"))
    return best.filter((F.col("b.left") >= 15) & (F.col("b.n") - F.col("b.left") >= 15)).select(key, F.col("b.mid").alias("corte"))


def column_lines(words: DataFrame, key: str) -> DataFrame:
    """(key, linha, texto): words of a column grouped into lines by nearness to the word before."""
    order = Window.partitionBy(key).orderBy("top", "x0")
    height = F.avg(F.col("bottom") - F.col("top")).over(Window.partitionBy(key))
    tolerance = F.when(height == 0, 1.0).otherwise(0.6 * height)
    new = F.coalesce((F.abs(F.col("top") - F.lag("top").over(order)) > tolerance).cast("int"), F.lit(1))
    lined = words.withColumn("__new", new).withColumn("linha", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return lined.groupBy(key, "linha").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("texto"))


def column_text(words: DataFrame, key: str, width: str = "largura") -> DataFrame:
    """(key, colunas, texto): words put back into lines; where a page has two columns the left one comes first, then a blank line."""
    cut = column_gap(words, key, width)
    placed = words.join(cut, key, "left").withColumn("coluna", F.coalesce(((F.col("x0") + F.col("x1")) / 2 >= F.col("corte")).cast("int"), F.lit(0)))
    lines = column_lines(placed.withColumn("__page", F.struct(key, "coluna")), "__page").select(f"__page.{key}", "__page.coluna", "linha", "texto")
    joined = lambda p: F.array_join(F.transform(F.array_sort(p), lambda l: l["texto"]), "\n")
    columns = lines.groupBy(key, "coluna").agg(joined(F.collect_list(F.struct("linha", "texto"))).alias("texto"))
    return columns.groupBy(key).agg((F.max("coluna") + 1).alias("colunas"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("coluna", "texto"))), lambda c: c["texto"]), "\n\n").alias("texto"))
