"""Scalar text functions: Column in, Column out, all inside code generation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import rules

#: White space as Python's strip() and \s see it; Java's \s is ASCII only without (?U).
SPACE = r"(?U)\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sql_string(value: str) -> str:
    """A text as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_double(value: float) -> str:
    """A double as an SQL literal of the same value."""
    return f"{float(value)!r}D".upper() if abs(value) < float("inf") else f"double('{value}')"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """All white space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def light_normalise(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[ \t]+", " "))


def join_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, rules.BROKEN_HYPHEN, "")


def mark_fields(text: Column) -> Column:
    return F.regexp_replace(text, rules.BLANK_FIELD, rules.FIELD_MARK)


def collapse_breaks(text: Column) -> Column:
    """Three or more newlines to two; a lone newline to a space."""
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?<!\n)\n(?!\n)", " ")


def collapse_spaces(text: Column) -> Column:
    lines = F.split(F.regexp_replace(text, r"[ \t]+", " "), "\n", -1)
    return strip(F.array_join(F.transform(lines, strip), "\n"))


def normalise_page(text: Column) -> Column:
    return collapse_spaces(collapse_breaks(mark_fields(join_hyphens(text))))


def header_key(line: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.lower(strip(line)), r"\d+", "#"), SPACE, " ")
    return F.when(F.length(key) >= 6, key)


def letter_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(F.length(text), F.lit(1))


def good_page(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (F.length(strip(t)) >= rules.MIN_PAGE_CHARS) & (letter_ratio(t) >= rules.MIN_LETTER_RATIO)


def chunk_hash(text: Column) -> Column:
    generic = F.regexp_replace(text, rules.PLACEHOLDER, "[X]")
    return F.sha2(F.lower(squeeze(generic)), 256)


def form_like(text: Column) -> Column:
    marks = F.regexp_count(text, F.lit(r"\[CAMPO\]"))
    useful = F.size(F.filter(F.split(F.replace(text, F.lit(rules.FIELD_MARK), F.lit("")), SPACE, -1), lambda w: w != ""))
    return (marks >= rules.FORM_FIELDS) & (marks / F.greatest(useful, F.lit(1)) > rules.FORM_DENSITY)


def letters(n: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, as spreadsheets count: the digits of base 26 without a zero, last one first."""
    start = F.struct(n.cast("long").alias("rest"), F.lit("").alias("out"))

    def digit(acc: Column, _: Column) -> Column:
        one = F.pmod(acc["rest"], F.lit(26))
        more = F.struct((F.call_function("div", acc["rest"], F.lit(26)) - 1).alias("rest"), F.concat(F.char(one + 65), acc["out"]).alias("out"))
        return F.when(acc["rest"] >= 0, more).otherwise(acc)

    # 14 letters name every long; a number of few letters is soon done with.
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, digit, lambda acc: acc["out"])


def person_like(name: Column) -> Column:
    """Two real words at least, none of an institution, none of one letter."""
    real = F.filter(F.split(squeeze(name), " "), lambda t: ~t.isin(rules.CONNECTORS))
    return let(real, lambda r: (F.size(r) >= 2) & ~F.exists(r, lambda t: t.isin(rules.INSTITUTIONS)) & F.forall(r, lambda t: F.length(t) >= 2))


def _plain_letters() -> tuple[str, str, list[tuple[str, str]]]:
    """By decomposition: characters that become one ASCII character, those characters, and (character, its ASCII signs) of several."""
    one, to, more = [], [], []
    for c in map(chr, range(0x80, 0x10000)):
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode().lower()
        if len(plain) == 1:
            one.append(c)
            to.append(plain)
        elif plain and unicodedata.category(c)[0] == "L" and c < "\ufb07":
            more.append((c, plain))
    return "".join(one), "".join(to), [m for m in more if m[0] < "\u0250" or m[0] > "\ufaff"]


def slug(text: Column) -> Column:
    """Accents decomposed, what is not ASCII then dropped, lower case, spaces to hyphens."""
    one, to, more = _plain_letters()
    plain = F.translate(text, one, to)
    for c, ascii_ in more:
        plain = F.replace(plain, F.lit(c), F.lit(ascii_))
    return F.replace(F.lower(F.regexp_replace(plain, r"[^\x00-\x7F]", "")), F.lit(" "), F.lit("-"))


def citation_verified(text: Column, cited: Column) -> Column:
    """Nothing cited counts as verified; else the words must stand in the text."""
    return let(squeeze(F.coalesce(cited, F.lit(""))), lambda c: (c == "") | F.contains(squeeze(F.coalesce(text, F.lit(""))), c))


def act_type(text: Column, types: dict[str, str] = rules.ACT_TYPES, flags: str = "(?iu)") -> Column:
    """The most frequent of ``types`` (name: pattern), each counted over the whole text; ties by declared order; Outro if none."""
    counts = F.array(*[F.struct(F.regexp_count(text, F.lit(flags + p)).alias("n"), F.lit(-i).alias("rank"), F.lit(name).alias("name")) for i, (name, p) in enumerate(types.items())])
    return let(F.array_max(counts), lambda best: F.when(best["n"] > 0, best["name"]).otherwise("Outro"))


def readable_name(place: Column, kind: Column, date: Column) -> Column:
    return F.concat_ws(" · ", place, F.coalesce(F.nullif(kind, F.lit("")), F.lit(rules.DEFAULT_TITLE)), F.date_format(date, "dd/MM/yyyy"))


def criterion_label(key: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in rules.CRITERION_LABELS.items() for x in kv])
    title = F.array_join(F.transform(F.split(key, "_", -1), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), " ")
    return F.coalesce(F.try_element_at(known, key), title)


def result_tags(evaluations: Column, method: Column) -> Column:
    """Labels of met criteria, then that of the extraction method."""
    met = F.transform(F.filter(evaluations, lambda e: e["atende"]), lambda e: criterion_label(e["chave"]))
    labels = F.create_map(*[F.lit(x) for kv in rules.METHOD_LABELS.items() for x in kv])
    return F.concat(met, F.array_compact(F.array(F.try_element_at(labels, method))))


def score_tier(score: Column, legs: Column) -> Column:
    return F.when(score >= rules.HIGH_TIER, "Alta").when((score >= rules.MIDDLE_TIER) | (F.size(legs) >= 2), "Média").otherwise("Baixa")


def summary_line(text: Column, longest: int = 160) -> Column:
    """The first line with content, or the first line, or the text; cut with an ellipsis."""
    lines = F.filter(F.transform(F.split(text, r"\n+", -1), strip), lambda l: l != "")
    bare = lambda l: F.regexp_replace(l, SPACE, "")
    odd = lambda l: F.length(F.regexp_replace(bare(l), "[a-zA-ZÀ-ÿ0-9]", ""))
    good = lambda l: (F.length(bare(l)) >= 20) & (odd(l) <= F.length(bare(l)) * 0.4) & ~F.startswith(l, F.lit("[TABELA]"))
    clean = squeeze(let(lines, lambda ls: F.coalesce(F.get(F.filter(ls, good), F.lit(0)), F.get(ls, F.lit(0)), text)))
    return let(clean, lambda c: F.when(F.length(c) > longest, F.concat(strip(F.substring(c, 1, longest)), F.lit("…"))).otherwise(c))


def title_like(block: Column) -> Column:
    line = strip(block)
    big = F.length(F.regexp_replace(line, "[^A-ZÀ-Ü]", ""))
    all_letters = F.length(F.regexp_replace(line, "[^a-zA-ZÀ-ÿ]", ""))
    return (line != "") & (F.length(line) <= 140) & (line.rlike(rules.TITLE_PREFIX) | ((all_letters >= 6) & (big > all_letters * 0.85)))


def block_list(text: Column) -> Column:
    """array<struct<tipo, texto>>: headings set apart, then titles and paragraphs."""
    broken = F.regexp_replace(F.regexp_replace(text, rules.ACT_HEADING, "\n\n$0"), rules.ARTICLE, "\n\n$0")
    blocks = F.filter(F.transform(F.split(broken, r"\n{2,}", -1), strip), lambda b: b != "")
    return F.transform(blocks, lambda b: F.struct(F.when(title_like(b), "titulo").otherwise("paragrafo").alias("tipo"), b.alias("texto")))


def display_segments(text: Column) -> Column:
    """array<struct<protegido, texto>>: placeholders shown as protected data."""
    marks, parts = F.regexp_extract_all(text, F.lit(f"({rules.PLACEHOLDER})"), 1), F.split(text, rules.PLACEHOLDER, -1)
    return let(marks, lambda ms: let(parts, lambda ps: F.filter(
        F.flatten(F.transform(ps, lambda p, i: F.array(
            F.struct(F.lit(False).alias("protegido"), p.alias("texto")),
            F.struct((i < F.size(ms)).alias("protegido"), F.when(i < F.size(ms), "dado protegido").otherwise("").alias("texto")),
        ))), lambda s: s["texto"] != "")))


def lenient_json(raw: Column, schema: str, required: str, default: Column) -> Column:
    """Parse; else parse the widest braces; else the default struct."""
    whole, inner = F.from_json(raw, schema), F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), schema)
    return F.when(whole[required].isNotNull(), whole).when(inner[required].isNotNull(), inner).otherwise(default)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")


def has_all(words: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains(words, t) for t in terms], F.lit(True))


def query_groups(query: str) -> list[list[tuple[bool, str]]]:
    """Groups that are OR-ed, of (negated, word or phrase) that are AND-ed."""
    groups: list[list[tuple[bool, str]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query.lower()):
        if word == "or":
            groups.append([])
        else:
            groups[-1].append((bool(minus), phrase or word))
    return groups


def query_words(term: str) -> list[str]:
    """The words of one term of a query: several if it is a phrase or holds signs."""
    return [w for w in re.split(r"[^\w]+|_", term) if w]


def query_terms(query: str) -> list[str]:
    """The distinct words that a query asks for, without the negated ones."""
    return list(dict.fromkeys(w for g in query_groups(query) for negated, term in g if not negated for w in query_words(term)))


def parse_query(query: str) -> Callable[[Column, Column], Column]:
    """A predicate of (tokens, lower-cased text): words are AND, "or" is OR, -word is NOT, quotes are phrases."""
    groups = query_groups(query)

    def test(words: Column, text: Column) -> Column:
        def one(negated: bool, term: str) -> Column:
            parts = query_words(term)
            hit = has_all(words, parts) if len(parts) < 2 else F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {' '.join(parts)} "))
            return ~hit if negated else hit

        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [one(*t) for t in g], F.lit(True)) for g in groups if g], F.lit(False))

    return test
