"""Portuguese stemming and stop words for the lexical leg.

The stemmer follows the published Snowball description: ordered steps that strip
derivational, then verb, then residual suffixes inside the regions R1, R2 and RV.
All suffixes of all steps are compiled to one transducer over the reversed word, so
a word is read backwards once and every step takes its longest suffix from there.
It is applied to the distinct words of a window of documents (``operators.text_index``),
never to every occurrence.
"""

from __future__ import annotations

from functools import lru_cache

VOWELS = frozenset("aeiouáéíóúâêô")

# The suffixes of each step, in the order of the published description. A tilde stands after its vowel while
# a word is stemmed, so that nasal vowels count as a vowel and a consonant.
DELETE_R2 = "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split()
REPLACED_R2 = {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
IDADE = {"idade": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv")}
IVO = {"iva": ("at",), "ivo": ("at",), "ivas": ("at",), "ivos": ("at",)}
VERB = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem "
    "ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes "
    "is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos "
    "eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
).split()
RESIDUAL = "os a i o á í ó".split()
FINAL = "e é ê".split()

# The published stop words, in their order.
STOP_WORDS = frozenset(
    "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo pela até isso ela entre depois sem mesmo aos seus quem nas "
    "me esse eles você essa num nem suas meu às minha numa pelos elas qual nós lhe deles essas esses pelas este dele tu te vocês vos lhes meus minhas teu tua teus tuas nosso nossa nossos nossas dela delas "
    "esta estes estas aquele aquela aqueles aquelas isto aquilo estou está estamos estão estive esteve estivemos estiveram estava estávamos estavam estivera estivéramos esteja estejamos estejam estivesse "
    "estivéssemos estivessem estiver estivermos estiverem hei há havemos hão houve houvemos houveram houvera houvéramos haja hajamos hajam houvesse houvéssemos houvessem houver houvermos houverem houverei "
    "houverá houveremos houverão houveria houveríamos houveriam sou somos são era éramos eram fui foi fomos foram fora fôramos seja sejamos sejam fosse fôssemos fossem for formos forem serei será seremos "
    "serão seria seríamos seriam tenho tem temos tém tinha tínhamos tinham tive teve tivemos tiveram tivera tivéramos tenha tenhamos tenham tivesse tivéssemos tivessem tiver tivermos tiverem terei terá "
    "teremos terão teria teríamos teriam".split()
)


@lru_cache(1)
def transducer() -> list[tuple[dict[str, int], dict[str, str]]]:
    """States over the reversed word: (moves, {step: suffix that ends here})."""
    steps = {
        "standard": [*DELETE_R2, *REPLACED_R2, "amente", "mente", *IDADE, *IVO, "ira", "iras"],
        "verb": VERB,
        "residual": RESIDUAL,
        "final": [*FINAL, "ç"],
    }
    states: list[tuple[dict[str, int], dict[str, str]]] = [({}, {})]
    for step, suffixes in steps.items():
        for suffix in suffixes:
            state = 0
            for c in reversed(suffix):
                if c not in states[state][0]:
                    states[state][0][c] = len(states)
                    states.append(({}, {}))
                state = states[state][0][c]
            states[state][1][step] = suffix
    return states


def suffixes(word: str, step: str, start: int = 0) -> str:
    """The longest suffix of ``step`` within ``word[start:]``, or an empty string."""
    states, state, found = transducer(), 0, ""
    for c in reversed(word[start:]):
        state = states[state][0].get(c, 0)
        if not state:
            break
        found = states[state][1].get(step, found)
    return found


def _after(word: str, start: int) -> int:
    """The place behind the first consonant that follows a vowel."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _rv(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] in VOWELS), len(word))
    if word[0] in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in VOWELS), len(word))
    return 3


def _standard(word: str, r1: int, r2: int, rv: int) -> str:
    suffix = suffixes(word, "standard")
    if not suffix:
        return word
    stem = word[: len(word) - len(suffix)]

    def cut(stem: str, endings: tuple[str, ...]) -> str:
        own = max((e for e in endings if stem.endswith(e)), key=len, default="")
        return stem[: len(stem) - len(own)] if own and len(stem) - len(own) >= r2 else stem

    if suffix in ("ira", "iras"):
        return stem + "ir" if len(stem) >= rv and stem.endswith("e") else word
    if suffix == "amente":
        if len(stem) < r1:
            return word
        shorter = cut(stem, ("iv", "os", "ic", "ad"))
        return cut(shorter, ("at",)) if shorter != stem and stem.endswith("iv") else shorter
    if len(stem) < r2:
        return word
    if suffix == "mente":
        return cut(stem, ("ante", "avel", "ível"))
    return cut(stem, {**IDADE, **IVO}.get(suffix, ())) + REPLACED_R2.get(suffix, "")


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    word = word.replace("ã", "a~").replace("õ", "o~")
    r1 = _after(word, 0)
    r2, rv = _after(word, r1), _rv(word)
    out = _standard(word, r1, r2, rv)
    if out == word and (verb := suffixes(word, "verb", rv)):
        out = word[: len(word) - len(verb)]
    if out != word:
        if out.endswith("ci") and len(out) - 1 >= rv:
            out = out[:-1]
    elif (rest := suffixes(out, "residual")) and len(out) - len(rest) >= rv:
        out = out[: len(out) - len(rest)]
    last = suffixes(out, "final")
    if last == "ç":
        out = out[:-1] + "c"
    elif last and len(out) - 1 >= rv:
        out = out[:-1]
        if out.endswith(("gu", "ci")) and len(out) - 1 >= rv:
            out = out[:-1]
    return out.replace("a~", "ã").replace("o~", "õ")


def analyse(words: list[str]) -> list[str | None]:
    """Stems of words, None for stop words; the analyser of an index over Portuguese texts."""
    return [None if w in STOP_WORDS else stem(w) for w in words]
