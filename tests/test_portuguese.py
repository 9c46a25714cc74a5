"""The stemmer against outputs of its published vocabulary."""

from quillspark.functions import portuguese as P

PUBLISHED = """
boa boa boainain boainain boas boas boassu boassu boataria boat boate boat boates boat boatos boat bob bob boba bob bobagem bobag bobagens bobagens bobalhões bobalhõ bobear bob bobeira bobeir
bobinho bobinh bobinhos bobinh bobo bob bobs bobs boca boc bocadas boc bocadinho bocadinh bocado boc bocaiúva bocaiúv boçal boçal bocarra bocarr bocas boc bode bod bodoque bodoqu body body
boeing boeing boem boem boemia boem boêmio boêmi boêmios boêmi bogotá bogot boi boi bóia bói boiando boi quiabo quiab quicaram quic quickly quickly quieto quiet quietos quiet quilate quilat
quilates quilat quilinhos quilinh quilo quil quilombo quilomb quilométricas quilométr quilométricos quilométr quilômetro quilômetr quilômetros quilômetr quilos quil quimica quimic quimicas
quimic quimico quimic quimicos quimic quimioterapia quimioterap quimioterápicos quimioteráp quimono quimon quincas quinc quinhão quinhã quinhentos quinhent quinn quinn quino quin quinta quint
quintal quintal quintana quintan quintanilha quintanilh quintão quintã quintessência quintessent quintino quintin quinto quint quintos quint quintuplicou quintuplic quinze quinz quinzena
quinzen quiosque quiosqu
""".split()


def test_published_outputs():
    wrong = [(w, P.stem(w), want) for w, want in zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True) if P.stem(w) != want]
    assert wrong == []


def test_inflected_forms_meet():
    for forms in ("decreto decretos decretar decretado decretada", "felizmente feliz", "portaria portarias", "contrato contratos contratado contratados contratar"):
        assert len({P.stem(w) for w in forms.split()}) == 1, forms
    assert P.analyse(["não", "decretos", "", "a"]) == [None, "decret", "", None]
    assert len(P.STOP_WORDS) == 203 and len(P.transducer()) < 300


def test_short_and_odd_words():
    assert [P.stem(w) for w in ("", "a", "ão", "é", "xyz", "123", "ç", "ação")] == ["", "a", "ão", "é", "xyz", "123", "c", "açã"]
