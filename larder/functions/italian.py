"""Italian word stems, after the published Snowball rules for the language.

A small per-token helper: it runs inside Arrow batches, memoised per worker, on tokens Spark has
already split. The suffix lists are fixed values of the published algorithm.
"""

from __future__ import annotations

import re
from functools import lru_cache

V = "aeiouàèìòù"

PRONOUNS = (
    "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene "
    "tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene"
).split()

# Suffix groups of the standard-suffix step, each with the action taken on it.
DELETE_R2 = (
    "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì "
    "oso osi osa ose mente atrice atrici ante anti"
).split()
AZIONE = "azione azioni atore atori".split()
LOGIA = "logia logie".split()
UZIONE = "uzione uzioni usione usioni".split()
ENZA = "enza enze".split()
AMENTO = "amento amenti imento imenti".split()
IVO = "ivo ivi iva ive".split()
STANDARD = {
    **dict.fromkeys(DELETE_R2, "delete"),
    **dict.fromkeys(AZIONE, "azione"),
    **dict.fromkeys(LOGIA, "logia"),
    **dict.fromkeys(UZIONE, "uzione"),
    **dict.fromkeys(ENZA, "enza"),
    **dict.fromkeys(AMENTO, "amento"),
    "amente": "amente",
    "ità": "ita",
    **dict.fromkeys(IVO, "ivo"),
}

VERB = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo "
    "enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò "
    "erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero "
    "irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti "
    "ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
).split()


def _longest(words):
    return re.compile("(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")$")


_PRONOUN = re.compile(r"(ando|endo|ar|er|ir)(" + "|".join(sorted(PRONOUNS, key=len, reverse=True)) + ")$")
_PRONOUN_ANY, _STANDARD, _VERB = _longest(PRONOUNS), _longest(STANDARD), _longest(VERB)
_REGION = re.compile(f"[{V}][^{V}]")
_ACUTE = str.maketrans("áéíóú", "àèìòù")


def _regions(w: str) -> tuple[int, int, int]:
    """Start offsets of RV, R1 and R2."""
    n = len(w)
    rv = n
    if n > 2:
        if w[1] not in V:
            m = re.compile(f"[{V}]").search(w, 2)
            rv = m.end() if m else n
        elif w[0] in V:
            m = re.compile(f"[^{V}]").search(w, 2)
            rv = m.end() if m else n
        else:
            rv = 3
    m = _REGION.search(w)
    r1 = m.end() if m else n
    m = _REGION.search(w, r1)
    return rv, r1, m.end() if m else n


def _standard_suffix(w: str, rv: int, r1: int, r2: int) -> str:
    m = _STANDARD.search(w)
    if not m:
        return w
    at, kind = m.start(), STANDARD[m.group()]
    region = {"amente": r1, "amento": rv}.get(kind, r2)
    if at < region:
        return w
    stem = w[:at]
    if kind in ("logia", "uzione", "enza"):
        return stem + {"logia": "log", "uzione": "u", "enza": "ente"}[kind]

    def drop(s: str, *ends: str) -> str:
        return next((s[: -len(e)] for e in ends if s.endswith(e) and len(s) - len(e) >= r2), s)

    if kind == "azione":
        return drop(stem, "ic")
    if kind == "amente":
        shorter = drop(stem, "iv")
        return drop(shorter, "at") if shorter != stem else drop(stem, "abil", "os", "ic")
    if kind == "ita":
        return drop(stem, "abil", "ic", "iv")
    if kind == "ivo":
        shorter = drop(stem, "at")
        return drop(shorter, "ic") if shorter != stem else stem
    return stem


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word.translate(_ACUTE)
    w = w.replace("qu", "qU")
    w = re.sub(f"(?<=[{V}])([ui])(?=[{V}])", lambda m: {"u": "U", "i": "I"}[m.group()], w)
    rv, r1, r2 = _regions(w)

    m = _PRONOUN_ANY.search(w)
    attached = _PRONOUN.search(w) if m else None
    if attached and attached.group(2) == m.group() and attached.start() >= rv:
        w = w[: attached.start(2)] if len(attached.group(1)) == 4 else w[: attached.start(2)] + "e"

    shorter = _standard_suffix(w, rv, r1, r2)
    if shorter == w:
        m = _VERB.search(w, min(rv, len(w)))
        shorter = w[: m.start()] if m else w
    w = shorter

    if len(w) > rv and w[-1] in "aeioàèìò":
        w = w[:-1]
        if len(w) > rv and w[-1] == "i":
            w = w[:-1]
    if w[-2:] in ("ch", "gh") and len(w) - 2 >= rv:
        w = w[:-1]
    return w.replace("U", "u").replace("I", "i")
