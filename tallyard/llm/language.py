"""Which of four languages a text is in, by its function words; and which one a request asks for."""

from __future__ import annotations

import re

_SETS = {
    "en": "the of and to is that it was for with as at by this be are from which not have had has or but who what would could they she he his her their its than when then there before after more most one two you your my we our if an into how why so yes where while only because about over under than through between such any some these those i me us them him like no yes keep answer give write",
    "de": "der die das und ist nicht ein eine einen einem einer den dem des mit für auf war im am zu zum zur von sich auch als wie aber nach noch nur so dass wer was warum ob man hat haben wurde sein ich wir sie er es kein keine oft vor bei über vielleicht jede jeder jedes ja nein kann unter wird werden diese dieser dieses alle ihr ihre sein seine haben uns mir dir ihn ihm doch schon immer wieder gegen durch um bis weil wenn dann hier da",
    "es": "el la los las y es no un una que en del al por con para su sus como más pero lo se hay era sin este esta cuando donde quien qué cómo nadie ningún ninguno después entre toda todo ni fue muy sí unos unas hace años de puede ser son sobre también porque desde hasta cada otro otra tan muchos mucho le les me mi tu usted ha han había dos tres vida",
    "fr": "le la les et est pas un une que qui dans du des au aux par avec pour sur son sa ses comme plus mais ce cette se il elle ne sans quand où était fut très on en d l qu c n s j jour jours après toute tout peu quelques beaucoup oui de comment peut sous entre aussi parce depuis chaque autre tant leur leurs nous vous je me mon ma tu ont avait être sont fait deux trois vie mots reste ni puis celui ceux",
}
_OF: dict[str, list[str]] = {}
for _lang, _words in _SETS.items():
    for _w in _words.split():
        _OF.setdefault(_w, []).append(_lang)
_MARKS = {"ß": "de", "ä": "de", "ö": "de", "ü": "de", "ñ": "es", "¿": "es", "¡": "es", "á": "es", "í": "es", "ó": "es", "ú": "es", "è": "fr", "ê": "fr", "ç": "fr", "à": "fr", "ù": "fr", "œ": "fr", "î": "fr", "ô": "fr"}
_WORD = re.compile(r"[^\W\d_]+")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)

_NAMES = {
    "en": r"english|englisch\w*|ingl[eé]s|anglais", "de": r"german|deutsch\w*|alem[aá]n|allemand",
    "es": r"spanish|spanisch\w*|español|castellano|espagnol", "fr": r"french|französisch\w*|franc[eé]s|français",
}
_ASK = re.compile(r"\b(?:answer|respond|reply|write|responde|responda|contesta|escribe|antworte\w*|schreibe\w*|réponds|répondez|écris|écrivez)\b[^.!?\n]{0,40}?\b(?:in|auf|en)\s+(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _NAMES.items()) + r")\b", re.I)


def language(text: str | None, least: float = 2.0) -> str | None:
    """'en', 'de', 'es', 'fr', or None where fewer than two function words decide. Code blocks don't count."""
    if not text:
        return None
    text = _FENCE.sub(" ", text).lower()
    score = dict.fromkeys(_SETS, 0.0)
    for w in _WORD.findall(text):
        for lang in (of := _OF.get(w, ())):
            score[lang] += 1.0 / len(of)
    for ch in text:
        if lang := _MARKS.get(ch):
            score[lang] += 0.5
    order = sorted(score, key=lambda k: -score[k])
    best, second = score[order[0]], score[order[1]]
    return order[0] if best >= least and best >= 1.5 * second else None


def requested(question: str | None) -> str | None:
    """The language a request asks for by name (the last such phrase), else the one it is written in."""
    if not question:
        return None
    found = None
    for m in _ASK.finditer(question):
        found = m.lastgroup
    return found or language(question)
