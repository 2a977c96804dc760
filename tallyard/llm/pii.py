"""Personal information in free text: a skip-chain conditional random field over candidate spans.

Candidates are spans that could be an email address, phone number, identity number,
street address or personal name. Each is a node with a unary potential from its form
and context. Consecutive candidates of a passage share a chain potential; candidates with
equal or similar text anywhere in the document share a skip potential, so that a
number labelled once, or a name introduced once, is recognised at every mention. Loopy
message passing gives the marginals; overlapping spans are settled by them.

All weights are trained here by pseudo-likelihood on a bounded sample of documents whose
labels come from unmistakable contexts (a label before a number, a title before a name);
those contexts are dropped from half of the training rows, so that form and
neighbouring words carry weight of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.durable import materialise
from tallyard.operators.spread import spread

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
DIMENSIONS = 1 << 15

_LOCAL = r"[A-Za-z0-9À-ÿ](?:[\w.+'-]*[A-Za-z0-9À-ÿ])?"
_EMAIL = re.compile(
    rf"{_LOCAL}@[A-Za-z0-9](?:[\w-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]*[A-Za-z0-9])+"
    rf"|{_LOCAL}\s?(?:\((?:at|AT)\)|\[(?:at|AT)\]|\{{at\}})\s?[A-Za-z0-9-]+(?:(?:\.|\s?(?:\((?:dot|DOT)\)|\[(?:dot|DOT)\]|\{{dot\}})\s?)[A-Za-z0-9-]+)+"
    rf"|{_LOCAL} (?:AT|at) [A-Za-z0-9-]+(?: (?:DOT|dot) [A-Za-z0-9-]+)+"
)
_SEP = r"[ .\-–/ ‑]"
_PHONE = re.compile(
    rf"(?<![\w+.,/-])(?:(?:\+|00)[1-9]\d{{0,2}}{_SEP}?(?:\(0\){_SEP}?)?(?:\(\d{{1,5}}\){_SEP}?)?\d{{1,5}}(?:{_SEP}?\d{{2,8}}){{1,6}}"
    rf"|\(0\d{{1,5}}\){_SEP}?\d{{2,8}}(?:{_SEP}\d{{2,5}}){{0,3}}|0\d{{1,5}}{_SEP}{{1,2}}\d{{2,8}}(?:{_SEP}\d{{2,5}}){{0,4}}|0\d{{9,10}}"
    rf"|(?:1{_SEP}?)?\([2-9]\d\d\){_SEP}?\d{{3}}{_SEP}?\d{{4}}|(?:1{_SEP})?[2-9]\d\d{_SEP}\d{{3}}{_SEP}\d{{4}}|1?[2-9]\d\d[2-9]\d{{6}}|[2-9]\d\d{_SEP}\d{{4}}"
    rf"|[6789]\d\d{_SEP}\d{{3}}{_SEP}\d{{3}}|[6789]\d\d(?:{_SEP}\d\d){{3}}|[679]\d{{8}})(?![\w]|[.,/:-]\d|[ ]\d{{3}}\b)"
)
_ID = re.compile(
    r"(?<![\w.-])(?:\d{3}[- .–]\d{2}[- .–]\d{4}|\d{9}|[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]|[A-Za-z]{1,2}[ -]?\d{6,8}|\d{2}[ .]?\d{3}[ .]?\d{3}[ .]?\d{3}"
    r"|[12] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3}(?: ?\d{2})?|\d{2}\.?\d{3}\.?\d{3}[- ]?[A-Za-z]|[XYZxyz][- ]?\d{7}[- ]?[A-Za-z]|[A-Z0-9]{9,12})(?![\w]|[.,-]\d)"
)
_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_TYPE_EN = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Court|Ct|Terrace|Ter|Way|Close|Place|Pl|Square|Sq|Crescent|Cres|Row|Walk|Boulevard|Blvd|Parade|Mews|Gardens|Grove|Rise|Yard|Alley"
_TYPE_DE = "straße|strasse|str\\.|str|allee|weg|gasse|platz|ring|damm|ufer|steig|pfad|chaussee|graben|markt|berg|hof"
_TYPE_FR = "rue|avenue|av\\.|boulevard|bd|chemin|place|impasse|allée|quai|route|cours|passage|sentier|ruelle|square"
_TYPE_ES = "C/|Calle|Avenida|Avda\\.?|Av\\.|Paseo|Pº|Plaza|Pl\\.|Camino|Ronda|Travesía|Carrera|Carretera|Cuesta|Callejón"
_STREET_NUMBER_FIRST = re.compile(
    rf"(?<![\w.,-])\d{{1,5}}(?:[A-Za-z]\b)?(?:[-–/]\d{{1,4}}[A-Za-z]?)?,?[ \t]+(?:[NSEW]\.?[ \t]+)?(?:[{_UP}][\w'’-]*\.?[ \t]+){{1,4}}?(?:{_TYPE_EN}|{_TYPE_EN.upper()})\b"
    rf"|(?<![\w.,-])\d{{1,4}}[a-d]?(?:[ ]?(?:bis|ter|quater|[a-dA-D])\b)?,?[ \t]+(?i:{_TYPE_FR})[ \t]+(?:(?i:de|du|des|la|le|les|aux?|en|sur|l['’]|d['’])[ \t]*)*[{_UP}][\w'’-]*(?:[ \t]+(?:(?:de|du|des|la|le|les|aux?|en|sur|et)[ \t]+|[ld]['’])*[{_UP}][\w'’-]*)*"
)
_STREET_NAME_FIRST = re.compile(
    rf"(?<![\w-])(?:(?:[{_UP}][{_LOW}ß]+[- ]){{0,2}}[{_UP}][\w-]*?(?:{_TYPE_DE})|(?:[{_UP}][{_LOW}ß]+[- ]){{1,3}}(?:Straße|Strasse|Str\.|Allee|Weg|Gasse|Platz|Ring|Damm|Ufer|STRASSE|STR\.|ALLEE|WEG|GASSE)|(?:Am|An der|An den|Im|In der|Auf dem|Auf der|Zum|Zur|Unter den|Hinter dem)[ \t]+[{_UP}][\w-]+)[ \t]*,?[ \t]*(?:Nr\.?[ \t]*)?\d{{1,4}}(?:[ ]?[a-zA-Z]\b)?(?![\d.,]*\d)"
    rf"|(?<![\w-])(?i:{_TYPE_ES})[ \t]*(?:(?i:de|del|la|las|los|el|y)[ \t]+)*[{_UP}][\w'’-]*(?:[ \t]+(?:(?:de|del|la|las|los|el|y)[ \t]+)*[{_UP}][\w'’-]*)*,?[ \t]*(?:(?:n\.?[ ]?[º°o]\.?|núm\.?|número|No\.)[ \t]*)?\d{{1,4}}(?:[ ]?[a-zA-Z]\b)?"
)
#: Where an address with its name first or an email can be at all; the patterns run only around these.
_NAME_THEN_NUMBER = re.compile(rf"[{_UP}{_LOW}.º°][,]?[ \t]{{0,2}}\d{{1,4}}(?!\d)")
_AT = re.compile(r"@|[\[({](?:at|AT)[\])}]| AT | at (?=[\w-]+ dot )")


def _addresses(text: str) -> Iterator[re.Match]:
    """Matches of both orders; a name before its number is read from the number before it, however far back that is."""
    yield from _STREET_NUMBER_FIRST.finditer(text)
    done = before = 0
    for hit in _NAME_THEN_NUMBER.finditer(text):
        for m in _STREET_NAME_FIRST.finditer(text, max(done, min(before, hit.start() - 90), 0), min(len(text), hit.end() + 3)):
            done = m.end()
            yield m
        before = hit.end()


#: The rest of an address after its sign: a run without blanks, and what spelled-out dots add to it.
_REST = re.compile(r"\s?[^\s@]*(?:\s?[(\[{]?(?:dot|DOT)[)\]}]?\s?[^\s@]+)*")


def _emails(text: str) -> Iterator[re.Match]:
    """Matches around signs, each from the beginning of the run of characters before it to the end of the one after it, however long they are."""
    done = 0
    for hit in _AT.finditer(text):
        if hit.start() < done:
            continue
        end = hit.start()
        while end > done and text[end - 1].isspace():
            end -= 1
        start = end
        while start > done and (text[start - 1].isalnum() or text[start - 1] in "_.+'-"):
            start -= 1
        while start < end and not (text[start].isalnum() and (text[start] < "\x80" or "À" <= text[start] <= "ÿ")):
            start += 1
        m = _EMAIL.match(text, start, _REST.match(text, hit.end()).end()) if start < end else None  # type: ignore[union-attr]
        if m:
            yield m
        done = m.end() if m else end


_TITLES = set("mr mrs ms miss dr prof professor sir dame herr frau fräulein señor señora señorita don doña sr sra srta monsieur madame mademoiselle mme mlle doctor doctora docteur dra".split())
_PARTICLES = "von|vom|van|der|den|dem|zu|zum|zur|de|del|della|di|da|dos|das|du|des|la|las|le|los|ter|ten|el"
_BEFORE_FAMILY = frozenset("von vom van der den zu zum zur de del du des di da dos d' d’".split())
_NAME = rf"(?:O['’]|D['’]|L['’]|Mc|Mac)?[{_UP}][{_LOW}]+(?:[-'’][{_UP}]?[{_LOW}]+)*|(?:O['’])?[{_UP}]{{2,}}(?:[-'’][{_UP}]+)*"
_TOKEN = re.compile(rf"(?P<initial>[{_UP}]\.(?:-[{_UP}]\.)?)|(?P<name>{_NAME})|(?P<particle>\b(?:{_PARTICLES})\b|\bd['’](?=[{_UP}]))")
_WORD = re.compile(r"\w+")
#: Words that may begin a sentence before a name, in four languages. Fixed values.
_STARTERS = set(
    "the a an and or but if when while although because between according to signed rated contact call ask thanks said from in on at of for with by as after before since so then no not nothing neither each every some most they he she it we you i is was my our her his your this that these those there here what who why how where which write reply prize parcel form bill still however dear best kind regards tel fax mail again note see owner notify maintainer annotator todo ship batch order item route version flat warn passport ssn nino ni nif nir dni nie section table host answer hence first dividing let suppose neither only yes model confidence reason"
    " der die das und oder aber wenn laut nach von mit für im am zum zur herr frau rückfragen mit das ein eine wer was wie dort danach man es er sie wir ich ihr mein bitte im auf an bei aus als seit steuer"
    " el la los las un y o pero firmado dejaron puede si según con de del en para por al entre don contacto puede llame escriba envíe su mi lo que no señora señor"
    " signé signe le les des et ou mais selon avec dans pour par chez entre au aux ce cette son sa ses mon ma il elle on nous vous je merci écrivez contact sur sans".split()
)
_ID_LABEL = re.compile(r"(?:\b(?:ssn|soc(?:ial|\.)?\s*sec(?:urity|\.)?|national\s+insurance|ni|nino|passport|tax|taxpayer|tin|itin|steuer-?\s?(?:id|identifikationsnummer|nummer|idnr)\w*|idnr|reisepass\w*|personalausweis\w*|ausweis\w*|sozialversicherungs\w*|dni|nif|nie|documento(?:\s+de\s+identidad)?|pasaporte|seguridad\s+social|nir|n[°º]\s*de\s+s[ée]curit[ée]\s+sociale|s[ée]curit[ée]\s+sociale|s[ée]cu|num[ée]ro\s+fiscal|passeport|carte\s+d['’]identit[ée]|identity|id)\b)\.?(?:\s*(?:card|number|no|nr|nummer|num|núm|n)\b\.?|\s*n[°º.]?|\s*#)?\s*(?:is|was|ist|lautet|es|est|:|=|,|\()*\s*[\"']?$", re.I)
_ID_BAD = re.compile(r"\b(?:batch|order|item|invoice|lot|seed|run|ticket|build|version|ref|part|serial|call|gen)\b[\w ]{0,6}\.?\s*(?:no\.?|nr\.?|number|#)?\s*:?\s*$", re.I)
_PHONE_LABEL = re.compile(r"\b(?:tel|tél|teléfono|telefon|téléphone|phone|mobile|mobil|móvil|cell|fax|call|whatsapp|number has changed to|reach\b.{0,40}\bon|llam\w*|appel\w*|unter|ring|text|al|au|handy)\b[\"'.:= ]*(?:me at|me on|on|at|to|al|le|unter|el)?\s*[\"':= ]*$", re.I)
_NAME_LABEL = re.compile(
    r"(?:\b(?:signed|according to|rated by|contact|contacto|kontakt|laut|según|selon|parcel for|form lists|lists|reach|llamar a|appeler|i am|ich bin|soy|je suis|annotator|maintainer|owner|bill it to|gruß|grüßen|regards|saludos|cordialement|atentamente|joindre|name|nombre|nom|author|autor|sender|paket an|paquete para|colis pour)\b[,:=\s]*[\"'#]*\s*|\b(?:mr|mrs|ms|dr|prof|herr|frau|sra?|mme|m|monsieur|madame|señora?|don|doña)\.?\s+)$",
    re.I,
)


#: Commands that name an account on a machine, and words before a number that counts things. Fixed values.
_REMOTE = re.compile(r"\b(?:scp|ssh|sftp|rsync|git\s+(?:clone|fetch|pull|push|remote\s+add\s+\w+))\b[^\n]*$|\b(?:ssh|git|sftp)://$", re.I)
_COUNTED = re.compile(r"\b(?:about|over|some|nearly|almost|than|all|these|those|first|last|another|every|counts?|counted)\s+$", re.I)


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    text: str
    features: list[int] = field(default_factory=list)
    context: list[int] = field(default_factory=list)
    anchors: list[int] = field(default_factory=list)
    label: int | None = None


def _h(name: str) -> int:
    return crc32(name.encode()) % DIMENSIONS


def _shape(t: str) -> str:
    return re.sub(r"a+", "a", re.sub(r"A+", "A", re.sub(r"[a-zß-öø-ÿ]", "a", re.sub(r"[A-ZÀ-ÖØ-Þ]", "A", re.sub(r"\d", "9", t)))))


def _context(text: str, start: int, end: int) -> list[str]:
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])][-2:]
    after = [w.lower() for w in _WORD.findall(text[end : end + 30])][:2]
    out = [f"b1={before[-1] if before else '^'}", f"a1={after[0] if after else '$'}", f"pb={text[start - 1 : start]!r}", f"pa={text[end : end + 1]!r}"]
    if len(before) > 1:
        out.append(f"b2={before[0]} {before[1]}")
    if len(after) > 1:
        out.append(f"a2={after[0]} {after[1]}")
    return [re.sub(r"\d", "9", x) for x in out]


def _name_spans(text: str) -> Iterator[tuple[int, int, list[tuple[str, str]], bool]]:
    """Spans that could be a full name: their tokens (class, text), and whether the family name comes first."""
    run: list[re.Match] = []

    def spans(run: list[re.Match]) -> Iterator[tuple[int, int, list[tuple[str, str]], bool]]:
        for i in range(len(run)):
            if run[i].lastgroup == "particle":
                continue
            for j in range(i + 1, min(len(run), i + 6)):
                part = run[i : j + 1]
                if part[-1].lastgroup != "name" or sum(m.lastgroup == "name" for m in part) > 3:
                    continue
                yield part[0].start(), part[-1].end(), [(m.lastgroup, m.group()) for m in part], False

    last = None
    for m in _TOKEN.finditer(text):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "@_"):
            continue
        if m.lastgroup == "name" and m.end() < len(text) and (text[m.end()].isdigit() or text[m.end()] in "@_("):
            yield from spans(run)
            run, last = [], None
            continue
        lower = m.group().lower().rstrip(".")
        gap = text[last.end() : m.start()] if last else None
        if lower in _TITLES or (m.lastgroup == "name" and lower in _STARTERS):
            yield from spans(run)
            run, last = [], None
            continue
        if last and gap in (" ", "") or (last and gap in (" ", "  ")):
            run.append(m)
        else:
            yield from spans(run)
            if last and gap == ", " and last.lastgroup == "name" and m.lastgroup in ("name", "initial") and run and run[-1] is last:
                first = run[-1] if len(run) == 1 or run[-2].group().lower() not in _BEFORE_FAMILY else run[-2]
                rest = re.match(rf"(?:[{_UP}]\.)?(?:[ ]?[{_UP}]\.)*", text[m.end() :]) if m.lastgroup == "initial" else re.match(rf"(?:[ ][{_UP}]\.)*", text[m.end() :])
                end = m.end() + (rest.end() if rest else 0)
                yield first.start(), end, [("name", last.group()), (m.lastgroup, m.group())], True
            run = [m]
        last = m
    yield from spans(run)


@dataclass
class Words:
    """What the corpus says about words.

    ``common``: name-like strings found in so many distinct texts, and there so seldom in
    the contexts of names, that they are places, headings or models, not persons; ``low``: capitalised words of the corpus that occur
    in lower case too; ``often``: of its capitalised words, how many texts in 10,000.
    """

    common: frozenset[str] = frozenset()
    low: frozenset[str] = frozenset()
    often: dict[str, int] = field(default_factory=dict)


def _often(n: int) -> int:
    return min(6, int(n).bit_length() // 2)


def candidates(text: str, words_of: Words | None = None) -> list[Candidate]:
    """All candidate spans with features and, where the context leaves no doubt, a label."""
    known_words = words_of or Words()
    common = known_words.common
    out: list[Candidate] = []

    def add(kind: str, start: int, end: int, names: list[str], anchors: list[str], label: int | None) -> None:
        t = text[start:end]
        own, around, marks = ([_h(f"{kind}|{n}") for n in x] for x in ([*names, "bias"], _context(text, start, end), anchors))
        out.append(Candidate(kind, start, end, t, own, around, marks, label))

    for m in _emails(text):
        # an account on a machine: a path follows, or a command for other machines comes before
        path = bool(re.match(r":[^\s:]", text[m.end() : m.end() + 2]))
        command = bool(_REMOTE.search(text[max(0, m.start() - 60) : m.start()]))
        add("email", m.start(), m.end(), [f"sign={'@' in m.group()}"], [f"path={path}", f"command={command}"], 0 if path or command else 1)
    digits = re.search(r"\d", text)
    if digits:
        matches = list(_ID.finditer(text))
        labelled = {re.sub(r"\W", "", m.group()).lower() for m in matches if _ID_LABEL.search(text[max(0, m.start() - 50) : m.start()])}
        for m in matches:
            t, before = m.group(), text[max(0, m.start() - 50) : m.start()]
            if not any(ch.isdigit() for ch in t):
                continue
            good, bad = bool(_ID_LABEL.search(before)), bool(_ID_BAD.search(before))
            shape = _shape(t)
            if not good and t[0].islower() and not re.match(r"[a-z]{2} ?\d\d ?\d\d ?\d\d ?[a-d]$", t) and re.sub(r"\W", "", t).lower() not in labelled:
                continue  # a number that starts in lower case needs a label somewhere in the text
            ring = bool(_PHONE_LABEL.search(before)) and not good
            if not good and re.fullmatch(r"[A-Z0-9]{9,12}", t) and not re.fullmatch(r"\d{9}|\d{11}|\d{8}[A-Z]|[A-Z]{1,2}\d{6,8}[A-Z]?", t):
                continue
            add("id_number", m.start(), m.end(), [f"shape={shape}", f"first={t[0]}"], [f"label={good}", f"bad={bad}", f"phone={ring}"], 1 if good and not bad else 0 if bad or ring else None)
        for m in _PHONE.finditer(text):
            t, before = m.group(), text[max(0, m.start() - 60) : m.start()]
            good, bad = bool(_PHONE_LABEL.search(before)), bool(_ID_BAD.search(before)) and not re.search(r"(?i)\bcall\W*$", before)
            label_id = bool(_ID_LABEL.search(before))
            known = t[0] == "+" or t.startswith("00")
            add("phone", m.start(), m.end(), [f"shape={_shape(t)}", f"head={re.sub(r'[^0-9+(]', '', t)[:2]}", f"n={sum(c.isdigit() for c in t)}"], [f"label={good}", f"bad={bad}", f"id={label_id}"], 0 if bad or label_id else 1 if good or known else None)
        for m in _addresses(text):
            t = m.group()
            kind = "num-first" if t[0].isdigit() else "num-last"
            counted = kind == "num-first" and bool(_COUNTED.search(text[max(0, m.start() - 30) : m.start()]))
            add("street_address", m.start(), m.end(), [kind, f"words={len(t.split())}"], [f"counted={counted}"], 0 if counted else 1)
    seen: set[tuple[int, int]] = set()
    for start, end, tokens, swapped in _name_spans(text):
        if (start, end) in seen or "\n" in text[start:end]:
            continue
        seen.add((start, end))
        t, before = text[start:end], text[max(0, start - 40) : start]
        names = [f"{'swap' if swapped else 'norm'}:{'-'.join(c for c, _ in tokens)}"]
        words = [w.lower() for c, w in tokens if c == "name"]
        given, family = (words[-1] if len(words) > 1 else "^", words[0]) if swapped else (words[0] if len(words) > 1 else "^", words[-1])
        names += [f"given={given}", f"family={family}", f"s3={family[-3:]}", f"s5={family[-5:]}", f"p4={family[:4]}", f"p5={family[:5]}", f"upper={t.isupper()}", f"same={len(words)}"]
        names += [f"mid={w}" for w in words[1:-1]]
        names += [f"low={sum(w in known_words.low for w in words)}", f"gl={given in known_words.low}", f"fl={family in known_words.low}", f"fo={_often(known_words.often.get(family, 0))}", f"go={_often(known_words.often.get(given, 0)) if given != '^' else '^'}"]
        anchored = bool(_NAME_LABEL.search(before)) and not (start and text[start - 1].isalnum())
        often = t.lower() in common or any(w in common for w in (" ".join(words), *( [given] if given in common else [])))
        add("person_name", start, end, names + [f"often={often}"], [f"label={anchored}"], 1 if anchored and len(tokens) in (2, 3) and not swapped else 0 if often else None)
    return out


def _key(c: Candidate) -> frozenset[str]:
    if c.kind == "person_name":
        return frozenset(w.lower() for w in re.findall(rf"[{_UP}{_LOW}]{{4,}}", c.text))
    return frozenset([re.sub(r"\W", "", c.text).lower()])


def edges(cands: list[Candidate]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges (consecutive, close, not overlapping) and skip edges (equal or similar text; each to the mention before)."""
    order = sorted(range(len(cands)), key=lambda i: (cands[i].start, cands[i].end))
    chain = [(a, b) for a, b in zip(order, order[1:]) if 0 <= cands[b].start - cands[a].end <= 40]
    last: dict[tuple[str, str], int] = {}
    skip = []
    for i in order:
        c = cands[i]
        for k in _key(c):
            at = (c.kind, k)
            j = last.get(at)
            if j is not None and cands[j].end <= c.start:
                skip.append((j, i))
            last[at] = i
    return chain, list(dict.fromkeys(skip))


@dataclass
class Model:
    weights: np.ndarray
    chain: float
    skip: float
    words: Words


def marginals(cands: list[Candidate], model: Model) -> np.ndarray:
    return propagate(cands, model)[0]


def propagate(cands: list[Candidate], model: Model, tolerance: float = 1e-3, rounds: int = 100) -> tuple[np.ndarray, bool]:
    """(P(node is personal information), settled) by damped loopy belief propagation over the binary nodes.

    Messages are sent until none changes by more than ``tolerance``, or ``rounds`` times; then
    it is not settled.
    """
    unary = np.array([model.weights[c.features + c.context + c.anchors].sum() for c in cands])
    chain, skip = edges(cands)
    pairs = [(a, b, model.chain) for a, b in chain] + [(a, b, model.skip) for a, b in skip]
    if not pairs:
        return 1 / (1 + np.exp(-np.clip(unary, -30, 30))), True
    src = np.array([p[0] for p in pairs] + [p[1] for p in pairs])
    dst = np.array([p[1] for p in pairs] + [p[0] for p in pairs])
    w = np.array([p[2] for p in pairs] * 2)
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    msg = np.zeros(len(src))  # log odds sent along each directed edge; potential w if both ends agree on 1
    settled = False
    for _ in range(rounds):
        total = unary + np.bincount(dst, weights=msg, minlength=len(unary))
        into = np.clip(total[src] - msg[back], -30, 30)
        sent = 0.5 * msg + 0.5 * (np.logaddexp(0, into + w) - np.logaddexp(0, into))
        settled, msg = bool(np.abs(sent - msg).max() <= tolerance), sent
        if settled:
            break
    total = unary + np.bincount(dst, weights=msg, minlength=len(unary))
    return 1 / (1 + np.exp(-np.clip(total, -30, 30))), settled


def _train(rows: list[list[int]], ys: list[float], sums: list[tuple[int, int]], epochs: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression with AdaGrad over sparse rows and the two counts of positive neighbours."""
    w, extra = np.zeros(DIMENSIONS), np.zeros(2)
    g, ge = np.full(DIMENSIONS, 1e-2), np.full(2, 1e-2)
    y, near = np.array(ys, dtype="float64"), np.array(sums, dtype="float64")
    lengths = np.array([len(r) for r in rows])
    flat, starts = np.concatenate([np.array(r) for r in rows]), np.concatenate([[0], lengths.cumsum()])
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 256)):
            idx = np.concatenate([flat[starts[i] : starts[i + 1]] for i in part])
            own = np.repeat(np.arange(len(part)), lengths[part])
            z = np.bincount(own, weights=w[idx], minlength=len(part)) + near[part] @ extra
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
            grad = np.bincount(idx, weights=err[own], minlength=DIMENSIONS) / len(part) + 1e-5 * w
            g += grad**2
            w -= 0.15 * grad / np.sqrt(g)
            e = near[part].T @ err / len(part)
            ge += e**2
            extra -= 0.15 * e / np.sqrt(ge)
    return w, extra


def cases(text: str) -> tuple[set[str], set[str]]:
    """The words of a text that occur in lower case, and those that occur with a capital, in lower case."""
    words = set(_WORD.findall(text))
    return {w for w in words if w.islower()}, {w.lower() for w in words if w[:1].isupper()}


def fit(texts: list[str], common: frozenset[str], epochs: int = 8, seed: int = 7, words: Words | None = None) -> Model:
    """Pseudo-likelihood training: logistic regression of each labelled node on its features and its neighbours' labels.

    A second round adds the nodes about which the first is sure (above 0.9, below 0.1).
    """
    if words is None:
        low, caps = set(), Counter()
        for t in texts:
            lower, upper = cases(t)
            low |= lower
            caps.update(upper)
        words = Words(common, frozenset(low), {w: max(1, n * 10_000 // max(1, len(texts))) for w, n in caps.items()})
    words_of = words
    rng = np.random.default_rng(seed)
    docs = []
    for t in texts:
        cands = candidates(t, words_of)
        covered = [(c.start, c.end) for c in cands if c.kind == "person_name" and c.label == 1]
        for c in cands:
            if c.kind == "person_name" and c.label is None and any(c.start < e and s < c.end and not (s <= c.start and c.end <= e) for s, e in covered):
                c.label = 0  # reaches beyond a name that stands in an unmistakable context
        docs.append((cands, *edges(cands)))
    model = Model(np.zeros(DIMENSIONS), 0.0, 0.0, words_of)
    for again in (False, True):
        rows: list[list[int]] = []
        ys: list[float] = []
        sums: list[tuple[int, int]] = []
        for cands, chain, skip in docs:
            if again and cands:
                p = marginals(cands, model)
                for c, q in zip(cands, p):
                    if c.label is None and not 0.1 < q < 0.9:
                        c.label = int(q > 0.5)
            near = [[0, 0] for _ in cands]
            for k, es in enumerate((chain, skip)):
                for a, b in es:
                    near[a][k] += cands[b].label == 1
                    near[b][k] += cands[a].label == 1
            for c, n in zip(cands, near):
                if c.label is not None:
                    drop = rng.random(2)
                    rows.append(c.features + (c.context if drop[0] < 0.5 else []) + (c.anchors if drop[1] < 0.5 else []))
                    ys.append(c.label)
                    sums.append((n[0], n[1]))
        if not rows:
            return model
        weights, extra = _train(rows, ys, sums, epochs, rng)
        model = Model(weights, float(max(extra[0], 0.0)), float(max(extra[1], 0.5)), words_of)
    return model


_PRIORITY = {k: i for i, k in enumerate(KINDS)}


def spans(text: str | None, model: Model) -> list[tuple[str, int, int]]:
    return settled_spans(text, model)[0]


def settled_spans(text: str | None, model: Model) -> tuple[list[tuple[str, int, int]], bool]:
    """(kind, start, end) of the personal information in a text, in order, without overlaps; and whether its messages settled."""
    cands = candidates(text, model.words) if text else []
    if not cands:
        return [], True
    p, settled = propagate(cands, model)
    # of overlapping spans the longest stays, and names give way to all other kinds
    rank = sorted((i for i in range(len(cands)) if p[i] > 0.5), key=lambda i: (cands[i].kind == "person_name", cands[i].start - cands[i].end, -p[i], _PRIORITY[cands[i].kind], cands[i].start))
    taken: list[tuple[str, int, int]] = []
    for i in rank:
        c = cands[i]
        if all(c.end <= s or e <= c.start for _, s, e in taken):
            taken.append((c.kind, c.start, c.end))
    return sorted(taken, key=lambda x: x[1]), settled


def redact(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for kind, s, e in found:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(out) + text[at:]


_SIGNED_OFF = re.compile(r"(?:^|\n)[ \t>*_—–-]*$")
_PHRASE = re.compile(rf"[{_UP}][{_LOW}]+(?: (?:(?:{_PARTICLES}) )*[{_UP}][{_LOW}]+){{0,2}}")
#: A phrase that stands in a name's context in more than this share of its texts may be a person's name, however frequent.
SELDOM = 0.1


def phrases(text: str) -> dict[str, bool]:
    """The capitalised phrases of two or more words, in lower case; whether one stands after a title or label of names, or signs the text off."""
    out: dict[str, bool] = {}
    for m in _PHRASE.finditer(text):
        if " " in m.group():
            before = text[max(0, m.start() - 40) : m.start()]
            named = bool(_NAME_LABEL.search(before)) or (m.start() > 0 and bool(_SIGNED_OFF.search(before)) and not re.search(r"\w", text[m.end() :]))
            x = m.group().lower()
            out[x] = out.get(x, False) or named
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 10_000, share: float = 0.002, longest: int = 20_000) -> Model:
    """Fit on ``sample`` distinct texts of at most ``longest`` characters, or all if there are fewer: those of the least hashes.

    So the sample is bounded in bytes too. What the corpus says about words and phrases is
    counted over all documents, whole.
    """
    text = F.col(f"`{text_col}`")
    texts = materialise(docs.where(text.isNotNull()).select(text.alias("t")).distinct(), "texts")
    words = words_of(texts, share)
    short = texts.where(F.length("t") <= longest)
    least = short.select(F.xxhash64("t").alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = short.where(F.xxhash64("t") <= F.lit(least)).collect() if least is not None else []
    return fit(sorted(r["t"] for r in rows), words.common, words=words)


#: Words in lower case that are kept, those of the most texts first; they go to the driver and to every task.
VOCABULARY = 1_000_000


def common_phrases(docs: DataFrame, text_col: str = "text", share: float = 0.002) -> frozenset[str]:
    text = F.col(f"`{text_col}`")
    return words_of(docs.where(text.isNotNull()).select(text.alias("t")).distinct(), share).common


def words_of(texts: DataFrame, share: float = 0.002, vocabulary: int = VOCABULARY) -> Words:
    """Counts over all of ``texts``, distinct ones in a column ``t``.

    ``common``: phrases in more than ``share`` of them, in at least 12, and seldom in a
    name's context; at most candidates per text / share. ``often`` leaves out words in
    fewer than two texts in 10,000, for which features are the same as for none; so it has
    at most 5,000 times the words of a text. ``low`` holds words that occur with a capital
    too, as only such are asked for, and at most ``vocabulary`` of them.
    """
    total = texts.count()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrase: dict[str, list[int]] = {}
        word: dict[str, list[int]] = {}

        def flush() -> pd.DataFrame:
            both = [(True, x, n, k) for x, (n, k) in phrase.items()] + [(False, x, n, k) for x, (n, k) in word.items()]
            return pd.DataFrame(both, columns=["phrase", "x", "n", "k"])

        for pdf in batches:
            for t in pdf["t"]:
                for x, named in phrases(t).items():
                    s = phrase.setdefault(x, [0, 0])
                    s[0] += 1
                    s[1] += named
                lower, upper = cases(t)
                for x in upper:
                    word.setdefault(x, [0, 0])[0] += 1
                for x in lower:
                    word.setdefault(x, [0, 0])[1] += 1
            if len(phrase) + len(word) > 200_000:
                yield flush()
                phrase, word = {}, {}
        yield flush()

    parts = spread(texts, "t").mapInPandas(count, "phrase boolean, x string, n bigint, k bigint")
    counted = materialise(parts.groupBy("phrase", "x").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "words")
    common = counted.where(F.col("phrase") & (F.col("n") >= max(12, total * share)) & (F.col("k") <= SELDOM * F.col("n"))).select("x").collect()
    often = counted.where(~F.col("phrase") & (F.col("n") * 10_000 >= 2 * total) & (F.col("n") > 0)).select("x", "n").collect()
    low = counted.where(~F.col("phrase") & (F.col("n") > 0) & (F.col("k") > 0)).orderBy(F.desc("k"), "x").limit(vocabulary).select("x").collect()
    return Words(frozenset(r["x"] for r in common), frozenset(r["x"] for r in low), {r["x"]: r["n"] * 10_000 // total for r in often})


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, redacted, found, settled): every row with its redacted text, the array of (kind, start, found_text), and whether its messages settled.

    Null texts stay null and hold nothing; empty ones stay empty; all else of a text
    is unchanged. Rows with equal text are judged alike.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)  # weights of fixed size
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = handle.value
        for pdf in batches:
            redacted, found, settled = [], [], []
            for t in pdf["text"]:
                s, ok = settled_spans(t, m)
                settled.append(ok)
                redacted.append(redact(t, s))
                found.append([{"kind": k, "start": a, "found_text": t[a:b]} for k, a, b in s])
            yield pd.DataFrame({"id": pdf["id"], "text": pdf["text"], "redacted": redacted, "found": found, "settled": settled})

    schema = f"id {kind}, text string, redacted string, found array<struct<kind:string,start:int,found_text:string>>, settled boolean"
    rows = spread(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text")
    return rows.mapInPandas(scan, schema).withColumnRenamed("id", id_col)
