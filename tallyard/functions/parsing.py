"""Reading models' free-text answers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyard.functions.spans import TOKEN, object_spans

SLOTS = "ABCDE"


def canon_first(raw: Column, aliases: list[tuple[str, str]]) -> Column:
    """The name of an exact alias, else of the first alias contained, in the given order."""
    s = F.lower(F.trim(raw))
    exact, part = F.lit(None).cast("string"), F.lit(None).cast("string")
    for alias, name in reversed(aliases):
        exact = F.when(s == alias, name).otherwise(exact)
        part = F.when(s.contains(alias), name).otherwise(part)
    return F.when(s != "", F.coalesce(exact, part))


def canon_longest(raw: Column, aliases: list[tuple[str, str]]) -> Column:
    """The same, with longer aliases first, so that none is shadowed by a shorter one."""
    return canon_first(raw, sorted(aliases, key=lambda a: (-len(a[0]), aliases.index(a))))


def name_contained(raw: Column, names: list[str], other: dict[str, str]) -> Column:
    """The first panel name contained, else the name of a contained synonym."""
    out = F.lit(None).cast("string")
    for part, name in reversed([*((n.lower(), n) for n in names), *other.items()]):
        out = F.when(F.lower(raw).contains(part), name).otherwise(out)
    return out


def first_word(text: Column) -> Column:
    """The first word without marks around it, in lower case."""
    return F.lower(F.regexp_replace(F.get(F.split(F.trim(text), r"\s+"), 0), r"^[.,:;!*\"']+|[.,:;!*\"']+$", ""))


_FENCE = "```"
_MARKS = " \t*_#>-•"
#: Fixed value: how an answer that is no complete JSON still names its model.
MODEL_FIELD = re.compile(r'"model"\s*:\s*"([^"]+)"')


def json_objects(text: str | None) -> list[dict]:
    """Every outermost object of an answer that can be read, those in code fences first; a comma before a closing bracket is forgiven."""
    if not text:
        return []
    ranked = sorted(object_spans(text), key=lambda s: (text.count(_FENCE, 0, s[0]) % 2 == 0, s[0]))
    found = (_lenient(text[a:b]) for a, b in ranked)
    return [x for x in found if isinstance(x, dict)]


def _lenient(piece: str) -> object:
    for attempt in (piece, _without_last_commas(piece)):
        try:
            return json.loads(attempt)
        except (ValueError, RecursionError):
            continue
    return None


def _without_last_commas(piece: str) -> str:
    """The text without commas that only blanks part from a closing bracket; strings are left alone."""
    out, at = [], 0
    for m in TOKEN.finditer(piece):
        if m.group() in "]}":
            head = piece[at : m.start()]
            bare = head.rstrip()
            out.append(bare[:-1] if bare.endswith(",") else head)
            at = m.start()
    return "".join(out) + piece[at:]


def canon_py(raw: object, aliases: list[tuple[str, str]]) -> str | None:
    """``canon_first`` for one value."""
    s = str(raw).strip().lower() if raw else ""
    names = [name for alias, name in aliases if s and alias == s] or [name for alias, name in aliases if s and alias in s]
    return names[0] if names else None


def _folded(obj: dict) -> dict:
    """The object with its keys in lower case, the first of equal ones."""
    out: dict = {}
    for k, v in obj.items():
        out.setdefault(k.strip().lower(), v)
    return out


def _named(value: object, aliases: list[tuple[str, str]]) -> tuple[str | None, int | None]:
    """(name, confidence) that a JSON value states."""
    if not isinstance(value, dict):
        return canon_py(value, aliases), None
    fields = _folded(value)
    sure = fields.get("confidence")
    return canon_py(fields.get("model"), aliases), sure if isinstance(sure, int) else None


def slot_lines(text: str | None) -> dict[str, str]:
    """Slot to the rest of the first line that opens with the slot's letter and a mark, such as 'A: ...', '**B** - ...' or 'C) ...'."""
    out: dict[str, str] = {}
    for line in (text or "").splitlines():
        bare = line.strip(_MARKS)
        letter, rest = bare[:1], bare[1:].lstrip(" *_")
        if letter in SLOTS and letter not in out and rest[:1] in tuple(":.-—–)"):
            out[letter] = rest[1:].strip(_MARKS)
    return out


def parse_lineup(text: str | None, aliases: list[tuple[str, str]]) -> tuple[dict[str, tuple[str, int | None]], bool]:
    """(slot to (name, confidence), needs review): the first readable object decides a slot, else the slot's own line."""
    stated = _folded(next(iter(json_objects(text)), {}))
    lines, out = slot_lines(text), {}
    for slot in SLOTS:
        name, sure = _named(stated.get(slot.lower()), aliases)
        if name is None and slot in lines:
            name, sure = canon_py(lines[slot], aliases), None
        if name is not None:
            out[slot] = (name, sure)
    return out, len(out) < len(SLOTS)


def parse_single(text: str | None, aliases: list[tuple[str, str]]) -> tuple[str | None, int | None, bool]:
    """(name, confidence, needs review): the first readable object, else a model field of an unfinished one, else any name in the text."""
    name, sure = _named(next(iter(json_objects(text)), None), aliases)
    if name is None:
        field = MODEL_FIELD.search(text or "")
        name, sure = canon_py(field.group(1) if field else text, aliases), None
    return name, sure, name is None


def single_udf(aliases: list[tuple[str, str]]):
    kind = T.StructType([T.StructField("model", T.StringType()), T.StructField("confidence", T.IntegerType()), T.StructField("needs_review", T.BooleanType())])

    @F.pandas_udf(kind)
    def parse(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_single(t, aliases) for t in text], columns=["model", "confidence", "needs_review"])

    return parse


def lineup_udf(aliases: list[tuple[str, str]]):
    kind = T.StructType([T.StructField("slots", T.MapType(T.StringType(), T.StringType())), T.StructField("needs_review", T.BooleanType())])

    @F.pandas_udf(kind)
    def parse(text: pd.Series) -> pd.DataFrame:
        rows = [parse_lineup(t, aliases) for t in text]
        return pd.DataFrame({"slots": [{k: v[0] for k, v in r[0].items()} for r in rows], "needs_review": [r[1] for r in rows]})

    return parse


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC form with straight quotes."""
    import unicodedata

    quotes = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"'})
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).translate(quotes))
