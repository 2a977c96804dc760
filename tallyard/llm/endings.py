"""Whether a text is finished: structure first, then what its closing words allow."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

NONE, COMPLETE, CUT, OPEN = "none", "complete", "cut", "open"

_MARKER = re.compile(r"(?:…|\.\.\.)?\s*[\[<({](?:\.\.\.|…|[^\[\]<>(){}\n]{0,20}\b(?:cut|truncated|snip|snipped|cut off|abgeschnitten|gekürzt|tronqué|coupé|cortado|truncado)\b[^\[\]<>(){}\n]{0,10})[\]>)}]$", re.I)
_FINAL = re.compile(r"[.!?。！？][\"'”’»)\]*_]*$")
_ELLIPSIS = re.compile(r"(?:…|\.\.\.)[\"'”’»)\]*_]*$")
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+(.*)$")
_ASSIGN = re.compile(r"^[A-Za-z_][\w.\[\]]* [-+*/]?= \S.*$")
_PAIR = re.compile(r"^\w+: \S+$")
_SLOT = re.compile(r"^[A-Z]: ")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»)\]]*\s+")
_JSON = re.compile(r"(?:^|\n)\s*(?=[\[{]\s*[\"{\[])")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_LONG = 3
_MARKS = ".!?\"'”’»)]*_,;:–—"


def _bare(text: str) -> str:
    """The text without trailing blanks, emoji and invisible characters."""
    end = len(text)
    while end and (text[end - 1].isspace() or text[end - 1] not in "�`^" and unicodedata.category(text[end - 1]) in ("Cf", "So", "Sk", "Mn")):
        end -= 1
    return text[:end]


def _unbalanced(text: str) -> bool:
    depth, inside, escaped = 0, False, False
    for ch in text:
        if inside:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                inside = False
        elif ch == '"':
            inside = True
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
    return inside or depth > 0


def last_words(sentence: str) -> tuple[str, str, str]:
    """The last three, two and one words in lower case, without the marks that close them; '' where there are fewer."""
    w = sentence.rstrip(" \t\r" + _MARKS).lower().split()
    return tuple(" ".join(w[-k:]) if len(w) >= k else "" for k in (3, 2, 1))  # type: ignore[return-value]


def ending(text: str | None) -> tuple[str, str, str, str, str]:
    """(state, kind, three, two, one).

    state: 'none' (no letter or digit), 'complete', 'cut', or 'open': the last
    sentence or list item has no final mark and the corpus must say whether only the
    mark is missing. kind: 'sentence' or 'item'; the rest are its last words.
    """
    nothing = ("", "", "", "")
    if not text or not any(ch.isalnum() for ch in text):
        return (NONE, *nothing)
    s = _bare(text)
    if s.endswith("�") or _MARKER.search(s):
        return (CUT, *nothing)
    if s.count("```") % 2:
        return (CUT, *nothing)
    if s.endswith("```"):
        return (COMPLETE, *nothing)
    if "```" not in s and (m := _JSON.search(s)):
        try:
            _, end = json.JSONDecoder(strict=False).raw_decode(s, m.end())
            if end == len(s):
                return (COMPLETE, *nothing)
        except (ValueError, RecursionError):
            return (CUT if _unbalanced(s[m.end() :]) else COMPLETE, *nothing)
    lines = s.split("\n")
    last = lines[-1].strip()
    if _FINAL.search(s):
        if _ELLIPSIS.search(s) and not re.search(r"\s(?:…|\.\.\.)[\"'”’»)\]*_]*$", s):
            last = _ELLIPSIS.sub("", last)
        elif re.search(r"\bversion \d+(?:\.\d+)*\.$", s, re.I):
            return (CUT, *nothing)
        else:
            return (COMPLETE, *nothing)
    if s[-1] in ",;:-–—(/&+=<[{\\" or re.search(r",[\"”’»]$", s):
        return (CUT, *nothing)
    whole = s.split()
    if len(lines) == 1 and len(whole) <= _LONG:
        return (COMPLETE, *nothing)
    filled = [x for x in lines if x.strip()]
    if m := _ITEM.match(last):
        others = [len(i.group(1).split()) for x in filled[:-1] if (i := _ITEM.match(x))]
        n = len(m.group(1).split())
        if n < min(others, default=1):
            return (CUT, *nothing)
        return (OPEN, "item", *last_words(last))
    if _ASSIGN.match(last):
        return (COMPLETE, *nothing)
    if _SLOT.match(last) and " - " not in last and (len(filled) == 1 or " - " in filled[-2]):
        return (CUT, *nothing)
    if _PAIR.match(last) and _PAIR.match(filled[0].strip()) and len(filled) < 3:
        return (CUT, *nothing)
    if s[-1] in ")]”»":
        return (COMPLETE, *nothing)
    if len(filled) > 1 and filled[-2].rstrip().endswith(",") and len(filled[-2].split()) <= 4 and len(last.split()) in (2, 3, 4):
        return (COMPLETE, *nothing)  # a closing formula with its name
    sentence = _SENTENCE.split(last)[-1]
    return (OPEN, "sentence", *last_words(sentence))


def interior(text: str | None) -> dict[tuple[str, bool], list[str]]:
    """(kind, closing) to the last words that stand in something finished, repeated ones too.

    kinds: 't' three words, 'p' a pair, 'w' one. closing: they are the last of a sentence
    that has its mark, or of a list item, and the text goes on after it; else a word follows
    them in the same sentence.
    """
    out: dict[tuple[str, bool], list[str]] = {(k, c): [] for k in "tpw" for c in (False, True)}
    lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
    for i, line in enumerate(lines):
        end = i == len(lines) - 1
        item = _ITEM.match(line)
        parts = [item.group(1)] if item else _SENTENCE.split(line)
        for at, s in enumerate(parts):
            over = end and at == len(parts) - 1
            w = s.lower().split()
            go = w[: len(w) - 1 - over]  # the word before an open end may go on anywhere
            out["w", False] += [x.rstrip(_MARKS) for x in go]
            out["p", False] += map(" ".join, zip(go, go[1:]))
            out["t", False] += map(" ".join, zip(go, go[1:], go[2:]))
            if not over and (item or _FINAL.search(s)):
                for kind, key in zip("tpw", last_words(s)):
                    if key:
                        out[kind, True].append(key)
    return out


def _places(words: list[str], run: list[str]) -> list[int]:
    k, first = len(run), run[0]
    return [i for i in range(len(words) - k + 1) if words[i] == first and words[i : i + k] == run]


def align(early: str, late: str, run: int = 5) -> str | None:
    """'cut' if ``early`` stops where its near-copy ``late`` goes on with words, 'complete' if only with marks, else None.

    The last ``run`` whole words of ``early`` are found in ``late``, where they stand nearest
    to the same place; a broken last word must begin the word that follows them there.
    """
    a, b = _bare(early), _bare(late)
    if b.startswith(a):
        rest = b[len(a) :]
    else:
        x, y = a.split(), b.split()
        rest = None
        for broken in ("", *x[-1:]):
            body = x[: len(x) - bool(broken)]
            k = min(run, len(body))
            places = _places(y, body[-k:]) if k else []
            if places:
                at = min(places, key=lambda i: abs(i - (len(body) - k))) + k
                after = y[at:]
                if not broken:
                    rest = " ".join(after)
                    break
                if after and after[0].startswith(broken):
                    rest = " ".join(after)[len(broken) :]
                    break
        if rest is None:
            return None
    if not rest.strip():
        return None
    return CUT if any(ch.isalnum() for ch in rest) else COMPLETE
