"""Where JSON objects stand in a text, in one pass and without parsing."""

from __future__ import annotations

import re

TOKEN = re.compile(r'"(?:[^"\\\x00-\x1f]|\\.)*"|["{}\[\]]')


def object_spans(text: str) -> list[tuple[int, int]]:
    """Largest complete {...} spans, in one pass; an unfinished string or bracket ends what is open."""
    stack: list[tuple[str, int]] = []
    done: list[tuple[int, int]] = []
    for m in TOKEN.finditer(text):
        t, at = m.group(), m.start()
        if t in "{[":
            stack.append((t, at))
        elif t in "}]":
            if stack and stack[-1][0] == {"}": "{", "]": "["}[t]:
                start = stack.pop()[1]
                if t == "}":
                    while done and done[-1][0] > start:
                        done.pop()
                    done.append((start, at + 1))
            else:
                stack.clear()
        elif t == '"':
            stack.clear()
    return done
