"""Redaction of nested values: every leaf of any depth, with the keys and flags before it as hints."""

from __future__ import annotations

import re

from .text import SENSITIVE, sensitive_pattern

#: Longer leaves are cut after redaction.
MAX_FIELD = 500
PATTERNS = [(re.compile(sensitive_pattern(n)), f"[REDACTED:{n}]") for n in SENSITIVE]
FLAG = re.compile(r"--?([A-Za-z][A-Za-z0-9_-]*)")


def redact(text: str) -> tuple[str, int]:
    n = 0
    for pattern, name in PATTERNS:
        text, k = pattern.subn(lambda _, name=name: name, text)
        n += k
    return text, n


def capped(text: str) -> str:
    return text if len(text) <= MAX_FIELD else f"{text[:MAX_FIELD]}…[truncated, {len(text)} chars total]"


def number_text(x: float) -> str:
    """A JSON number as a text without a fraction of zero."""
    return str(int(x)) if isinstance(x, int) or (x.is_integer() and abs(x) < 1e21) else repr(x)


def leaf(value, hint: str | None):
    """The value without what is sensitive in it, and how often something was; a text that is so only behind `hint=` goes as a whole, a number stays one if nothing was."""
    if isinstance(value, str):
        text, n = redact(value)
        if hint:
            keyed = redact(f"{hint}={value}")[1]
            if keyed > n:
                return f"[REDACTED:{hint}]"[: MAX_FIELD + 40], keyed
        return capped(text), n
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        text, n = redact(number_text(value))
        return (capped(text), n) if n else (value, 0)
    return value, 0


def scrub(value) -> tuple[object, int]:
    """value rebuilt from scrubbed leaves, and the number of redactions. An array's element has the flag before it as its hint, an object's value its key."""
    box: list = [None]
    open_: list[tuple] = [(value, None, box, 0)]  # value, hint, where its result goes
    total = 0
    while open_:
        x, hint, into, at = open_.pop()
        if isinstance(x, dict):
            into[at] = dict.fromkeys(x)
            open_ += [(v, k, into[at], k) for k, v in x.items()]
        elif isinstance(x, list):
            into[at] = [None] * len(x)
            for k, v in enumerate(x):
                flag = FLAG.fullmatch(x[k - 1].strip()) if k and isinstance(x[k - 1], str) else None
                open_.append((v, flag[1] if flag else None, into[at], k))
        else:
            into[at], n = leaf(x, hint)
            total += n
    return box[0], total
