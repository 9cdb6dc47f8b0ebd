"""Secret scans: base patterns, and an assignment-aware lexer.

The lexer reads source and configuration text as name-literal pairs: from each ``=`` or ``:`` it takes the name before
and the value after, a chain of quoted strings, bare literals and names joined by ``+`` or ``.``. Names that stand for
literals are propagated (``KEY = "..."`` then ``token = KEY``), so a harmless name's literal counts by the names it
reaches. A literal's score is the sensitivity of its best name times its shape (length, character classes, entropy).

Defined cases: null and empty texts have no span; offsets are code points, ends are exclusive; base spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import annotate, long, string

KINDS = ("assign", "access", "hex", "literal", "constant")
#: Score from which the lexer reports a literal.
MIN_SCORE = 0.5
MIN_LITERAL = 8

# The base patterns (letters of the names in either ASCII case) and the least length each must reach.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so the shorter ones that fail can be passed over at once
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

_SEPARATOR = re.compile(r"[=:]")
_NAME_FIRST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
_NAME = _NAME_FIRST | frozenset("0123456789.-")
_VALUE = re.compile(r"""[ \t]*(?:>[ \t]*)?(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|\$\{?([A-Za-z_][A-Za-z0-9_]*)\}?|([A-Za-z0-9+/_.~=\-]+))""")
_JOIN = re.compile(r"[ \t]*[+.][ \t]*(?=[\"'`$A-Za-z_])")
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
#: Parts of a name that make its literal a secret, with the weight of each.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 0.9, "privatekey": 1.0, "credential": 0.9, "passphrase": 1.0, "auth": 0.6, "signature": 0.6, "salt": 0.6, "bearer": 0.8}
_PLACEHOLDER = re.compile(r"(?i)\A(?:x+|\*+|\.+|changeme|example|placeholder|your[_-].*|<.*>|none|null|true|false)\Z")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' whole matches."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def sensitivity(name: str) -> float:
    flat = re.sub(r"[^a-z0-9]", "", name.lower())
    return max((w for k, w in SENSITIVE.items() if k in flat), default=0.0)


def shape(literal: str) -> float:
    """0 to 1: how much a literal looks like a key and not like a word or a placeholder."""
    n = len(literal)
    if n < MIN_LITERAL or _PLACEHOLDER.match(literal) or any(c.isspace() for c in literal):
        return 0.0
    counts = Counter(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = sum((any(map(str.islower, counts)), any(map(str.isupper, counts)), any(map(str.isdigit, counts)), any(not c.isalnum() for c in counts)))
    return min(1.0, entropy / 3.5) * (0.55 + 0.15 * classes)


def name_before(text: str, end: int) -> str:
    """The whole name before a separator: up to two closing marks and any number of blanks may stand between."""
    if end and text[end - 1] == "\n":
        end -= 1
    while end and text[end - 1] in " \t":
        end -= 1
    for _ in range(2):
        if end and text[end - 1] in "\"']":
            end -= 1
    start = end
    while start and text[start - 1] in _NAME:
        start -= 1
    while start < end and text[start] not in _NAME_FIRST:
        start += 1
    return text[start:end]


def pairs(text: str) -> list[tuple[str, list[tuple[str, str, int, int]]]]:
    """(name, parts) of each assignment; a part is ("literal" or "name", text, start, end)."""
    out = []
    skip = 0
    for sep in _SEPARATOR.finditer(text):
        if sep.start() < skip:
            continue
        before = name_before(text, sep.start())
        at = sep.end()
        while at < len(text) and text[at] in "=:>":
            at += 1
        if not before:
            continue
        parts = []
        while m := _VALUE.match(text, at):
            k = m.lastindex
            body = m[k]
            kind = "name" if k == 4 or k == 5 and _IDENT.match(body) else "literal"
            parts.append((kind, body, m.start(k), m.end(k)))
            at = m.end()
            if not (joined := _JOIN.match(text, at)):
                break
            at = joined.end()
        if parts:
            out.append((before, parts))
            if parts[0][0] == "literal":
                skip = parts[-1][3]
    return out


def lexed_spans(text: str, least: float = MIN_SCORE) -> list[tuple[int, int, int]]:
    """Literals (kind 3) under a sensitive name, and constants (kind 4) that such a name is given."""
    found = pairs(text)
    if not any(sensitivity(name) for name, _ in found):
        return []
    constants: dict[str, list[tuple[str, int, int]]] = {}
    refers: dict[str, list[str]] = {}
    for name, parts in found:
        for kind, body, start, end in parts:
            if kind == "literal":
                constants.setdefault(name, []).append((body, start, end))
            else:
                refers.setdefault(name, []).append(body)
    out: set[tuple[int, int, int]] = set()
    for name, parts in found:
        weight = sensitivity(name)
        if not weight:
            continue
        for kind, body, start, end in parts:
            if kind == "literal":
                if weight * shape(body) >= least:
                    out.add((start, 3, end))
                continue
            if body not in constants and body not in refers:
                # a bare word that names nothing here is itself the literal of a configuration line
                if weight * shape(body) >= least:
                    out.add((start, 3, end))
                continue
            seen, todo = {name}, [body]
            while todo:
                target = todo.pop()
                if target in seen:
                    continue
                seen.add(target)
                todo += refers.get(target, [])
                out |= {(s, 4, e) for literal, s, e in constants.get(target, []) if weight * shape(literal) >= least}
    return sorted(out)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _kernel():
    def kernel(texts):
        columns: list[list] = [[] for _ in range(5)]
        for t in texts:
            base = base_spans(t) if t else []
            extra = lexed_spans(t) if t else []
            kinds = Counter(k for _, k, _ in base)
            for c, v in zip(columns, (kinds[0], kinds[1], kinds[2], hashlib.sha256(spell(base).encode()).hexdigest(), spell(sorted(base + extra))), strict=True):
                c.append(v)
        return columns

    return kernel


FIELDS = [long("n_assign"), long("n_access"), long("n_hex"), string("base_sha256"), string("spans")]


def scan(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with counts of the base kinds, their digest, and all spans; clashing input columns give way."""
    return annotate(docs, text_col, _kernel, FIELDS)


def redact(text: str, spans: str, mask: str = "[SECRET]") -> str:
    """``text`` with every span of a ``spans`` string masked; overlapping spans are masked once."""
    at = sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in spans.split(",") if x))
    out, last = [], 0
    for s, e in at:
        if s >= last:
            out += [text[last:s], mask]
        last = max(last, e)
    return "".join(out) + text[last:]
