"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, schemes, digit cues, identifier words) in one pass;
a deterministic parser at each anchor finds the exact bounds and validates them.

Base kinds: email, ip, card, phone (leftmost, non-overlapping for each kind; a match that fails its
check is dropped and not tried again). Added kinds: intl_email (letters beyond ASCII), userinfo
(name and password in a URL), iban (mod 97), account (digits after an account cue).

Cues count in any mixture of upper and lower case.

Edge cases: null and empty texts have no spans; a null doc_id stays null; repeated rows are each
scanned; texts of any length are scanned whole; spans that begin together are ordered by kind; an empty table gives no
rows; other columns, also ones whose names differ from doc_id or text in case only, play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import product

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_rows, pick

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "intl_email", "userinfo", "iban", "account")
_RANK = {k: i for i, k in enumerate(KINDS)}

# Parsers run at an anchor only; none of them searches.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOMAIN_INTL = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"://[^\s/@:]+:[^\s/@]+@")
_IBAN = re.compile(r"[ :#.]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:s|t)?(?: ?(?:no|nr|number|id))?[ .:#=]{1,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I | re.A)
_CUES = {"iban": "iban", "account": "account", "acct": "account", "konto": "account"}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    digits = "0123456789"
    for x in digits:
        for y in digits:
            a.add_word(f"{x}.{y}", ("ip", 3))
            a.add_word(f"{x}{y}", ("card", 2))
            a.add_word(f"{x} {y}", ("card", 3))
            a.add_word(f"{x}-{y}", ("card", 3))
        a.add_word(f"+{x}", ("phone", 2))
    a.add_word("@", ("at", 1))
    a.add_word("://", ("scheme", 3))
    for cue, kind in _CUES.items():
        for form in product(*((c, c.upper()) for c in cue)):
            a.add_word("".join(form), (kind, len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def iban_ok(code: str) -> bool:
    code = code.replace(" ", "")
    if not 15 <= len(code) <= 34:
        return False
    turned = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
    return int(turned) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _byte_part(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or "0") <= 255


def find(text: str | None, auto: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text in code points, ordered by start, then kind."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    done = dict.fromkeys((*KINDS, "at"), 0)
    for last, (kind, n) in auto.iter(text):
        at = last - n + 1
        if kind == "at":
            start, floor = at, done["email"]
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                out.append(("email", start, m.end()))
                done["email"] = m.end()
            start, floor = at, max(done["intl_email"], done["email"] if m is None else 0)
            while start > floor and (text[start - 1] in _LOCAL or text[start - 1].isalnum()):
                start -= 1
            wide = _DOMAIN_INTL.match(text, at + 1) if start < at else None
            if wide and not text[start : wide.end()].isascii():
                if m is None or (start, wide.end()) != out[-1][1:]:
                    out.append(("intl_email", start, wide.end()))
                    done["intl_email"] = wide.end()
        elif kind == "scheme":
            m = _USERINFO.match(text, at)
            if m:
                out.append(("userinfo", at + 3, m.end() - 1))
        elif kind in ("iban", "account"):
            m = (_IBAN if kind == "iban" else _ACCOUNT).match(text, last + 1)
            if m and m.start(1) >= done[kind]:
                end = m.end(1)
                if kind == "iban":
                    while end > m.start(1) + 15 and not iban_ok(text[m.start(1) : end]):
                        end -= 1
                if kind == "account" or iban_ok(text[m.start(1) : end]):
                    out.append((kind, m.start(1), end))
                    done[kind] = end
        elif at >= done[kind]:
            if kind == "ip":
                while at > done["ip"] and text[at - 1] in "0123456789":
                    at -= 1
                m = _IP.match(text, at)
                if m:
                    done["ip"] = m.end()
                    if all(_byte_part(p) for p in m.groups()):
                        out.append(("ip", at, m.end()))
            elif kind == "card":
                m = _CARD.match(text, at)
                done["card"] = m.end()
                if m.end() - at >= 12:
                    d = _digits(m.group())
                    if 12 <= len(d) <= 19 and luhn(d):
                        out.append(("card", at, m.end()))
            else:
                m = _PHONE.match(text, at)
                if m:
                    done["phone"] = m.end()
                    if 9 <= len(_digits(m.group())) <= 15:
                        out.append(("phone", at, m.end()))
    out.sort(key=lambda x: (x[1], _RANK[x[0]]))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, their digest, all spans. No shuffle."""

    def start():
        auto = automaton()

        def row(doc_id: int | None, text: str | None) -> Iterator[tuple]:
            spans = find(text, auto)
            base = [s for s in spans if s[0] in BASE_KINDS]
            counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
            yield (doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

        return row

    return map_rows(pick(docs, "doc_id", "text"), start, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str | None, auto: ahocorasick.Automaton, mask: str = "[{}]") -> str:
    """The text with each found span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in find(text, auto):
        if a >= at:
            out += [text[at:a], mask.format(kind)]
        at = max(at, b)
    return "".join(out) + (text or "")[at:]
