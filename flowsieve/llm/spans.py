"""Spans of a text: patterns that cannot run away on long texts, and the digest columns of the queries.

A span is (kind, start, end) in code points, end exclusive. Matches are the leftmost non-overlapping ones
of each kind; matches that fail their test are dropped without another try.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

Span = tuple[str, int, int]

# The patterns of personal data and secrets. Possessive repeats give the same matches as
# plain ones here, as what follows a repeat never starts with one of its characters.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")


def emails(text: str) -> Iterable[tuple[int, int]]:
    """Each '@' with the longest run before it that no earlier match holds; linear in the text's length."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            end, at = at + 1, text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def private_spans(text: str) -> list[Span]:
    """Email, ip, card and phone spans, in this order, then by start."""
    found: list[Span] = [("email", a, b) for a, b in emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := only_digits(m.group())) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m.group())) <= 15]
    return found


def secret_spans(text: str) -> list[Span]:
    """Assign, access and hex spans by start, then in this order."""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def row_key(id_value: object, text: str) -> bytes:
    """Tells rows apart that share an id but not the text; rows that share both share the key."""
    return hashlib.blake2b(repr(id_value).encode() + b"\0" + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
