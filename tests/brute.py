"""Plain Python versions of the span rules, for small fixtures."""

from __future__ import annotations

import ipaddress
import re

EMAIL = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
IP = re.compile(
    r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){2,7}(?::[0-9A-Fa-f]{1,4}){0,7}"
    r"|[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){1,7}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}"
)
MAC = re.compile(r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}")
MOBILE = re.compile(r"1[3-9][0-9]{9}")
CARD = re.compile(r"[0-9]{15,19}")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "35", "62", "60", "81", "88", "65")
RANK = {"id_card": 0, "credit_code": 1, "bank_card": 2, "mac_address": 3, "ip_address": 4, "private_phone": 5, "private_email": 6}


def alnum(c: str) -> bool:
    return c.isascii() and c.isalnum()


def alone(text: str, m: re.Match, bad=alnum) -> bool:
    before, after = text[: m.start()][-1:], text[m.end() :][:1]
    return not (before and bad(before)) and not (after and bad(after))


def luhn(word: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(word)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


V4_SPECIAL = [
    ipaddress.ip_network(n)
    for n in (
        "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
        "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
        "224.0.0.0/4", "240.0.0.0/4",
    )
]
V6_SPECIAL = [
    ipaddress.ip_network(n)
    for n in (
        "ff00::/8", "fc00::/7", "fe80::/10", "100::/64", "64:ff9b:1::/48", "2001::/23", "2001:db8::/32", "2002::/16",
        "3fff::/20", "5f00::/16",
    )
]


def public(word: str) -> bool:
    try:
        address = ipaddress.ip_address(word)
    except ValueError:
        return False
    if address.version == 6:
        if int(address) >> 32 in (0, 0xFFFF):
            address = ipaddress.ip_address(int(address) & 0xFFFFFFFF)
        else:
            return not any(address in n for n in V6_SPECIAL)
    return not any(address in n for n in V4_SPECIAL)


def dotted(c: str) -> bool:
    return c == "." or (c.isascii() and c.isdigit())


def found(text: str) -> list[tuple[str, int, int]]:
    """(category, start, end) in characters, after arbitration; without ID card and credit code."""
    hits = [("private_email", m) for m in EMAIL.finditer(text)]
    hits += [("private_phone", m) for m in MOBILE.finditer(text) if alone(text, m)]
    hits += [
        ("bank_card", m)
        for m in CARD.finditer(text)
        if alone(text, m) and m.group().startswith(ISSUERS) and luhn(m.group())
    ]
    hits += [("mac_address", m) for m in MAC.finditer(text) if alone(text, m)]
    hits += [
        ("ip_address", m)
        for m in IP.finditer(text)
        if alone(text, m, dotted if "." in m.group() else alnum) and public(m.group())
    ]
    spans = sorted((RANK[g], m.start(), m.end(), g) for g, m in hits)
    kept: list[tuple[str, int, int]] = []
    for _, s, e, g in spans:
        if not any(s < b and a < e for _, a, b in kept):
            kept.append((g, s, e))
    return sorted(kept, key=lambda h: h[1:])
