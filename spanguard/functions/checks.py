"""Checksum and address tests on one candidate word, as SQL boolean expression text."""

from __future__ import annotations

from spanguard.functions.sqlx import each, fold, let, lit

# GB 11643 weights and check characters.
ID_CARD_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CARD_CHECK = "10X98765432"
# GB 32100 alphabet and weights.
CREDIT_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
CREDIT_WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)
# Card number prefixes of known issuers.
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "35", "62", "60", "81", "88", "65")


def _total(terms: str) -> str:
    return fold(terms, "0", lambda a, x: f"{a} + {x}")


def _weighted(word: str, weights: tuple[int, ...], value) -> str:
    numbers = f"array({', '.join(map(str, weights))})"
    return _total(
        each(
            f"sequence(1, {len(weights)})",
            lambda i: f"{value(f'substring({word}, {i}, 1)')} * element_at({numbers}, {i})",
        )
    )


def _digit(character: str) -> str:
    return f"(ascii({character}) - 48)"


def id_card_ok(word: str) -> str:
    """18 characters: 17 digits, weighted sum mod 11 picks the last one (X in any case)."""
    remainder = f"{_weighted(word, ID_CARD_WEIGHTS, _digit)} % 11"
    return (
        f"({word} rlike {lit(r'^[0-9]{17}[0-9Xx]\z')} and"
        f" substring('{ID_CARD_CHECK}', {remainder} + 1, 1) = upper(right({word}, 1)))"
    )


def credit_code_ok(word: str) -> str:
    """18 characters of a 31-letter alphabet, weighted sum mod 31."""
    total = _weighted(word, CREDIT_WEIGHTS, lambda c: f"(instr('{CREDIT_ALPHABET}', upper({c})) - 1)")
    expected = f"substring('{CREDIT_ALPHABET}', (31 - {total} % 31) % 31 + 1, 1)"
    return (
        f"({word} rlike {lit(r'^(?i)[0-9A-HJ-NPQRTUWXY]{18}\z')} and {expected} = upper(right({word}, 1)))"
    )


def luhn_ok(word: str) -> str:
    """Digits only; from the right every second digit is doubled; the digit sum divides by ten."""

    def value(i: str) -> str:
        digit = _digit(f"substring({word}, -{i}, 1)")
        return f"if({i} % 2 = 0, {digit} * 2 - if({digit} > 4, 9, 0), {digit})"

    total = _total(each(f"sequence(1, char_length({word}))", value))
    return f"({word} rlike {lit(r'^[0-9]+\z')} and {total} % 10 = 0)"


def issuer_ok(word: str) -> str:
    return f"{word} rlike '^({'|'.join(ISSUERS)})'"


def _v4_public(a: str, b: str, c: str) -> str:
    """First three octets outside the special-purpose ranges (the fourth never matters)."""
    # Special-purpose IPv4 ranges.
    return (
        f"not ({a} in (0, 10, 127) or {a} >= 224"
        f" or ({a} = 100 and {b} between 64 and 127)"
        f" or ({a} = 169 and {b} = 254)"
        f" or ({a} = 172 and {b} between 16 and 31)"
        f" or ({a} = 192 and ({b} = 168 or ({b} = 0 and {c} in (0, 2)) or ({b} = 88 and {c} = 99)))"
        f" or ({a} = 198 and ({b} in (18, 19) or ({b} = 51 and {c} = 100)))"
        f" or ({a} = 203 and {b} = 0 and {c} = 113))"
    )


def ipv4_public(word: str) -> str:
    """A dotted quad without leading zeros, octets up to 255, in no special-purpose range."""
    octet = "(0|[1-9][0-9]{0,2})"
    shape = rf"^{octet}\.{octet}\.{octet}\.{octet}\z"

    def test(o: str) -> str:
        return (
            f"({' and '.join(f'{o}[{k}] <= 255' for k in range(4))}"
            f" and {_v4_public(f'{o}[0]', f'{o}[1]', f'{o}[2]')})"
        )

    parsed = f"transform(split({word}, {lit(r'[.]')}, -1), o -> cast(o as int))"
    return f"if({word} rlike {lit(shape)}, {let(parsed, test)}, false)"


def ipv6_segments(word: str) -> str:
    """Eight numbers of an IPv6 literal, or null if it is none ('::' stands for at least one group)."""
    def groups(side: str) -> str:
        return f"filter(split({side}, ':', -1), g -> g <> '')"

    def expand(w: str) -> str:
        left, right = groups(f"substring_index({w}, '::', 1)"), groups(f"substring_index({w}, '::', -1)")
        filled = let(
            f"array({left}, {right})",
            lambda p: f"if(size({p}[0]) + size({p}[1]) <= 7,"
            f" concat({p}[0], array_repeat('0', 8 - size({p}[0]) - size({p}[1])), {p}[1]), null)",
        )
        plain = let(f"split({w}, ':', -1)", lambda p: f"if(size({p}) = 8, {p}, null)")
        numbers = let(
            f"if(contains({w}, '::'), {filled}, {plain})",
            lambda p: f"if(forall({p}, g -> g rlike '^[0-9A-Fa-f]{{1,4}}$'),"
            f" transform({p}, g -> cast(conv(g, 16, 10) as int)), null)",
        )
        # One '::' at most and no single colon at either end.
        malformed = lit(r"::.*::|:::|^:[^:]|[^:]:\z")
        return f"if({w} rlike {malformed}, null, {numbers})"

    return expand(word)


def ipv6_public(word: str) -> str:
    """Mapped and compatible forms follow the embedded IPv4; everything else its own special-purpose ranges."""

    def test(s: str) -> str:
        high = f"({s}[0] = 0 and {s}[1] = 0 and {s}[2] = 0 and {s}[3] = 0 and {s}[4] = 0 and {s}[5] in (0, 65535))"
        embedded = _v4_public(f"({s}[6] div 256)", f"({s}[6] % 256)", f"({s}[7] div 256)")
        # Special-purpose IPv6 ranges.
        special = (
            f"({s}[0] >= 65280"  # ff00::/8
            f" or {s}[0] between 64512 and 65023"  # fc00::/7
            f" or {s}[0] between 65152 and 65215"  # fe80::/10
            f" or ({s}[0] = 256 and {s}[1] = 0 and {s}[2] = 0 and {s}[3] = 0)"  # 100::/64
            f" or ({s}[0] = 100 and {s}[1] = 65435 and {s}[2] = 1)"  # 64:ff9b:1::/48
            f" or ({s}[0] = 8193 and ({s}[1] < 512 or {s}[1] = 3512))"  # 2001::/23, 2001:db8::/32
            f" or {s}[0] = 8194"  # 2002::/16
            f" or ({s}[0] = 16383 and {s}[1] < 4096)"  # 3fff::/20
            f" or {s}[0] = 24320)"  # 5f00::/16
        )
        return f"coalesce(if({high}, {embedded}, not {special}), false)"

    return let(ipv6_segments(word), test)
