"""The registered queries again, as SQL for DuckDB, written from the definitions and without this package's expressions.

Patterns are the plain ones; offsets come from split and extract lists; overlap rules are NOT EXISTS tests on span rows;
texts are cut by characters and turned into byte offsets at the end.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# The patterns of the recognizers, the alphabet and weights of check digits, card issuers, special networks.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
MOBILE = r"1[3-9][0-9]{9}"
ID_CARD = r"[1-9][0-9]{5}(?:18|19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]"
CREDIT = r"[0-9A-HJ-NPQRTUWXY]{2}[0-9]{6}[0-9A-HJ-NPQRTUWXY]{10}"
CARD = r"[0-9]{15,19}"
MAC = r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}"
IP = (
    r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){2,7}(?::[0-9A-Fa-f]{1,4}){0,7}"
    r"|[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){1,7}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}"
)

ALONE = "NOT (regexp_matches(before, '[0-9A-Za-z]') OR regexp_matches(after, '[0-9A-Za-z]'))"
ALONE_DOTTED = "NOT (regexp_matches(before, '[0-9.]') OR regexp_matches(after, '[0-9.]'))"

CREDIT_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def luhn(w: str) -> str:
    digit = f"CAST(substr(reverse({w}), i, 1) AS INTEGER)"
    return (
        f"(regexp_full_match({w}, '[0-9]+') AND list_sum(list_transform(range(1, length({w}) + 1), lambda i:"
        f" CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0)"
    )


ISSUER = "regexp_matches({w}, '^(4|51|52|53|54|55|34|37|35|62|60|81|88|65)')"


def id_ok(w: str) -> str:
    return (
        f"(upper(substr({w}, 18, 1)) = substr('10X98765432', CAST(list_sum(list_transform(range(1, 18), lambda i:"
        f" CAST(substr({w}, i, 1) AS INTEGER) * [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2][i])) AS INTEGER) % 11 + 1, 1))"
    )


def credit_ok(w: str) -> str:
    total = (
        f"CAST(list_sum(list_transform(range(1, 18), lambda i: (strpos('{CREDIT_ALPHABET}', substr({w}, i, 1)) - 1)"
        f" * [1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28][i])) AS INTEGER)"
    )
    return f"(substr({w}, 18, 1) = substr('{CREDIT_ALPHABET}', (31 - {total} % 31) % 31 + 1, 1))"


def v4_ok(w: str) -> str:
    """Address as one number against the special-purpose networks."""
    o = [f"CAST(split_part({w}, '.', {k}) AS BIGINT)" for k in range(1, 5)]
    number = f"({o[0]} * 16777216 + {o[1]} * 65536 + {o[2]} * 256 + {o[3]})"
    nets = [
        ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
        ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
        ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
    ]
    inside = []
    for base, bits in nets:
        a, b, c, e = map(int, base.split("."))
        size = 1 << (32 - bits)
        inside.append(f"{number} // {size} = {(a << 24 | b << 16 | c << 8 | e) // size}")
    return (
        f"CASE WHEN regexp_full_match({w}, '((0|[1-9][0-9]{{0,2}})\\.){{3}}(0|[1-9][0-9]{{0,2}})')"
        f" AND {' AND '.join(f'{x} <= 255' for x in o)} THEN NOT ({' OR '.join(inside)}) ELSE false END"
    )


def candidates(name: str, source: str, key: str, text: str, pattern: str) -> str:
    """CTE: all matches with character and byte range and neighbours."""
    return f"""{name} AS MATERIALIZED (
  SELECT k, i, m[i] AS word, length(pre) AS cs, length(pre) + length(m[i]) AS ce,
         CAST(strlen(pre) AS INTEGER) AS bs, CAST(strlen(pre) + strlen(m[i]) AS INTEGER) AS be,
         right(pre, 1) AS before, left(g[i + 1] || coalesce(m[i + 1], ''), 1) AS after
  FROM (SELECT k, m, g, i,
               array_to_string(list_transform(range(1, i), lambda j: g[j] || m[j]), '') || g[i] AS pre
        FROM (SELECT {key} AS k, regexp_extract_all({text}, {q(pattern)}) AS m,
                     string_split_regex({text}, {q(pattern)}) AS g FROM {source}) x,
             unnest(range(1, len(m) + 1)) AS u(i)) y)"""


def recognizers(source: str, key: str, text: str) -> list[str]:
    """CTEs c_*, then det(k, grp, rank, score, cs, ce, bs, be, word) and acc (arbitrated)."""
    parts = [
        candidates(f"c_{n}", source, key, text, p)
        for n, p in dict(email=EMAIL, mobile=MOBILE, id=ID_CARD, credit=CREDIT, card=CARD, mac=MAC, ip=IP).items()
    ]
    pick = "SELECT k, '{g}' AS grp, {r} AS rank, 1.0::DOUBLE AS score, cs, ce, bs, be, word FROM {c} WHERE {w}"
    unions = [
        pick.format(g="id_card", r=0, c="c_id", w=f"{ALONE} AND {id_ok('word')}"),
        pick.format(g="credit_code", r=1, c="c_credit", w=f"{ALONE} AND {credit_ok('word')}"),
        pick.format(g="bank_card", r=2, c="c_card", w=f"{ALONE} AND {ISSUER.format(w='word')} AND {luhn('word')}"),
        pick.format(g="mac_address", r=3, c="c_mac", w=ALONE),
        # No IPv6 text occurs in these tables as a public address; ipv6_public checks that test on its own.
        pick.format(g="ip_address", r=4, c="c_ip", w=f"{ALONE_DOTTED} AND contains(word, '.') AND {v4_ok('word')}"),
        pick.format(g="private_phone", r=5, c="c_mobile", w=ALONE),
        pick.format(g="private_email", r=6, c="c_email", w="true"),
    ]
    parts.append("det AS MATERIALIZED (" + "\nUNION ALL ".join(unions) + ")")
    parts.append("acc0 AS MATERIALIZED (SELECT * FROM det WHERE rank = 0)")
    for r in range(1, 7):
        parts.append(
            f"acc{r} AS MATERIALIZED (SELECT * FROM acc{r - 1} UNION ALL SELECT d.* FROM det d WHERE rank = {r} AND NOT EXISTS"
            f" (SELECT 1 FROM acc{r - 1} a WHERE a.k = d.k AND a.cs < d.ce AND d.cs < a.ce))"
        )
    return parts


def select(parts: list[str], final: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + final


DOCS = "(SELECT doc_id, text FROM documents)"
HIT_COLUMNS = "grp AS entity_group, score, bs AS \"start\", be AS \"end\", word"

SCORER = [
    ("private_phone", 0.93, r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("secret", 0.97, r"[0-9a-f]{32}"),
    ("private_person", 0.86, r"[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+"),
    ("account_number", 0.91, r"[0-9]{10,12}"),
    ("private_address", 0.72, r"[A-Z_]{6,}"),
    ("private_date", 0.9, r"Version [0-9]\.[0-9]"),
    ("private_url", 0.95, r"example\.com"),
]
CLOSED = "('bank_card', 'credit_code', 'id_card', 'ip_address', 'mac_address', 'private_email')"
REGISTERED = [  # rule order: priority descending, then id
    ("GNU General Public License", "secret"),
    ("THEDNT", "private_address"),
    ("mail3.example.com", "private_url"),
]
CRED = "('secret', 'private_email', 'private_url')"
TOKEN = r"[A-Za-z0-9_\-.@%+~]"
CRED_TOKEN = r"[A-Za-z0-9_\-.@%+~/:=?&#!$\^*|]"


def scorer_parts() -> list[str]:
    parts = [candidates(f"s_{n}", DOCS, "doc_id", "text", p) for n, (_, _, p) in enumerate(SCORER)]
    unions = [
        f"SELECT k, '{g}' AS grp, {s}::DOUBLE AS score, {n} AS entry, cs, ce, bs, be, word FROM s_{n}"
        for n, (g, s, _) in enumerate(SCORER)
    ]
    parts.append("scored AS MATERIALIZED (" + " UNION ALL ".join(unions) + ")")
    return parts


def literal_rows(name: str, source: str, key: str, text: str, needle: str, fold: bool) -> str:
    """CTE: non-overlapping occurrences of a literal that cannot overlap itself."""
    t, n = (f"lower({text})", f"lower({q(needle)})") if fold else (text, q(needle))
    return f"""{name} AS MATERIALIZED (
  SELECT k, i, cs, cs + length({q(needle)}) AS ce, substr(txt, cs + 1, length({q(needle)})) AS word,
         CAST(strlen(substr(txt, 1, cs)) AS INTEGER) AS bs,
         CAST(strlen(substr(txt, 1, cs + length({q(needle)}))) AS INTEGER) AS be
  FROM (SELECT k, txt, i, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) AS BIGINT)
                      + (i - 1) * length({q(needle)}) AS cs
        FROM (SELECT {key} AS k, {text} AS txt, string_split({t}, {n}) AS g FROM {source}) x,
             unnest(range(1, len(g))) AS u(i)) y)"""


def registered_parts() -> list[str]:
    parts = [literal_rows(f"r_{n}", DOCS, "doc_id", "text", t, True) for n, (t, _) in enumerate(REGISTERED)]
    unions = [
        f"SELECT k, '{g}' AS grp, 1.0::DOUBLE AS score, {n} AS entry, cs, ce, bs, be, word FROM r_{n}"
        for n, (_, g) in enumerate(REGISTERED)
    ]
    parts.append("registered AS MATERIALIZED (" + " UNION ALL ".join(unions) + ")")
    return parts


def combined_parts() -> list[str]:
    return [
        *recognizers(DOCS, "doc_id", "text"),
        *scorer_parts(),
        f"""combined AS MATERIALIZED (
  SELECT k, grp, score, cs, ce, bs, be, word, 0 AS certain, entry FROM scored s
  WHERE grp NOT IN {CLOSED}
    AND NOT EXISTS (SELECT 1 FROM acc6 a WHERE a.k = s.k AND a.grp = s.grp AND a.cs < s.ce AND s.cs < a.ce)
  UNION ALL SELECT k, grp, score, cs, ce, bs, be, word, 1, 0 FROM acc6)""",
    ]


def evaluate(grp: str, score: str, word: str) -> tuple[str, str, str]:
    """CASE texts for rule id, action and priority under the demonstration policy."""
    rules = [
        ("operator.1", "redact", 1000, f"lower({word}) = lower('GNU General Public License')"),
        ("operator.4", "redact", 1000, f"lower({word}) = lower('THEDNT')"),
        ("operator.2", "release", 500, f"lower({word}) = 'mail3.example.com'"),
        ("console.release.mail", "release", 300,
         f"{grp} = 'private_email' AND (contains(lower({word}), 'mail2') OR contains(lower({word}), 'mail5'))"),
        ("console.redact.shout", "redact", 150, f"{grp} = 'private_address' AND contains({word}, 'OU')"),
    ]
    rules += builtin_rules(grp, score, word)
    ids = " ".join(f"WHEN {c} THEN '{i}'" for i, _, _, c in rules)
    acts = " ".join(f"WHEN {c} THEN '{a}'" for _, a, _, c in rules)
    prio = " ".join(f"WHEN {c} THEN {p}" for _, _, p, c in rules)
    return f"CASE {ids} END", f"CASE {acts} ELSE 'release' END", f"CAST(CASE {prio} ELSE -2147483648 END AS INTEGER)"


def builtin_rules(grp: str, score: str, word: str) -> list[tuple[str, str, int, str]]:
    longer = {"account_number": 3, "private_address": 4, "private_person": 4, "private_phone": 6, "private_url": 4, "secret": 7}
    rules = []
    for g in (
        "account_number", "bank_card", "credit_code", "id_card", "ip_address", "mac_address", "private_address",
        "private_email", "private_person", "private_phone", "private_url", "secret",
    ):
        test = f"{grp} = '{g}'"
        if g in longer:
            test += f" AND {score} > 0.8 AND length({word}) > {longer[g]}"
        rules.append((f"builtin.redact.{g}", "redact", 100, test))
    return rules


def strict_builtin(grp: str, score: str, word: str) -> tuple[str, str]:
    rules = builtin_rules(grp, score, word)
    ids = " ".join(f"WHEN {c} THEN '{i}'" for i, _, _, c in rules)
    return f"CASE {ids} END", "'redact'"


RULE, ACTION, PRIORITY = evaluate("grp", "score", "word")
KNOWN = "('gnu general public license', 'thednt', 'mail3.example.com', 'apache')"


def grown(hits: str, known: str, columns: str) -> str:
    """SELECT: hits trimmed and completed to (ws, we), with their text ``txt`` and new ``w``."""
    return f"""
  SELECT {columns}, txt, cs, ce, ws, we, substr(txt, ws + 1, we - ws) AS w
  FROM (SELECT *, CASE WHEN {known} THEN ts ELSE ts - length(CASE WHEN grp IN {CRED}
                    THEN regexp_extract(substr(txt, 1, ts), {q(CRED_TOKEN + '*$')})
                    ELSE regexp_extract(substr(txt, 1, ts), {q(TOKEN + '*$')}) END) END AS ws,
               CASE WHEN {known} THEN te ELSE te + length(CASE WHEN grp IN {CRED}
                    THEN regexp_extract(substr(txt, te + 1), {q('^' + CRED_TOKEN + '*')})
                    ELSE regexp_extract(substr(txt, te + 1), {q('^' + TOKEN + '*')}) END) END AS we
        FROM (SELECT h.*, d.text AS txt,
                     cs + (length(word) - length(ltrim(word, e' \\t\\n\\r'))) AS ts,
                     ce - (length(word) - length(rtrim(word, e' \\t\\n\\r'))) AS te,
                     trim(word, e' \\t\\n\\r') AS tw
              FROM {hits} h JOIN documents d ON d.doc_id = h.k) a) b"""


def decided_parts() -> list[str]:
    rule, action, priority = evaluate("grp", "score", "w")
    return [
        *combined_parts(),
        *registered_parts(),
        """ordered AS MATERIALIZED (
  SELECT k, grp, score, cs, ce, word,
         row_number() OVER (PARTITION BY k ORDER BY late, p1, p2, certain, entry, p3) AS ord
  FROM (SELECT k, grp, score, cs, ce, word, 0 AS late, cs AS p1, ce AS p2, certain, entry, 0 AS p3 FROM combined
        UNION ALL SELECT k, grp, score, cs, ce, word, 1, 0, 0, 0, entry, cs FROM registered) z)""",
        f"""decided AS MATERIALIZED (
  SELECT k, grp, score, ws AS s, we AS e, w, ord, {rule} AS rule, {action} AS action, {priority} AS priority
  FROM ({grown('ordered', f'lower(tw) IN {KNOWN}', 'k, grp, score, ord')}) c)""",
    ]


def final_parts() -> list[str]:
    return [
        *decided_parts(),
        f"""confirmed AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, w ORDER BY ord) AS nth FROM decided
                 WHERE action = 'redact' AND grp IN {CRED} AND w <> '') c WHERE nth = 1)""",
        f"""found AS MATERIALIZED (
  SELECT k, grp, score, rule, action, priority, ord, txt, os,
         os - length(regexp_extract(substr(txt, 1, os), {q(CRED_TOKEN + '*$')})) AS s,
         os + length(w) + length(regexp_extract(substr(txt, os + length(w) + 1), {q('^' + CRED_TOKEN + '*')})) AS e
  FROM (SELECT c.*, txt, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) AS BIGINT) + (i - 1) * length(w) AS os
        FROM (SELECT c.*, d.text AS txt, string_split(d.text, c.w) AS g FROM confirmed c JOIN documents d ON d.doc_id = c.k) c,
             unnest(range(1, len(g))) AS u(i)) y)""",
        """free AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord, os) AS pos FROM found f
  WHERE NOT EXISTS (SELECT 1 FROM decided d WHERE d.k = f.k AND d.action = 'redact' AND d.s <= f.s AND d.e >= f.e))""",
        """spread AS MATERIALIZED (
  SELECT * FROM decided
  UNION ALL
  SELECT k, grp, score, s, e, substr(txt, s + 1, e - s), 1000000 + pos, rule, action, priority FROM free f
  WHERE NOT EXISTS (SELECT 1 FROM free p WHERE p.k = f.k AND p.pos < f.pos AND p.s <= f.s AND p.e >= f.e))""",
        """survivors AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, e, ord) - 1 AS nth FROM spread x
  WHERE rule IS NULL OR NOT EXISTS (
    SELECT 1 FROM spread y WHERE y.k = x.k AND y.rule IS NOT NULL AND y.action <> x.action AND y.priority > x.priority
                             AND y.s < x.e AND x.s < y.e))""",
        """final AS MATERIALIZED (
  SELECT f.*, CAST(strlen(substr(d.text, 1, s)) AS INTEGER) AS bs, CAST(strlen(substr(d.text, 1, e)) AS INTEGER) AS be
  FROM survivors f JOIN documents d ON d.doc_id = f.k)""",
    ]


SPAN = (
    "grp AS entity_group, score, bs AS byte_start, be AS byte_end, w AS original_text, action,"
    " rule AS matched_rule_id, priority"
)


def range_parts() -> list[str]:
    return [
        *final_parts(),
        """islands AS MATERIALIZED (
  SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY nth ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY k ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                       THEN 0 ELSE 1 END AS opens
        FROM final WHERE action = 'redact') o)""",
        """ranges AS MATERIALIZED (
  SELECT k, island, min(s) AS s, max(e) AS e, min(bs) AS bs, max(be) AS be, arg_min(grp, nth) AS grp
  FROM islands GROUP BY k, island)""",
        """redacted AS MATERIALIZED (
  SELECT d.doc_id AS k, d.text,
         CASE WHEN r.k IS NULL THEN d.text ELSE r.body || substr(d.text, r.last + 1) END AS out
  FROM documents d LEFT JOIN (
    SELECT r.k, max(r.e) AS last,
           string_agg(substr(d.text, r.prev + 1, r.s - r.prev) || '<redacted_' || r.grp || '>', '' ORDER BY r.s) AS body
    FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s), 0) AS prev FROM ranges) r
    JOIN documents d ON d.doc_id = r.k GROUP BY r.k) r ON r.k = d.doc_id)""",
    ]


def pool_parts() -> list[str]:
    return [
        *range_parts(),
        """fragments AS MATERIALIZED (
  SELECT 'f' || d.doc_id AS id, 'req-' || (d.doc_id % 97) AS request_id,
         ['openai_responses', 'openai_chat', 'anthropic_messages'][d.doc_id % 3 + 1] AS api_format, d.source AS path,
         sha256(d.text) AS content_hash, d.text AS original_text, r.out AS redacted_text,
         1700000000000 + d.doc_id * 1000 AS created_at
  FROM documents d JOIN redacted r ON r.k = d.doc_id WHERE d.doc_id IN (SELECT k FROM final))""",
        """spans AS MATERIALIZED (
  SELECT 'f' || k || ':' || nth AS id, 'f' || k AS fragment_id, grp AS entity_group, score,
         CAST(length(w) AS INTEGER) AS char_len, bs AS byte_start, be AS byte_end, w AS original_text, action,
         rule AS matched_rule_id, 1700000000000 + k * 1000 AS created_at, k * 16777216 + nth AS seq FROM final)""",
    ]


def summary_parts() -> list[str]:
    return [
        *pool_parts(),
        """summary AS MATERIALIZED (
  SELECT original_text, count(*) AS occurrences, count(DISTINCT fragment_id) AS turns,
         CAST(sum(CASE WHEN action = 'release' THEN 1 ELSE 0 END) AS BIGINT) AS released,
         CAST(sum(CASE WHEN action = 'redact' THEN 1 ELSE 0 END) AS BIGINT) AS redacted,
         min(score) AS score_min, max(score) AS score_max, min(created_at) AS first_seen, max(created_at) AS last_seen,
         arg_max(id, seq) AS anchor_span_id, arg_max(action, seq) AS latest_action
  FROM spans GROUP BY original_text)""",
        """evidence AS MATERIALIZED (
  SELECT original_text, CAST(row_number() OVER (PARTITION BY original_text ORDER BY n DESC, entity_group) - 1 AS INTEGER) AS place,
         entity_group, n FROM (SELECT original_text, entity_group, count(*) AS n FROM spans GROUP BY ALL) e)""",
        """rules AS MATERIALIZED (
  SELECT * FROM (VALUES
    ('operator.1', 'approval.redact', 1000, 'redact', true, 'approval', 'secret', 'GNU General Public License'),
    ('operator.2', 'approval.release', 500, 'release', true, 'approval', 'private_url', 'mail3.example.com'),
    ('operator.3', 'approval.release', 500, 'release', false, 'approval', 'secret', 'Apache'),
    ('operator.4', 'approval.redact', 1000, 'redact', true, 'approval', 'private_address', 'THEDNT'))
    AS t(id, name, priority, action, enabled, source, category, keyword))""",
    ]


# ---------------------------------------------------------------------------------------------------------------
# Recognizers
# ---------------------------------------------------------------------------------------------------------------

_hits = "SELECT k AS doc_id, " + HIT_COLUMNS + " FROM {t}"

ORACLES["email_spans"] = select(
    [candidates("c", DOCS, "doc_id", "text", EMAIL)],
    'SELECT k AS doc_id, \'private_email\' AS entity_group, 1.0::DOUBLE AS score, bs AS "start", be AS "end", word FROM c',
)
ORACLES["page_spans"] = select(
    recognizers("pages", "page_id", "html"), f"SELECT k AS page_id, {HIT_COLUMNS} FROM acc6"
)
ORACLES["bank_card_spans"] = select(
    [candidates("c", DOCS, "doc_id", "text", CARD)],
    "SELECT k AS doc_id, 'bank_card' AS entity_group, 1.0::DOUBLE AS score, bs AS \"start\", be AS \"end\", word FROM c"
    f" WHERE {ALONE} AND {ISSUER.format(w='word')} AND {luhn('word')}",
)
ORACLES["ip_spans"] = select(
    [candidates("c", DOCS, "doc_id", "text", IP)],
    "SELECT k AS doc_id, 'ip_address' AS entity_group, 1.0::DOUBLE AS score, bs AS \"start\", be AS \"end\", word FROM c"
    f" WHERE {ALONE_DOTTED} AND contains(word, '.') AND {v4_ok('word')}",
)
NOTES = """(SELECT c_custkey, 'Ärzte ' || c_name || ' tel 1' || (c_custkey % 10) || lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 9, '0')
  || CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE ' ' END || 'mac '
  || replace(array_to_string(list_transform(range(0, 6), lambda i: printf('%02x', (c_custkey * (i + 3) * 37) % 256)), '!'),
       '!', CASE WHEN c_custkey % 2 = 0 THEN ':' ELSE '-' END)
  || CASE WHEN c_custkey % 3 = 0 THEN 'g' ELSE '.' END AS text FROM customer)"""
for _name, _group, _pattern in (("mobile_spans", "private_phone", MOBILE), ("mac_spans", "mac_address", MAC)):
    ORACLES[_name] = select(
        [candidates("c", NOTES, "c_custkey", "text", _pattern)],
        f"SELECT k AS c_custkey, '{_group}' AS entity_group, 1.0::DOUBLE AS score, bs AS \"start\", be AS \"end\", word FROM c WHERE {ALONE}",
    )
ORACLES["id_card_check"] = f"""
SELECT o_orderkey, word, coalesce(regexp_full_match(word, {q(ID_CARD)}) AND {id_ok('word')}, false) AS valid
FROM (SELECT o_orderkey, '110105' || strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')
             || substr('10X98765432x', CAST(o_orderkey % 12 AS INTEGER) + 1, 1) AS word FROM orders) t"""
ORACLES["credit_code_check"] = f"""
SELECT c_custkey, word, regexp_full_match(word, {q(CREDIT)}) AND {credit_ok('word')} AS valid
FROM (SELECT c_custkey, '91' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') || 'MA'
             || lpad(CAST(c_custkey * 31 % 10000000 AS VARCHAR), 7, '0')
             || substr('0123456789ABCDEFGHJKLMNPQRTUWXYZ', CAST(c_custkey % 32 AS INTEGER) + 1, 1) AS word FROM customer) t"""
ID_TEXTS = """(SELECT o_orderkey, 'Ärzte 110105' || strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')
  || substr('10X98765432x', CAST(o_orderkey % 12 AS INTEGER) + 1, 1)
  || CASE o_custkey % 5 WHEN 0 THEN 'é' WHEN 1 THEN 'a' ELSE '.' END AS text FROM orders)"""
CREDIT_TEXTS = """(SELECT c_custkey, 'ñ 91' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') || 'MA' || lpad(CAST(c_custkey * 31 % 10000000 AS VARCHAR), 7, '0')
  || substr('0123456789ABCDEFGHJKLMNPQRTUWXYZ', CAST(c_custkey % 32 AS INTEGER) + 1, 1) || CASE WHEN c_custkey % 7 = 0 THEN '0' ELSE ' é' END AS text FROM customer)"""
for _name, _source, _key, _group, _pattern, _ok in (
    ("id_card_spans", ID_TEXTS, "o_orderkey", "id_card", ID_CARD, id_ok("word")),
    ("credit_code_spans", CREDIT_TEXTS, "c_custkey", "credit_code", CREDIT, credit_ok("word")),
):
    ORACLES[_name] = select(
        [candidates("c", _source, _key, "text", _pattern)],
        f"SELECT k AS {_key}, '{_group}' AS entity_group, 1.0::DOUBLE AS score, bs AS \"start\", be AS \"end\", word FROM c WHERE {ALONE} AND {_ok}",
    )
ORACLES["luhn_check"] = f"""
SELECT o_orderkey, word, {luhn('word')} AS luhn, {ISSUER.format(w='word')} AS issuer
FROM (SELECT o_orderkey, CAST(30 + o_orderkey % 70 AS VARCHAR)
             || lpad(CAST(o_orderkey * 1000003 % 100000000000000 AS VARCHAR), 14, '0') AS word FROM orders) t"""
ORACLES["ipv4_public"] = f"""
SELECT o_orderkey, word, {v4_ok('word')} AS public
FROM (SELECT o_orderkey,
        ['8', '10', '100', '127', '169', '172', '192', '198', '203', '224', '0', '255', '01'][o_orderkey % 13 + 1] || '.'
        || ['0', '18', '51', '64', '88', '168', '254', '256', '16'][o_orderkey % 9 + 1] || '.'
        || ['0', '2', '99', '100', '113', '7'][o_orderkey % 5 + 1] || '.' || (o_custkey % 300) AS word FROM orders) t"""
_v6_nets = [
    ("ff00", 8), ("fc00", 7), ("fe80", 10), ("0100:0000:0000:0000", 64), ("0064:ff9b:0001", 48), ("2001", 23),
    ("2001:0db8", 32), ("2002", 16), ("3fff", 20), ("5f00", 16),
]


def _bits(prefix: str, n: int) -> str:
    return "".join(f"{int(g, 16):016b}" for g in prefix.split(":"))[:n].ljust(n, "0")


_v6_special = " OR ".join(f"starts_with(bits, '{_bits(p, n)}')" for p, n in _v6_nets)
_v4_of_bits = " || '.' || ".join(
    f"CAST(list_sum(list_transform(range(0, 8), lambda b: CAST(substr(bits, {97 + 8 * o} + b, 1) AS BIGINT) * pow(2, 7 - b))) AS BIGINT)"
    for o in range(4)
)
ORACLES["ipv6_public"] = f"""
SELECT o_orderkey, word, coalesce(
         CASE WHEN bits IS NULL THEN false
              WHEN starts_with(bits, repeat('0', 80)) AND substr(bits, 81, 16) IN (repeat('0', 16), repeat('1', 16))
              THEN (SELECT {v4_ok('v')} FROM (SELECT {_v4_of_bits} AS v))
              ELSE NOT ({_v6_special}) END, false) AS public
FROM (SELECT o_orderkey, word,
        CASE WHEN len(grps) = 8 AND len(list_filter(grps, lambda g: NOT regexp_full_match(g, '[0-9A-Fa-f]{{1,4}}'))) = 0
             THEN array_to_string(list_transform(grps, lambda g: right(repeat('0', 16) || bin(CAST('0x' || g AS BIGINT)), 16)), '') END AS bits
      FROM (SELECT o_orderkey, word,
              CASE WHEN regexp_matches(word, ':::') OR regexp_matches(word, '::.*::') OR regexp_matches(word, '^:[^:]|[^:]:$') THEN NULL
                   WHEN contains(word, '::') THEN
                     CASE WHEN len(l) + len(r) <= 7 THEN l || list_transform(range(0, 8 - len(l) - len(r)), lambda x: '0') || r END
                   ELSE string_split(word, ':') END AS grps
            FROM (SELECT *, list_filter(string_split(split_part(word, '::', 1), ':'), lambda x: x <> '') AS l,
                            list_filter(string_split(split_part(word, '::', 2), ':'), lambda x: x <> '') AS r
                  FROM (SELECT o_orderkey,
                          ['2606:4700', '2001:db8', '2001:1ff', '2001:200', 'fe80', 'fc00:1', 'ff02', '64:ff9b', '64:ff9b:1', '100',
                           '2002:1', '3fff:fff', '3fff:1000', '5f00', ':', '0:0:0:0:0:ffff:808', '::ffff:a00'][o_orderkey % 17 + 1]
                          || ['::', ':0:0:', ':1:2:3:4:5:', ':'][o_orderkey % 4 + 1] || lower(to_hex(o_custkey)) AS word
                        FROM orders) a) b) c) d"""

# ---------------------------------------------------------------------------------------------------------------
# Merge, scorers, registrations
# ---------------------------------------------------------------------------------------------------------------

ORACLES["arbitrated_spans"] = select(recognizers(DOCS, "doc_id", "text"), _hits.format(t="acc6"))
ORACLES["scored_spans"] = select(scorer_parts(), _hits.format(t="scored"))
LEXICON = [("token", "secret", 0.9), ("Licensed under", "private_url", 0.7), ("the", "private_person", 0.3), ("ñ", "private_address", 0.5)]
ORACLES["lexicon_hits"] = select(
    [literal_rows(f"l_{n}", DOCS, "doc_id", "text", t, False) for n, (t, _, _) in enumerate(LEXICON)],
    " UNION ALL ".join(
        f"SELECT k AS doc_id, '{g}' AS entity_group, {s}::DOUBLE AS score, bs AS \"start\", be AS \"end\", word FROM l_{n}"
        for n, (_, g, s) in enumerate(LEXICON)
    ),
)
ORACLES["long_text_hits"] = ORACLES["lexicon_hits"]
ORACLES["overlapping_spans"] = select(
    [*recognizers(DOCS, "doc_id", "text"), *scorer_parts()],
    """SELECT s.k AS doc_id, s.grp AS a_entity_group, s.bs AS a_start, s.be AS a_end, a.grp AS b_entity_group, a.bs AS b_start, a.be AS b_end
       FROM scored s JOIN acc6 a ON a.k = s.k AND a.bs < s.be AND s.bs < a.be""",
)
ORACLES["combined_spans"] = select(combined_parts(), _hits.format(t="combined"))
ORACLES["registered_hits"] = select(registered_parts(), _hits.format(t="registered"))
ORACLES["registered_hits_automaton"] = ORACLES["registered_hits"]
ORACLES["category_dim"] = select(
    recognizers(DOCS, "doc_id", "text"),
    """SELECT c.entity_group, specificity, kind, count(a.k) AS hits
       FROM (VALUES ('account_number', 7, NULL), ('bank_card', 2, 'authoritative'), ('credit_code', 1, 'authoritative'),
         ('id_card', 0, 'authoritative'), ('ip_address', 4, 'authoritative'), ('mac_address', 3, 'authoritative'),
         ('private_address', 7, NULL), ('private_date', 7, NULL), ('private_email', 6, 'authoritative'),
         ('private_person', 7, NULL), ('private_phone', 5, 'additive'), ('private_url', 7, NULL), ('secret', 7, NULL))
         AS c(entity_group, specificity, kind) LEFT JOIN acc6 a ON a.grp = c.entity_group GROUP BY ALL""",
)


_IMAGES = """img AS (
  SELECT c_custkey, c_name, c_custkey % 5 > 0 AS whole, to_base64(from_hex(CASE c_custkey % 3
           WHEN 0 THEN '89504E470D0A1A0A0000000D49484452' || x || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '49454E44AE426082' END
           WHEN 1 THEN 'FFD8FFE0' || x || x || x || CASE WHEN c_custkey % 5 = 0 THEN '0000' ELSE 'FFD9' END
           ELSE '474946383961' || x || x || CASE WHEN c_custkey % 5 = 0 THEN '00' ELSE '3B' END END)) AS b
  FROM (SELECT *, lpad(to_hex(c_custkey), 16, '0') AS x FROM customer) c)"""
ORACLES["image_ranges"] = select([_IMAGES], 'SELECT c_custkey, 7 AS "start", CAST(7 + length(b) AS INTEGER) AS "end" FROM img WHERE whole')
ORACLES["image_scoring_texts"] = select(
    [_IMAGES], "SELECT c_custkey, 'é see ' || CASE WHEN whole THEN repeat(' ', length(b)) ELSE b END || ' then ' || c_name AS seen FROM img"
)


_BLANK = "[\\s\\x{A0}\\x{3000}]"
ORACLES["trimmed_hits"] = f"""
WITH t AS (SELECT doc_id, ' ' || chr(160) || chr(9) || substr(text, doc_id % 50 + 1, 10) || chr(12288) || ' é' || chr(10) AS x FROM documents),
h AS (
  SELECT doc_id, x, 0 AS nth, true AS valid, 0 AS lo, length(x) AS hi FROM t
  UNION ALL SELECT doc_id, x, 1, false, 0, 0 FROM t UNION ALL SELECT doc_id, x, 2, false, 0, 0 FROM t
  UNION ALL SELECT doc_id, x, 3, true, 2, length(x) - 3 FROM t
  UNION ALL SELECT doc_id, x, 4, false, 0, 0 FROM t UNION ALL SELECT doc_id, x, 5, true, 0, 2 FROM t),
w AS (SELECT *, substr(x, lo + 1, hi - lo) AS word FROM h),
e AS (SELECT *, CASE WHEN regexp_full_match(word, '{_BLANK}*') THEN 0 ELSE strlen(regexp_extract(word, '^{_BLANK}*')) END AS lead,
             CASE WHEN regexp_full_match(word, '{_BLANK}*') THEN 0 ELSE strlen(regexp_extract(word, '{_BLANK}*$')) END AS tail FROM w)
SELECT doc_id, nth, valid, CASE WHEN valid THEN CAST(strlen(substr(x, 1, lo)) + lead AS INTEGER) END AS "start",
       CASE WHEN valid THEN CAST(strlen(substr(x, 1, hi)) - tail AS INTEGER) END AS "end" FROM e"""


def window_parts(limit: int) -> list[str]:
    return [
        f"""sized AS MATERIALIZED (
  SELECT doc_id, text, length(text) AS n,
         CASE WHEN length(text) <= {limit} THEN greatest(length(text), 1)
              ELSE least(greatest(CAST(floor(CAST(length(text) AS DOUBLE) * {limit} / length(text) * 0.9::DOUBLE) AS BIGINT), 1), length(text)) END AS budget
  FROM documents)""",
        """cuts AS MATERIALIZED (
  SELECT doc_id, CAST(i AS INTEGER) AS win, CAST(i * step AS INTEGER) AS char_start, substr(text, i * step + 1, budget) AS chunk,
         CAST(strlen(substr(text, 1, i * step)) AS INTEGER) AS byte_start
  FROM (SELECT *, greatest(budget // 2, 1) AS step FROM sized) s,
       unnest(range(0, CASE WHEN n <= budget THEN 1 ELSE CAST(ceil((n - budget) / greatest(budget // 2, 1)) AS BIGINT) + 1 END)) AS u(i))""",
    ]


ORACLES["windows"] = select(
    window_parts(500),
    'SELECT doc_id, win AS "window", char_start, byte_start, CAST(length(chunk) AS INTEGER) AS chars FROM cuts',
)
_price = "length({t}) + 9 * (length({t}) - length(replace({t}, chr(10), '')))"
ORACLES["adaptive_windows"] = f"""
WITH RECURSIVE s AS (
  SELECT *, greatest(size // 2, 1) AS step FROM (
    SELECT doc_id, text, length(text) AS n, {_price.format(t="text")} AS price, greatest(9 * 400 * length(text) // (10 * greatest({_price.format(t="text")}, 1)), 1) AS size
    FROM documents) x),
r AS (
  SELECT doc_id, text, [0::BIGINT] AS path, 0::BIGINT AS lo, n AS hi FROM s WHERE price <= 400
  UNION ALL SELECT doc_id, text, [k], k * step, least(n, k * step + size)
  FROM s, unnest(range(0, CASE WHEN n <= size THEN 1 ELSE 1 + CAST(ceil((n - size) / step) AS BIGINT) END)) AS u(k) WHERE price > 400
), c AS (
  SELECT * FROM r
  UNION ALL SELECT doc_id, text, list_append(path, x), CASE WHEN x = 0 THEN lo ELSE lo + greatest((hi - lo) // 3, 1) END, CASE WHEN x = 0 THEN hi - greatest((hi - lo) // 3, 1) ELSE hi END
  FROM c, (VALUES (0), (1)) AS v(x) WHERE {_price.format(t="substr(text, lo + 1, hi - lo)")} > 400)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS INTEGER) AS "window", CAST(lo AS INTEGER) AS char_start,
       CAST(strlen(substr(text, 1, lo)) AS INTEGER) AS byte_start, CAST(hi - lo AS INTEGER) AS chars
FROM c WHERE {_price.format(t="substr(text, lo + 1, hi - lo)")} <= 400"""
_window_unions = " UNION ALL ".join(
    f"SELECT k, '{g}' AS grp, {s}::DOUBLE AS score, bs, be FROM w_{n}" for n, (g, s, _) in enumerate(SCORER)
)
ORACLES["window_reconcile"] = select(
    [
        *window_parts(300),
        *[candidates(f"w_{n}", "cuts", "(doc_id, byte_start)", "chunk", p) for n, (_, _, p) in enumerate(SCORER)],
        f"whits AS (SELECT k[1] AS doc_id, grp, score, bs + k[2] AS s, be + k[2] AS e FROM ({_window_unions}) x)".replace(
            "k[1]", "struct_extract(k, 1)"
        ).replace("k[2]", "struct_extract(k, 2)"),
        """marked AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY doc_id, grp ORDER BY s, e, score
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM whits)""",
        """joined AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, grp ORDER BY s, e, score ROWS UNBOUNDED PRECEDING) AS island
                     FROM marked)""",
    ],
    """SELECT doc_id, grp AS entity_group, CAST(min(s) AS INTEGER) AS "start", CAST(max(e) AS INTEGER) AS "end", max(score) AS score
       FROM joined GROUP BY doc_id, grp, island""",
)

# ---------------------------------------------------------------------------------------------------------------
# Policy
# ---------------------------------------------------------------------------------------------------------------

ORACLES["condition_match"] = """
SELECT c_custkey, lower(c_name) = 'customer#000000007' AS is_exact, c_name = 'CUSTOMER#000000007' AS is_exact_case,
       contains(c_name, 'omer#00000000') AS has_part, regexp_full_match(lower(c_name), 'c.stomer#.*1.*2.', 's') AS has_glob,
       length(c_name) > 17 AS is_long, c_acctbal / 10000 > 0.5 AS is_sure,
       (c_acctbal / 10000 < 0.1 OR regexp_matches(c_name, '9$')) AS nested, false AS none_of, true AS all_of_none
FROM customer"""
ORACLES["policy_eval"] = select(
    combined_parts(),
    f"SELECT k AS doc_id, {HIT_COLUMNS}, {ACTION} AS action, {RULE} AS matched_rule_id, {PRIORITY} AS priority FROM combined",
)
ORACLES["policy_eval_joined"] = ORACLES["policy_eval"]
ORACLES["loaded_policy"] = ORACLES["policy_eval"]
ORACLES["stored_providers"] = """
SELECT 'id' || n_nationkey AS id, n_name AS name, false AS named FROM nation UNION ALL SELECT 'id' || n_nationkey, n_name, true FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)"""
ORACLES["json_fragments"] = "SELECT p_name AS text, count(*) AS n FROM part WHERE p_partkey % 9 > 0 AND p_name <> '' GROUP BY text"
_srule, _saction = strict_builtin("grp", "score", "word")
ORACLES["policy_fallback"] = select(
    combined_parts(),
    f"SELECT grp AS entity_group, {_saction} AS action, {_srule} AS matched_rule_id, count(*) AS n FROM combined GROUP BY ALL",
)
ORACLES["policy_violations"] = """
SELECT 'rule.' || c_custkey AS id, 'missing_category' AS violation FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 14 <> 0
UNION ALL SELECT 'rule.' || c_custkey, 'empty_pattern' FROM customer WHERE c_custkey % 5 = 1
UNION ALL SELECT 'rule.' || c_custkey, 'invalid_confidence' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 3 > 0"""

# ---------------------------------------------------------------------------------------------------------------
# Redaction and pool
# ---------------------------------------------------------------------------------------------------------------

ORACLES["decided_spans"] = select(
    [
        *decided_parts(),
        """placed AS (SELECT x.*, CAST(strlen(substr(d.text, 1, s)) AS INTEGER) AS bs, CAST(strlen(substr(d.text, 1, e)) AS INTEGER) AS be
                     FROM decided x JOIN documents d ON d.doc_id = x.k)""",
    ],
    f"SELECT k AS doc_id, {SPAN} FROM placed",
)
ORACLES["final_spans"] = select(final_parts(), f"SELECT k AS doc_id, {SPAN} FROM final")
ORACLES["merged_ranges"] = select(
    range_parts(), 'SELECT k AS doc_id, bs AS "start", be AS "end", grp AS entity_group FROM ranges'
)
ORACLES["redacted_documents"] = select(
    range_parts(), "SELECT k AS doc_id, out AS payload, k IN (SELECT k FROM ranges) AS changed FROM redacted"
)


def table_rule_parts() -> list[str]:
    """The rules on single texts as a table, and every place in a document where one of their texts stands."""
    return [
        r"""decisions AS MATERIALIZED (
  SELECT 'decision.' || doc_id AS id, lower(word) AS low, doc_id % 3 = 0 AS releases,
         ['secret', 'private_person', 'private_address', 'private_date'][doc_id % 4 + 1] AS category
  FROM (SELECT doc_id, substr(text, doc_id % 40 + 1, 12 + doc_id % 3) AS word,
               row_number() OVER (PARTITION BY lower(substr(text, doc_id % 40 + 1, 12 + doc_id % 3)) ORDER BY doc_id) AS nth
        FROM documents WHERE length(text) >= 60) w WHERE nth = 1 AND regexp_matches(word, '[^\s]')
  UNION ALL SELECT 'customer.' || c_custkey || '.' || n, lower(c_name || ' ' || n), n % 2 = 0, 'account_number' FROM customer, unnest(range(1, 51)) AS u(n)
  UNION ALL SELECT 'part.' || p_partkey || '.' || n, lower(p_name || ' ' || p_brand || ' ' || n), n % 2 = 0, 'account_number' FROM part, unnest(range(1, 16)) AS u(n))""",
        # In blocks of 1,000 characters: the place of a character in a long text takes long to find.
        """blocks AS MATERIALIZED (
  SELECT doc_id AS k, b * 1000 AS base, substr(text, b * 1000 + 1, 1011) AS part
  FROM documents, unnest(range(0, length(text) // 1000 + 1)) AS u(b)),
places AS MATERIALIZED (
  SELECT k, base + i AS cs, lower(substr(part, i + 1, 12)) AS head
  FROM (SELECT k, base, part, unnest(range(0, least(1000, length(part) - 11))) AS i FROM blocks WHERE length(part) >= 12) p)""",
        """registered AS MATERIALIZED (
  SELECT k, r.category AS grp, 1.0::DOUBLE AS score, cs, cs + length(low) AS ce, substr(text, cs + 1, length(low)) AS word, r.id, r.releases
  FROM (SELECT p.k, p.cs, r.* FROM places p JOIN decisions r ON substr(r.low, 1, 12) = p.head) r JOIN documents d ON d.doc_id = r.k
  WHERE lower(substr(text, cs + 1, length(low))) = low)""",
    ]


#: The first rule on a word ``w``: a decision comes before all other rules here, of two on one text the first by priority and id.
_FIRST_DECISION = """best AS MATERIALIZED (
  SELECT low, arg_min(id, (releases, id)) AS id, min(releases) AS releases FROM decisions GROUP BY low)"""
_RULED = (
    "coalesce({p}.id, {rule})",
    "CASE WHEN {p}.id IS NULL THEN {action} WHEN {p}.releases THEN 'release' ELSE 'redact' END",
    "CAST(CASE WHEN {p}.id IS NULL THEN {priority} WHEN {p}.releases THEN 500 ELSE 1000 END AS INTEGER)",
)


def table_decided_parts() -> list[str]:
    console = [
        ("console.release.mail", "release", 300, "grp = 'private_email' AND (contains(lower(w), 'mail2') OR contains(lower(w), 'mail5'))"),
        ("console.redact.shout", "redact", 150, "grp = 'private_address' AND contains(w, 'OU')"),
        *builtin_rules("grp", "score", "w"),
    ]
    case = lambda place, end: "CASE " + " ".join(f"WHEN {r[3]} THEN {q(r[place]) if isinstance(r[place], str) else r[place]}" for r in console) + f" {end} END"
    filled = dict(p="b", rule=case(0, ""), action=case(1, "ELSE 'release'"), priority=case(2, "ELSE -2147483648"))
    rule, action, priority = (x.format(**filled) for x in _RULED)
    return [
        *combined_parts(),
        *table_rule_parts(),
        _FIRST_DECISION,
        """ordered AS MATERIALIZED (
  SELECT k, grp, score, cs, ce, word, row_number() OVER (PARTITION BY k ORDER BY late, p1, p2, certain, entry, p3, p4) AS ord
  FROM (SELECT k, grp, score, cs, ce, word, 0 AS late, cs AS p1, ce AS p2, certain, entry, '' AS p3, 0 AS p4 FROM combined
        UNION ALL SELECT k, grp, score, cs, ce, word, 1, 0, 0, 0, CASE WHEN releases THEN 1 ELSE 0 END, id, cs FROM registered) z)""",
        f"""decided AS MATERIALIZED (
  SELECT k, grp, score, ws AS s, we AS e, w, ord, {rule} AS rule, {action} AS action, {priority} AS priority
  FROM ({grown('ordered', 'lower(tw) IN (SELECT low FROM best)', 'k, grp, score, ord')}) c LEFT JOIN best b ON b.low = lower(w))""",
    ]


ORACLES["registered_table_redaction"] = select(
    [*table_decided_parts(), *final_parts()[len(decided_parts()) :], *range_parts()[len(final_parts()) :]],
    """SELECT r.k AS doc_id, out AS payload, CAST(coalesce(rel, 0) AS INTEGER) AS released, CAST(coalesce(red, 0) AS INTEGER) AS redacted
       FROM redacted r LEFT JOIN (SELECT k, count(*) FILTER (action = 'release') AS rel, count(*) FILTER (action = 'redact') AS red
                                  FROM final GROUP BY k) c ON c.k = r.k""",
)
ORACLES["registered_table_rules"] = select(
    [*table_rule_parts(), _FIRST_DECISION],
    """SELECT b.id AS matched_rule_id, CASE WHEN b.releases THEN 'release' ELSE 'redact' END AS action,
              CAST(CASE WHEN b.releases THEN 500 ELSE 1000 END AS INTEGER) AS priority, count(*) AS spans
       FROM registered r JOIN best b ON b.low = lower(r.word) GROUP BY ALL ORDER BY spans DESC, matched_rule_id LIMIT 50""",
)
ORACLES["stream_redact"] = select(
    range_parts(),
    """SELECT r.k AS doc_id, out AS redacted_text, CAST(coalesce(rel, 0) AS INTEGER) AS released, CAST(coalesce(red, 0) AS INTEGER) AS redacted
       FROM redacted r LEFT JOIN (SELECT k, count(*) FILTER (action = 'release') AS rel, count(*) FILTER (action = 'redact') AS red
                                  FROM final GROUP BY k) c ON c.k = r.k""",
)
ORACLES["redaction_counts"] = select(
    range_parts(),
    """SELECT (SELECT count(*) FROM documents) AS texts, (SELECT count(DISTINCT k) FROM ranges) AS changed,
              (SELECT count(*) FROM final WHERE action = 'release') AS released,
              (SELECT count(*) FROM final WHERE action = 'redact') AS redacted""",
)
ORACLES["pool_fragments"] = select(pool_parts(), "SELECT * FROM fragments")
ORACLES["pool_spans"] = select(pool_parts(), "SELECT * FROM spans")
ORACLES["content_summary"] = select(summary_parts(), "SELECT * FROM summary")
ORACLES["category_evidence"] = select(
    summary_parts(), 'SELECT original_text, place, entity_group, n AS "count" FROM evidence'
)
ORACLES["review_unreviewed"] = select(
    summary_parts(),
    "SELECT original_text, occurrences FROM summary WHERE original_text NOT IN (SELECT keyword FROM rules)",
)
ORACLES["review_reviewed"] = select(
    summary_parts(), "SELECT original_text, occurrences FROM summary WHERE original_text IN (SELECT keyword FROM rules)"
)
_action_of = "(SELECT r.action FROM rules r WHERE lower(r.keyword) = lower(s.original_text) ORDER BY priority DESC, id LIMIT 1)"
_id_of = _action_of.replace("r.action", "r.id", 1)
ORACLES["review_page"] = select(
    summary_parts(),
    f"""SELECT s.*, (SELECT string_agg(entity_group || '=' || n, ',' ORDER BY place) FROM evidence e WHERE e.original_text = s.original_text) AS categories,
               {_action_of} AS registered_action
        FROM (SELECT * FROM summary ORDER BY (released > 0 AND redacted > 0) DESC, occurrences DESC, last_seen DESC, original_text
              LIMIT 40 OFFSET 5) s""",
)
ORACLES["review_deep_page"] = select(
    [*summary_parts(), "queue AS MATERIALIZED (SELECT * FROM summary WHERE original_text NOT IN (SELECT keyword FROM rules))"],
    """SELECT row_number() OVER (ORDER BY (released > 0 AND redacted > 0) DESC, occurrences DESC, last_seen DESC, original_text) - 1 AS place,
              original_text, occurrences, last_seen FROM queue
       ORDER BY place LIMIT 100 OFFSET (SELECT count(*) // 2 FROM queue)""",
)
ORACLES["review_counts"] = select(
    summary_parts(),
    """SELECT count(*) AS total, 'unreviewed' AS "mode" FROM summary WHERE original_text NOT IN (SELECT keyword FROM rules)
       UNION ALL SELECT count(*), 'reviewed' FROM summary WHERE original_text IN (SELECT keyword FROM rules)
       UNION ALL SELECT count(*), 'all' FROM summary""",
)
ORACLES["unstable_texts"] = select(
    pool_parts(),
    """SELECT * FROM (
         SELECT original_text, count(*) FILTER ((action = 'release') <> (seq % 2 = 0)) AS released,
                count(*) FILTER ((action = 'redact') <> (seq % 2 = 0)) AS redacted
         FROM spans GROUP BY original_text) t WHERE released > 0 AND redacted > 0""",
)
ORACLES["registered_action"] = select(
    summary_parts(), f"SELECT original_text, {_action_of} AS registered_action FROM summary s"
)
ORACLES["operator_decisions"] = select(
    summary_parts(),
    f"SELECT original_text, {_action_of} AS registered_action, {_id_of} AS registered_rule_id FROM summary s",
)
_occurrence = """SELECT s.id AS span_id, entity_group, score, action, matched_rule_id, api_format, path, s.created_at
                 FROM spans s JOIN fragments f ON f.id = s.fragment_id WHERE s.original_text = """
ORACLES["occurrences"] = select(pool_parts(), _occurrence + "'THEDNT'")
ORACLES["occurrences_of_span"] = select(
    pool_parts(), _occurrence + "(SELECT original_text FROM spans WHERE id = 'f22:0')"
)
ORACLES["spans_of_fragment"] = select(pool_parts(), "SELECT * FROM spans WHERE fragment_id = 'f22'")
ORACLES["fragment_detail"] = select(
    pool_parts(),
    """SELECT f.id, request_id, api_format, path, redacted_text, f.created_at,
              (SELECT string_agg(s.id || '=' || s.action, ',' ORDER BY byte_start, seq) FROM spans s WHERE s.fragment_id = f.id) AS spans
       FROM fragments f WHERE f.id = (SELECT fragment_id FROM spans WHERE id = 'f22:1')""",
)
ORACLES["forgotten_rules"] = select(
    pool_parts(),
    "SELECT id, CASE WHEN matched_rule_id LIKE 'builtin.%' THEN NULL ELSE matched_rule_id END AS matched_rule_id FROM spans",
)
ORACLES["forgotten_fragments"] = select(
    pool_parts(), "SELECT id, fragment_id FROM spans WHERE created_at % 2000 = 0"
)
_BUILTIN_ROWS = ", ".join(
    f"('builtin.redact.{g}')"
    for g in (
        "account_number", "bank_card", "credit_code", "id_card", "ip_address", "mac_address", "private_address",
        "private_email", "private_person", "private_phone", "private_url", "secret",
    )
)
ORACLES["category_backfill"] = select(
    summary_parts(),
    f"""SELECT r.id, source, coalesce((SELECT entity_group FROM evidence e WHERE e.original_text = r.keyword AND place = 0), 'secret') AS category
        FROM rules r
        UNION ALL SELECT id, 'builtin', NULL FROM (VALUES {_BUILTIN_ROWS}) b(id)
        UNION ALL SELECT id, 'console', NULL FROM (VALUES ('console.redact.shout'), ('console.release.mail')) c(id)""",
)


def decision_parts() -> list[str]:
    return [
        *summary_parts(),
        """every AS MATERIALIZED (
  SELECT s.original_text, CASE WHEN redacted = 0 THEN 'redact' ELSE 'release' END AS wish, e.entity_group,
         'operator.' || sha256(s.original_text) AS new_id
  FROM summary s JOIN evidence e ON e.original_text = s.original_text AND e.place = 0)""",
        """asked AS MATERIALIZED (
  SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY lower(original_text) ORDER BY new_id DESC) = 1)""",
        """met AS MATERIALIZED (
  SELECT a.*, r.id, r.action, r.enabled, r.source, r.category FROM asked a JOIN rules r ON lower(r.keyword) = lower(a.original_text))""",
    ]


_other_rules = """
  SELECT id, id AS name, 100 AS priority, 'redact' AS action, true AS enabled, 'builtin' AS source, NULL AS category
  FROM (VALUES {b}) b(id)
  UNION ALL SELECT 'console.redact.shout', 'console.redact.shout', 150, 'redact', true, 'console', NULL
  UNION ALL SELECT 'console.release.mail', 'console.release.mail', 300, 'release', true, 'console', NULL
""".format(b=_BUILTIN_ROWS)
ORACLES["decisions_applied"] = select(
    decision_parts(),
    f"""{_other_rules}
    UNION ALL SELECT id, name, priority, action, enabled, source, category FROM rules
              WHERE id NOT IN (SELECT id FROM met WHERE action <> wish)
    UNION ALL SELECT id, 'approval.' || wish, CASE wish WHEN 'redact' THEN 1000 ELSE 500 END, wish, enabled, source, category
              FROM met WHERE action <> wish
    UNION ALL SELECT new_id, 'approval.' || wish, CASE wish WHEN 'redact' THEN 1000 ELSE 500 END, wish, true, 'approval', entity_group
              FROM asked WHERE original_text NOT IN (SELECT original_text FROM met)""",
)
ORACLES["decision_outcome"] = select(
    decision_parts(),
    """SELECT e.original_text, coalesce(m.id, a.new_id) AS rule_id, m.id IS NULL OR m.action <> m.wish AS changed
       FROM every e JOIN asked a ON lower(a.original_text) = lower(e.original_text) LEFT JOIN met m ON m.original_text = a.original_text""",
)

# ---------------------------------------------------------------------------------------------------------------
# Metrics
# ---------------------------------------------------------------------------------------------------------------

REQUESTS = """requests AS MATERIALIZED (
  SELECT 'r' || event_id AS request_id, epoch_us(ts) // 1000 AS started_at, dur AS duration_ms, dur // 3 AS inference_ms, dur // 2 AS upstream_ms,
         event_id AS seq, user_id, event_type, k, event_id % 13 = 0 AS broken
  FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS dur, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) e)"""
SAMPLES = """samples AS MATERIALIZED (
  SELECT *, k * (seq % 5) AS tokens, CASE WHEN seq % 4 = 0 THEN NULL ELSE k::DOUBLE END AS first_result_ms,
         (seq % 7)::DOUBLE AS tokenization_ms, (seq % 3)::DOUBLE AS validation_ms, (k + 1)::DOUBLE AS forward_ms,
         (seq % 11)::DOUBLE AS decoding_ms FROM requests WHERE event_type = 'click')"""
SINCE = 1_704_931_200_000


def _rank(p: str) -> str:
    return (
        f"coalesce((SELECT duration_ms FROM (SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) AS r,"
        f" count(*) OVER () AS n FROM win) t WHERE r = greatest(CAST(ceil({p} * n) AS BIGINT), 1)), 0)"
    )


def stats_columns() -> str:
    return f"""count(*) AS requests, CAST(coalesce(sum(duration_ms) // count(*), 0) AS BIGINT) AS average_ms,
  {_rank('0.5')} AS p50_ms, {_rank('0.95')} AS p95_ms, CAST(coalesce(max(duration_ms), 0) AS BIGINT) AS max_ms,
  CAST(coalesce(sum(inference_ms) // count(*), 0) AS BIGINT) AS average_inference_ms,
  CAST(coalesce(sum(upstream_ms) // count(*), 0) AS BIGINT) AS average_upstream_ms,
  CAST(coalesce(sum(CASE WHEN broken THEN 0 ELSE k END), 0) AS BIGINT) AS cached_fragments,
  CAST(coalesce(sum(CASE WHEN broken THEN 0 ELSE 100 - k END), 0) AS BIGINT) AS inferred_fragments"""


for _name, _since in (("request_stats", SINCE), ("request_stats_empty", SINCE * 2)):
    ORACLES[_name] = select(
        [REQUESTS, f"win AS MATERIALIZED (SELECT * FROM requests WHERE started_at >= {_since})"],
        f"SELECT {stats_columns()} FROM win",
    )
ORACLES["stream_stats_drained"] = select(
    [REQUESTS],
    f"""SELECT h.hour * 3600000 AS start_ms, s.* FROM (SELECT DISTINCT started_at // 3600000 AS hour FROM requests) h,
               LATERAL (WITH win AS (SELECT * FROM requests WHERE started_at // 3600000 = h.hour) SELECT {stats_columns()} FROM win) s""",
)
ORACLES["span_stats_by_group"] = select(
    pool_parts(),
    'SELECT entity_group, count(*) AS "count" FROM spans WHERE created_at >= 1700000200000 GROUP BY entity_group',
)
ORACLES["overview_statistics"] = select(
    [*pool_parts(), REQUESTS, "win AS MATERIALIZED (SELECT * FROM requests WHERE started_at >= 1700000200000)"],
    f"""SELECT *, round(CASE WHEN spans = 0 THEN 0 ELSE redacted_spans / spans END, 9) AS redacted_ratio,
               round(CASE WHEN cached_fragments + inferred_fragments = 0 THEN 0
                          ELSE cached_fragments / (cached_fragments + inferred_fragments) END, 9) AS cache_hit_ratio
        FROM (SELECT {stats_columns()} FROM win) r,
             (SELECT count(*) AS fragments FROM fragments WHERE created_at >= 1700000200000) f,
             (SELECT count(*) AS spans, count(*) FILTER (action = 'release') AS released_spans,
                     count(*) FILTER (action = 'redact') AS redacted_spans FROM spans WHERE created_at >= 1700000200000) s""",
)
_means = ", ".join(
    f"round(avg({c}) FILTER (tokens > 0), 6) AS average_{c}"
    for c in ("first_result_ms", "tokenization_ms", "validation_ms", "forward_ms", "decoding_ms")
)
ORACLES["model_summary"] = select(
    [REQUESTS, SAMPLES],
    f"""SELECT count(*) FILTER (tokens > 0) AS measured_requests, CAST(coalesce(sum(tokens) FILTER (tokens > 0), 0) AS BIGINT) AS tokens,
          round(CAST(sum(tokens) FILTER (tokens > 0) AS DOUBLE) * 1000 / sum(forward_ms) FILTER (tokens > 0), 6) AS tokens_per_second, {_means},
          round(CASE WHEN arg_max(tokens, (started_at, seq)) > 0
                     THEN arg_max(tokens, (started_at, seq)) * 1000.0 / arg_max(forward_ms, (started_at, seq)) END, 6) AS latest_tokens_per_second,
          arg_max(tokens, (started_at, seq)) AS latest_tokens, arg_max(forward_ms, (started_at, seq)) AS latest_forward_ms
        FROM samples WHERE started_at >= {SINCE}""",
)
ORACLES["sample_rates"] = select(
    [REQUESTS, SAMPLES],
    "SELECT request_id, round(CASE WHEN tokens > 0 AND forward_ms > 0 THEN tokens::DOUBLE * 1000 / forward_ms END, 6) AS tokens_per_second FROM samples",
)
ORACLES["accumulated_performance"] = select(
    [REQUESTS, SAMPLES],
    """SELECT user_id, CAST(sum(tokens) AS BIGINT) AS tokens, arg_min(first_result_ms, seq) FILTER (first_result_ms IS NOT NULL) AS first_result_ms,
              sum(tokenization_ms) AS tokenization_ms, sum(validation_ms) AS validation_ms, sum(forward_ms) AS forward_ms,
              sum(decoding_ms) AS decoding_ms FROM samples GROUP BY user_id""",
)
ORACLES["stage_times"] = """
SELECT user_id, stage, CAST(sum(next_ms - ms) AS BIGINT) AS stage_ms, count(*) AS calls
FROM (SELECT user_id, event_type AS stage, event_id % 2 AS mark, epoch_us(ts) // 1000 AS ms,
             lead(event_id % 2) OVER w AS next_mark, lead(epoch_us(ts) // 1000) OVER w AS next_ms
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id)) t
WHERE mark = 0 AND next_mark = 1 GROUP BY user_id, stage"""
ORACLES["inference_progress"] = """
SELECT user_id, count(*) FILTER (event_type = 'click') AS completed_inputs,
       CAST(coalesce(sum(CAST(json_extract(props, '$.k') AS BIGINT)) FILTER (event_type = 'click'), 0) AS BIGINT) AS completed_tokens,
       count(*) FILTER (event_type = 'view') AS completed_batches
FROM events GROUP BY user_id"""
ORACLES["new_outcomes"] = select(
    [REQUESTS],
    """SELECT request_id, started_at, duration_ms, seq FROM (
         SELECT 'u' || user_id AS request_id, started_at, duration_ms, n AS seq,
                row_number() OVER (PARTITION BY user_id ORDER BY n NULLS LAST, started_at, duration_ms) AS place
         FROM (SELECT *, CASE WHEN seq % 3 <> 1 THEN seq END AS n FROM requests)
         WHERE user_id NOT IN (SELECT user_id FROM requests WHERE seq % 40 = 0 AND seq % 3 <> 1)) t WHERE place = 1""",
)
ORACLES["attached_performance"] = select(
    [REQUESTS],
    """SELECT request_id, CASE WHEN seq % 3 = 0 THEN 's' || seq || '.2' WHEN event_type = 'click' THEN
         '{"tokens":' || (k * (seq % 5)) || ',"first_result_ms":' || (CASE WHEN seq % 4 = 0 THEN 'null' ELSE k::VARCHAR END)
         || ',"tokenization_ms":' || (seq % 7) || ',"validation_ms":' || (seq % 3) || ',"forward_ms":' || (k + 1)
         || ',"decoding_ms":' || (seq % 11) || '}' END AS model_performance_json FROM requests""",
)
ORACLES["assigned_providers"] = """
WITH p AS (SELECT 'id' || n_nationkey AS id, n_name AS name, n_nationkey % 4 <> 1 AS enabled,
                  ['openai_chat', 'anthropic_messages'][n_nationkey % 2 + 1] AS api_format FROM nation),
r AS (SELECT 'o' || o_orderkey AS request_id,
        ['openai_chat', 'anthropic_messages', 'openai_responses', NULL][o_orderkey % 4 + 1] AS api_format,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE coalesce(n_name, 'nobody') END AS provider_name
      FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 30),
j AS (SELECT r.*, n.id AS nid, n.enabled, n.api_format AS nformat,
        (SELECT id FROM p WHERE enabled AND (r.api_format IS NULL OR p.api_format = r.api_format) ORDER BY name LIMIT 1) AS usual
      FROM r LEFT JOIN p n ON n.name = r.provider_name)
SELECT request_id, api_format, provider_name, reason AS reject_reason,
       CASE WHEN reason IS NULL THEN CASE WHEN provider_name IS NULL THEN usual ELSE nid END END AS provider_id
FROM (SELECT *, CASE WHEN provider_name IS NOT NULL AND nid IS NULL THEN 'unknown_provider'
                     WHEN provider_name IS NOT NULL AND NOT enabled THEN 'disabled_provider'
                     WHEN provider_name IS NOT NULL AND api_format IS NOT NULL AND nformat <> api_format THEN 'other_format'
                     WHEN provider_name IS NULL AND usual IS NULL THEN 'no_provider' END AS reason FROM j) t"""

# ---------------------------------------------------------------------------------------------------------------
# Incremental work
# ---------------------------------------------------------------------------------------------------------------

ORACLES["scannable_turns"] = "SELECT conv_id, turn, role FROM conversations WHERE role <> 'assistant'"


def chain_cte(name: str, source: str, root: str) -> str:
    """Chain of sha256 over the place and the running sums of four numbers from the JSON [role, text] digests."""
    lanes = range(4)
    sums = ", ".join(f"s{i}" for i in lanes)
    less = ", ".join(f"s{i} - l{i}" for i in lanes)
    return f"""{name} AS (
  SELECT conv_id, turn, sha256(concat_ws(':', root, place, {sums})) AS hash,
         CASE WHEN place = 1 THEN root ELSE sha256(concat_ws(':', root, place - 1, {less})) END AS parent_hash
  FROM (SELECT *, {", ".join(f"sum(l{i}) OVER w AS s{i}" for i in lanes)}
        FROM (SELECT *, {", ".join(f"('0x' || substr(mixed, {1 + 15 * i}, 15))::BIGINT AS l{i}" for i in lanes)}
              FROM (SELECT *, sha256(place || ':' || digest) AS mixed
                    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, digest) AS place
                          FROM (SELECT conv_id, turn, {root} AS root, sha256(to_json([role, text])) AS digest FROM {source}))))
        WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)))"""


def _identity(**parameters: object) -> str:
    import hashlib

    return hashlib.sha256("\x1f".join(f"{k}={parameters[k]!r}" for k in sorted(parameters)).encode()).hexdigest()


ROOT = q(_identity(version="turn-chain-2", scorer="stand-in-1", format="conversation"))
OTHER = q(_identity(version="turn-chain-2", scorer="other", format="conversation"))
ORACLES["turn_chain"] = "WITH RECURSIVE " + chain_cte("ch", "conversations", ROOT) + " SELECT * FROM ch"
ORACLES["node_violations"] = (
    "WITH RECURSIVE "
    + chain_cte("ch", "conversations", ROOT)
    + """ SELECT violation, count(DISTINCT hash) AS nodes FROM (
            SELECT hash, CASE WHEN conv_id % 5 = 0 THEN 'parent' WHEN turn % 4 = 1 THEN 'fields'
                              WHEN turn % 4 = 2 AND (strlen(text) < 2 OR NOT starts_with(text, '??')) THEN 'offsets' END AS violation
            FROM ch JOIN conversations USING (conv_id, turn)) v WHERE violation IS NOT NULL GROUP BY violation"""
)
ORACLES["replay_split"] = (
    "WITH RECURSIVE "
    + chain_cte("ch", "conversations", ROOT)
    + """, edited AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN text || '!' ELSE text END AS text,
                             CASE WHEN conv_id % 5 = 0 THEN """
    + f"{OTHER} ELSE {ROOT} END AS root FROM conversations), "
    + chain_cte("ed", "edited", "root")
    + " SELECT conv_id, turn, hash IN (SELECT hash FROM ch WHERE turn < 2) AS already_audited FROM ed"
)
_lexicon_count = " + ".join(f"len(string_split(text, {q(t)})) - 1" for t, _, _ in LEXICON)
ORACLES["new_nodes"] = (
    "WITH RECURSIVE "
    + chain_cte("ch", "conversations", ROOT)
    + f""" SELECT DISTINCT ch.hash, ch.parent_hash, CAST({_lexicon_count} AS INTEGER) AS hits
           FROM ch JOIN conversations c USING (conv_id, turn) WHERE ch.hash NOT IN (SELECT hash FROM ch WHERE turn < 2)"""
)
ORACLES["dedup_hits"] = f"SELECT doc_id, CAST({_lexicon_count} AS INTEGER) AS hits FROM documents"
ORACLES["dedup_usage"] = """
SELECT CAST(coalesce(sum(n) FILTER (known), 0) AS BIGINT) AS cached_fragments,
       CAST(coalesce(sum(n - 1) FILTER (NOT known), 0) AS BIGINT) AS deduplicated_fragments,
       count(*) FILTER (NOT known) AS inferred_fragments
FROM (SELECT text, count(*) AS n, text IN (SELECT text FROM documents WHERE doc_id % 10 < 3) AS known
      FROM documents WHERE text <> '' GROUP BY text) t"""
ORACLES["cache_retention"] = """
SELECT key, "at", bytes FROM (
  SELECT *, sum(bytes) OVER (ORDER BY "at" DESC, key ROWS UNBOUNDED PRECEDING) AS total,
         row_number() OVER (ORDER BY "at" DESC, key) AS n
  FROM (SELECT event_type || ':' || user_id AS key, max(event_id) AS "at", arg_max(CAST(ceil(value * 10) AS BIGINT), event_id) AS bytes
        FROM events WHERE ceil(value * 10) <= 100000 GROUP BY ALL) e) t
WHERE n <= 400 AND total <= 100000"""
ORACLES["stream_new_turns"] = f"""
SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, CAST({_lexicon_count} AS INTEGER) AS hits FROM conversations c
WHERE role <> 'assistant' AND EXISTS (SELECT 1 FROM conversations u WHERE u.conv_id = c.conv_id AND u.role = 'user' AND u.turn >= c.turn)"""
ORACLES["written_pool"] = ORACLES["pool_spans"]
ORACLES["requests_since"] = select(
    [REQUESTS], "SELECT request_id, started_at FROM requests WHERE started_at >= (SELECT max(started_at) FROM requests) - 48 * 3600000"
)
ORACLES["stream_dedup"] = "SELECT DISTINCT 'u' || user_id AS request_id FROM events"

# ---------------------------------------------------------------------------------------------------------------
# Token predictions
# ---------------------------------------------------------------------------------------------------------------


def tokens_cte(name: str, shift: int = 0, scale: float = 10.0) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT vec_id // 20 AS doc_id, CAST(vec_id % 20 AS INTEGER) AS token_idx, CAST(vec_id % 20 * 3 AS INTEGER) AS s,
         CAST(vec_id % 20 * 3 + CASE WHEN vec_id % 7 = 6 THEN 0 ELSE 3 END AS INTEGER) AS e,
         list_transform(embedding[{shift + 1}:{shift + 33}], lambda x: CAST(x * {scale}::DOUBLE AS FLOAT)) AS logits FROM embeddings)"""


LABELS = "['account_number', 'private_address', 'private_date', 'private_email', 'private_person', 'private_phone', 'private_url', 'secret']"


def labelled_cte(name: str, source: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT *, CASE WHEN label_id = 0 THEN NULL ELSE {LABELS}[(label_id - 1) // 4 + 1] END AS grp,
         CASE WHEN label_id = 0 THEN 'O' ELSE ['B', 'I', 'E', 'S'][(label_id - 1) % 4 + 1] END AS mark
  FROM (SELECT doc_id, token_idx, s, e, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS label_id,
               1.0 / list_sum(list_transform(logits, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(logits) AS DOUBLE)))) AS probability
        FROM {source}) t)"""


def spans_cte(name: str, source: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT doc_id, grp AS entity_group, min(s) AS "start", max(e) AS "end", avg(probability) AS score
  FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY token_idx ROWS UNBOUNDED PRECEDING) AS span
        FROM (SELECT *, CASE WHEN grp IS NOT NULL AND (lag(grp) OVER w IS NULL OR lag(grp) OVER w <> grp OR lag(mark) OVER w IN ('E', 'S')
                                  OR mark IN ('B', 'S')) THEN 1 ELSE 0 END AS opens
              FROM {source} WHERE s < e WINDOW w AS (PARTITION BY doc_id ORDER BY token_idx)) a) b
  WHERE grp IS NOT NULL GROUP BY doc_id, span, grp)"""


ORACLES["token_labels"] = select(
    [tokens_cte("tok"), labelled_cte("lab", "tok")],
    "SELECT doc_id, token_idx, label_id, round(probability, 9) AS probability FROM lab",
)
ORACLES["label_dim"] = select(
    [tokens_cte("tok"), labelled_cte("lab", "tok")],
    f"""SELECT CAST(i AS INTEGER) AS id, g AS entity_group, b AS boundary, CASE WHEN i = 0 THEN 'O' ELSE b || '-' || g END AS label,
               b IN ('O', 'B', 'S') AS can_start, b IN ('O', 'E', 'S') AS can_end, (SELECT count(*) FROM lab WHERE label_id = i) AS tokens
        FROM (SELECT i, CASE WHEN i > 0 THEN {LABELS}[(i - 1) // 4 + 1] END AS g,
                     CASE WHEN i > 0 THEN ['B', 'I', 'E', 'S'][(i - 1) % 4 + 1] ELSE 'O' END AS b FROM range(33) t(i)) x""",
)
_starts = lambda x: f"({x} = 0 OR ({x} - 1) % 4 IN (0, 3))"
_ends = lambda x: f"({x} = 0 OR ({x} - 1) % 4 IN (2, 3))"
_may_follow = f"CASE WHEN {_ends('j')} THEN {_starts('i')} ELSE i > 0 AND (i - 1) // 4 = (j - 1) // 4 AND (i - 1) % 4 IN (1, 2) END"
#: For every label the best path that ends in it, token by token; of equal ones the lowest label before.
BEST_PATHS = f"""paths AS (
  SELECT doc_id, token_idx, list_transform(range(0, 33), lambda i:
           {{'s': CASE WHEN {_starts('i')} THEN logits[i + 1]::DOUBLE ELSE '-inf'::DOUBLE END, 'n': 0::BIGINT, 'p': [i]}}) AS best
  FROM tok WHERE token_idx = 0
  UNION ALL
  SELECT t.doc_id, t.token_idx, list_transform(
           list_transform(range(0, 33), lambda i: {{'i': i, 'm': list_max(list_transform(range(0, 33), lambda j:
             {{'s': CASE WHEN {_may_follow} THEN best[j + 1].s + logits[i + 1]::DOUBLE ELSE '-inf'::DOUBLE END, 'n': -j, 'p': best[j + 1].p}}))}}),
           lambda x: {{'s': x.m.s, 'n': 0::BIGINT, 'p': list_append(x.m.p, x.i)}})
  FROM paths JOIN tok t ON t.doc_id = paths.doc_id AND t.token_idx = paths.token_idx + 1),
chosen AS (
  SELECT doc_id, list_max(list_transform(range(0, 33), lambda i:
           {{'s': CASE WHEN {_ends('i')} THEN best[i + 1].s ELSE '-inf'::DOUBLE END, 'n': -i, 'p': best[i + 1].p}})).p AS path
  FROM paths p WHERE token_idx = (SELECT max(token_idx) FROM tok t WHERE t.doc_id = p.doc_id)),
lab AS MATERIALIZED (
  SELECT *, CASE WHEN label_id = 0 THEN NULL ELSE {LABELS}[(label_id - 1) // 4 + 1] END AS grp,
         CASE WHEN label_id = 0 THEN 'O' ELSE ['B', 'I', 'E', 'S'][(label_id - 1) % 4 + 1] END AS mark,
         exp(logits[label_id + 1]::DOUBLE - list_max(logits)::DOUBLE) / list_sum(list_transform(logits, lambda x: exp(x::DOUBLE - list_max(logits)::DOUBLE))) AS probability
  FROM (SELECT t.*, CAST(path[token_idx + 1] AS INTEGER) AS label_id FROM tok t JOIN chosen c USING (doc_id)) x)"""
ORACLES["viterbi_spans"] = (
    f"WITH RECURSIVE {tokens_cte('tok')},\n{BEST_PATHS},\n{spans_cte('sp', 'lab')}"
    ' SELECT doc_id, entity_group, "start", "end", round(score, 9) AS score FROM sp'
)
ORACLES["bioes_spans"] = select(
    [tokens_cte("tok"), labelled_cte("lab", "tok"), spans_cte("sp", "lab")],
    'SELECT doc_id, entity_group, "start", "end", round(score, 9) AS score FROM sp',
)
ORACLES["token_violations"] = select(
    [
        tokens_cte("tok"),
        """broken AS (SELECT doc_id, token_idx, CASE WHEN token_idx = 7 AND doc_id % 2 = 0 THEN 1 ELSE s END AS s, e,
                             token_idx = 3 AND doc_id % 3 = 0 AS nan FROM tok)""",
        "moved AS (SELECT CASE WHEN doc_id % 5 = 4 THEN -1 - doc_id ELSE doc_id END AS doc_id, token_idx, s, e, nan FROM broken)",
        """seen AS (SELECT *, coalesce(lag(s) OVER w, 0) AS ls, coalesce(lag(e) OVER w, 0) AS le FROM moved
                    WINDOW w AS (PARTITION BY doc_id ORDER BY token_idx))""",
    ],
    """SELECT doc_id, token_idx, violation FROM (
         SELECT t.doc_id, token_idx, CASE WHEN d.text IS NULL THEN 'no_text' WHEN nan THEN 'logits' WHEN s > e THEN 'reversed' WHEN e > strlen(d.text) THEN 'outside'
                                        WHEN s < ls OR e < le THEN 'unordered' END AS violation
         FROM seen t LEFT JOIN documents d ON d.doc_id = t.doc_id) x WHERE violation IS NOT NULL""",
)
ORACLES["prediction_compare"] = select(
    [
        tokens_cte("a"),
        tokens_cte("b", shift=1),
        """both_sides AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.logits AS x, b.logits AS y
                      FROM a FULL JOIN (SELECT * FROM b WHERE token_idx <> 5) b ON a.doc_id = b.doc_id AND a.token_idx = b.token_idx)""",
        """err AS (SELECT doc_id, x, y, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN
                     list_transform(range(1, 34), lambda i: abs(x[i] - y[i])) END AS d FROM both_sides)""",
    ],
    """SELECT doc_id, count(*) FILTER (d IS NULL) AS unmatched_tokens, round(max(list_max(d)), 4)::FLOAT AS max_error,
              round(sum(list_sum(list_transform(d, lambda v: v::DOUBLE))) / (count(d) * 33), 6) AS mean_error,
              count(*) FILTER (list_position(x, list_max(x)) <> list_position(y, list_max(y))) AS label_mismatches
       FROM err GROUP BY doc_id""",
)
ORACLES["span_compare"] = select(
    [
        tokens_cte("ta"), labelled_cte("la", "ta"), spans_cte("sa", "la"),
        tokens_cte("tb", scale=5.0), labelled_cte("lb", "tb"), spans_cte("sb", "lb"),
    ],
    """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, count(*) FILTER (b.doc_id IS NULL) AS only_actual,
              count(*) FILTER (a.doc_id IS NULL) AS only_expected, round(max(abs(a.score - b.score)), 9) AS max_score_error
       FROM sa a FULL JOIN (SELECT * FROM sb WHERE "start" % 2 = 0) b
         ON a.doc_id = b.doc_id AND a.entity_group = b.entity_group AND a."start" = b."start" AND a."end" = b."end"
       GROUP BY 1""",
)

# ---------------------------------------------------------------------------------------------------------------
# Request bodies
# ---------------------------------------------------------------------------------------------------------------


def fields_sql(prefix: str, rows: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{prefix}' || doc_id AS request_id, CAST({n} AS INTEGER) AS ordinal, '{p}' AS pointer, {t} AS text, {w} AS wrapped FROM documents"
        for n, (p, t, w) in enumerate(rows)
    )


ORACLES["collect_chat"] = fields_sql(
    "c",
    [("/messages/0/content", "lang", "false"), ("/messages/1/content/0/text", "text", "false"), ("/messages/3/content", "'no role'", "false")],
)
ORACLES["collect_messages"] = fields_sql(
    "m",
    [
        ("/system/0/text", "source", "false"),
        ("/messages/0/content/0/text", "'see below'", "false"),
        ("/messages/0/content/1/content", "text", "false"),
        ("/messages/0/content/2/content/0/text", "lang", "false"),
    ],
)
ORACLES["collect_responses"] = fields_sql(
    "o",
    [
        ("/instructions", "source", "false"),
        ("/input/1/text", "'direct'", "false"),
        ("/input/0", "'first'", "false"),
        ("/input/4/output/1/text", "text", "true"),
        ("/input/5/output", "lang", "false"),
    ],
)
ORACLES["rejected_requests"] = """
SELECT 'e' || event_id AS request_id, CASE event_id % 4 WHEN 0 THEN 'not_an_object' WHEN 2 THEN 'not_json' ELSE 'accepted' END AS reject_reason FROM events
UNION ALL
SELECT 'p' || page_id, CASE page_id % 2 WHEN 0 THEN 'not_json' ELSE 'accepted' END FROM pages"""
ORACLES["redacted_requests"] = select(
    range_parts(),
    """SELECT 'o' || r.k AS request_id, CAST(coalesce(rel, 0) AS INTEGER) AS released, CAST(coalesce(red, 0) AS INTEGER) AS redacted,
              out AS payload_text, CAST(NULL AS VARCHAR) AS rewrite_error
       FROM redacted r LEFT JOIN (SELECT k, count(*) FILTER (action = 'release') AS rel, count(*) FILTER (action = 'redact') AS red
                                  FROM final GROUP BY k) c ON c.k = r.k""",
)

# ---------------------------------------------------------------------------------------------------------------
# Back-test
# ---------------------------------------------------------------------------------------------------------------


_FOLLOWED = """
b AS (SELECT doc_id, source AS s, lang AS l, text AS t0, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS t2 FROM documents),
r AS (SELECT DISTINCT s, t0, l FROM b),
k AS (SELECT b.*, row_number() OVER (PARTITION BY s, t2, l ORDER BY doc_id) = 1 AS own2,
             EXISTS (SELECT 1 FROM r WHERE r.s IS NOT DISTINCT FROM b.s AND r.t0 IS NOT DISTINCT FROM b.t2 AND r.l IS NOT DISTINCT FROM b.l) AS kept
      FROM b),
f AS (SELECT *, own2 AND NOT kept AS own0, list_filter([s], lambda x: x IS NOT NULL) AS fs,
             list_filter(['see below', t2, l], lambda x: x IS NOT NULL) AS f0, list_filter([s, s, '', l], lambda x: x IS NOT NULL) AS f2 FROM k),
m AS (SELECT *, list_filter(CASE WHEN own0 THEN f0 ELSE [] END || CASE WHEN own2 THEN f2 ELSE [] END, lambda x: x <> '') AS missing FROM f),
u AS (SELECT *, len(fs) + CASE WHEN own0 THEN 0 ELSE len(f0) END + CASE WHEN own2 THEN 0 ELSE len(f2) END AS cached_fragments,
             len(missing) - len(list_distinct(missing)) AS deduplicated_fragments, len(list_distinct(missing)) AS inferred_fragments FROM m)"""
_hits_in = " + ".join(f"len(string_split(x, {q(t)})) - 1" for t, _, _ in LEXICON)
ORACLES["request_replay"] = f"""WITH {_FOLLOWED}
SELECT 'n' || doc_id AS request_id, cached_fragments, deduplicated_fragments, inferred_fragments,
       CAST(list_sum(list_transform(fs || f0 || f2, lambda x: {_hits_in})) AS INTEGER) AS hits,
       repeat('1', len(fs)) || repeat(CASE WHEN own0 THEN '0' ELSE '1' END, len(f0)) || repeat(CASE WHEN own2 THEN '0' ELSE '1' END, len(f2)) AS audited
FROM u"""
ORACLES["request_usage"] = f"""WITH {_FOLLOWED}
SELECT (1700000000000 + doc_id * 1000) // 3600000 AS hour, count(*) AS requests, CAST(sum(cached_fragments) AS BIGINT) AS cached_fragments,
       CAST(sum(deduplicated_fragments) AS BIGINT) AS deduplicated_fragments, CAST(sum(inferred_fragments) AS BIGINT) AS inferred_fragments
FROM u GROUP BY hour"""
_MESSAGES_ROOT = q(_identity(version="turn-chain-2", scorer="stand-in-1", format="anthropic_messages"))
_turn_text = lambda *layout: " || chr(31) || ".join(["json", " || chr(31) || ".join(f"to_json([{p}, {t}])" for p, t in layout) or "''"])
ORACLES["request_turn_hashes"] = f"""
WITH p AS (
  SELECT doc_id, '[{{"text":' || to_json(source) || '}}]' AS j0,
         '{{"content":[{{"text":"see below","type":"text"}},{{"content":' || to_json(text) || ',"type":"tool_result"}},{{"content":[{{"text":' || to_json(lang)
           || ',"type":"text"}}],"type":"tool_result"}}],"role":"user"}}' AS j1,
         '{{"content":' || to_json(text) || ',"role":"assistant"}}' AS j2, source, text, lang
  FROM documents),
h0 AS (SELECT *, sha256({_MESSAGES_ROOT} || sha256({_turn_text(("'/0/text'", "source")).replace("json", "j0", 1)})) AS a FROM p),
h1 AS (SELECT *, sha256(a || sha256({_turn_text(("'/content/0/text'", "'see below'"), ("'/content/1/content'", "text"), ("'/content/2/content/0/text'", "lang")).replace("json", "j1", 1)})) AS b FROM h0),
h2 AS (SELECT *, sha256(b || sha256({_turn_text().replace("json", "j2", 1)})) AS c FROM h1)
SELECT 'm' || doc_id AS request_id, '/system' AS path, a AS hash, {_MESSAGES_ROOT} AS parent_hash, 1::INTEGER AS fields FROM h2
UNION ALL SELECT 'm' || doc_id, '/messages/0', b, a, 3 FROM h2
UNION ALL SELECT 'm' || doc_id, '/messages/1', c, b, 0 FROM h2"""


def replay_parts() -> list[str]:
    rule, action = strict_builtin("grp", "score", "w")
    return [
        *pool_parts(),
        """latest AS MATERIALIZED (
  SELECT CAST(substr(fragment_id, 2) AS BIGINT) AS k, entity_group AS grp, score, cs, ce, word, old
  FROM (SELECT s.fragment_id, s.entity_group, s.score, s.original_text AS word, s.action AS old, f2.s AS cs, f2.e AS ce,
               row_number() OVER (PARTITION BY g.content_hash, s.byte_start, s.byte_end, s.entity_group
                                  ORDER BY s.created_at DESC, s.seq DESC) AS nth
        FROM spans s JOIN fragments g ON g.id = s.fragment_id JOIN final f2 ON 'f' || f2.k || ':' || f2.nth = s.id) x
  WHERE nth = 1)""",
        f"""judged AS MATERIALIZED (
  SELECT k, grp, old, w, txt, ws, we, row_number() OVER () AS nr, {rule} AS rule, {action} AS action, ws < cs OR we > ce AS wider
  FROM ({grown('latest', 'false', 'k, grp, score, old')}) c)""",
        # A redacted credential is spread over its text here as well; each other occurrence is one more span.
        f"""again AS MATERIALIZED (
  SELECT nr, rule, count(DISTINCT (s, e)) AS n
  FROM (SELECT j.nr, j.rule, j.ws, j.we,
               os - length(regexp_extract(substr(txt, 1, os), {q(CRED_TOKEN + '*$')})) AS s,
               os + length(w) + length(regexp_extract(substr(txt, os + length(w) + 1), {q('^' + CRED_TOKEN + '*')})) AS e
        FROM (SELECT j.*, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) AS BIGINT) + (i - 1) * length(w) AS os
              FROM (SELECT *, string_split(txt, w) AS g FROM judged WHERE grp IN {CRED} AND action = 'redact' AND w <> '') j,
                   unnest(range(1, len(g))) AS u(i)) j) y
  WHERE NOT (ws <= s AND we >= e) GROUP BY nr, rule)""",
    ]


ORACLES["policy_backtest"] = select(
    replay_parts(), "SELECT old || '->' || action AS transition, count(*) AS \"count\" FROM judged GROUP BY 1"
)
ORACLES["backtest_rules"] = select(
    replay_parts(),
    """SELECT rule AS rule_id, CAST(sum(n) AS BIGINT) AS "count"
       FROM (SELECT rule, 1 AS n FROM judged UNION ALL SELECT rule, n FROM again) x WHERE rule LIKE 'builtin.redact.private%' GROUP BY 1""",
)
ORACLES["backtest_expanded"] = select(
    replay_parts(),
    "SELECT count(*) FILTER (wider OR nr IN (SELECT nr FROM again)) AS expanded_redactions FROM judged",
)
