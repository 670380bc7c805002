"""SQL of the queries over addresses, connection strings and env examples.

The fixed patterns are the same ones; offsets, overlaps, lists and exemptions are worked out anew.
"""

from __future__ import annotations

from ..functions import rules as R

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_ADDRESS = rf"{_OCTET}(\.{_OCTET}){{3}}"
#: Networks of hosts that are never on the public internet.
_RESERVED = rf"^((127|10)(\.{_OCTET}){{3}}|0\.0\.0\.0|(172\.(1[6-9]|2[0-9]|3[01])|192\.168|169\.254|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7]))(\.{_OCTET}){{2}})$"
_SCANNED = "NOT (should_skip_content OR is_changelog OR is_license OR is_detection_rule)"


def _text(pattern: str) -> str:
    """A pattern as an SQL literal; RE2 has no lookarounds, and the ones in use are word boundaries."""
    return "'" + pattern.replace(R.B, r"\b").replace(R.E, r"\b").replace("'", "''") + "'"


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _lists(item: str) -> str:
    """Files that are lists of bare items; item: a condition on the trimmed line t."""
    return f"""(SELECT project, path FROM (SELECT project, path, trim(line, ' ') AS t FROM o) WHERE t <> '' AND NOT regexp_matches(t, '^(#|;|//)')
  GROUP BY ALL HAVING count(*) >= 10 AND count(*) FILTER ({item}) * 5 >= count(*) * 4)"""


def network_scan(lines: str, category: str) -> str:
    """lines: the derived files' lines; category: the class of an address by its octets a, b, c, d and number n."""
    bare = "trim(regexp_replace(t, '[#;].*$', ''), ' ')"
    item = rf"regexp_matches({bare}, '^{_ADDRESS}(/(3[0-2]|[12]?[0-9]))?$') OR regexp_matches(t, '^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*(/[0-9]{{1,3}})?$')"
    number = lambda k: f"string_split(string_split(text, '/')[1], '.')[{k}]::BIGINT"
    return f"""{lines}, o AS (SELECT project, path, seq, line_no, is_prose, regexp_replace(line, {_text(R.SVG_GEOMETRY)}, ' ', 'g') AS line, line AS raw FROM l WHERE {_SCANNED}),
s AS (SELECT *, regexp_extract_all(line, {_text(R.IPV4)}) AS ms, string_split_regex(line, {_text(R.IPV4)}) AS gs, regexp_extract_all(line, {_text(R.CIDR)}) AS cs, regexp_extract_all(line, {_text(R.ASN)}) AS asns
  FROM o ANTI JOIN {_lists(item)} USING (project, path)),
i AS (SELECT *, unnest(ms) AS m, unnest(generate_series(1, len(ms))) AS i FROM s),
j AS (SELECT *, list_reduce(list_transform(generate_series(1, i), lambda k: gs[k] || CASE WHEN k < i THEN ms[k] ELSE '' END), lambda x, y: x || y) AS before, gs[i + 1] || coalesce(ms[i + 1], '') AS behind FROM i),
f AS (SELECT project, path, line_no, 'cidr' AS rule, unnest(cs) AS text FROM s
  UNION ALL SELECT project, path, line_no, 'ipv4', m FROM j WHERE len(list_filter(cs, lambda c: starts_with(c, m || '/'))) = 0 AND NOT regexp_matches(lower(right(before, 24)), {_text(R.VERSION_CONTEXT)}) AND NOT regexp_matches(behind, '^\\.[0-9]')),
v AS (SELECT *, {", ".join(f"{number(k + 1)} AS {n}" for k, n in enumerate("abcd"))}, ((a * 256 + b) * 256 + c) * 256 + d AS n FROM f WHERE regexp_matches(text, '^{_ADDRESS}(/|$)')),
k AS (SELECT project, path, line_no, rule, text, {category} AS category FROM v
  UNION ALL SELECT project, path, line_no, 'asn', text, 'asn' FROM (SELECT *, unnest(asns) AS text FROM s WHERE NOT is_prose) WHERE text[3:]::BIGINT > 0)
SELECT *, CASE category WHEN 'public' THEN 'warning' ELSE 'info' END AS severity FROM k WHERE category NOT IN ('doc-range', 'loopback', 'unspecified')"""


def _host_exempt(rest: str) -> str:
    host = f"lower(regexp_extract({rest}, '^[^/:?#]*'))"
    spec = "|".join(h.replace(".", r"\.") for h in R.SPEC_HOSTS)
    return (
        f"(NOT contains({host}, '.') OR {host} IN ('example.com') OR regexp_matches({host}, '{_RESERVED}') OR regexp_matches({host}, '\\.(example\\.com|test|localhost|invalid|local|internal)$')"
        f" OR regexp_matches({host}, '(^|\\.)({spec})$'))"
    )


_CREDENTIALS = r"(?s)^((?:\$\{[^}]*\}|\{\{.*?\}\}|[^:@])*):((?:\$\{[^}]*\}|\{\{.*?\}\}|[^@])*)@(.*)$"


def _non_secret() -> str:
    """A condition on user, secret and host of a URL."""
    prefix, noun = "|".join(R.PLACEHOLDER_PREFIXES), "|".join(R.PLACEHOLDER_NOUNS)
    structural = lambda c: f"({c} <> '' AND (length({c}) <= 2 OR regexp_matches({c}, {_text(R.REGEX_SYNTAX)})))"
    default = _in(R.DEFAULT_CREDENTIALS)
    return f"""(regexp_matches(secret, {_text(R.TEMPLATE_TOKEN)}) OR (lower(creds) IN {default} AND lower(secret) IN {default}) OR (creds <> '' AND lower(creds) = lower(secret) AND {_host_exempt("host")})
  OR {structural("creds")} OR {structural("secret")} OR (secret <> '' AND (regexp_matches(lower(secret), {_text(R.PLACEHOLDER_WORD)}) OR regexp_matches(lower(secret), '^({prefix})($|[_.-]|({noun})$)')
  OR (regexp_matches(secret, '[_-]') AND secret = upper(secret) AND NOT regexp_matches(secret, '[a-z]')))))"""


def connection_strings(lines: str) -> str:
    values = ", ".join(f"({k}, '{n}', '{s}', {_text(p)})" for k, (n, s, p) in enumerate(R.CONNECTION_PATTERNS))
    last = len(R.CONNECTION_PATTERNS) - 1
    item = r"regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^\t\n\f\r ]+$')"
    markup = f"(regexp_matches(before, {_text(R.MARKUP_ATTRIBUTE)}) OR regexp_matches(before, {_text(R.DOCTYPE)}))"
    return f"""{lines}, o AS (SELECT project, path, seq, line_no, line FROM l WHERE {_SCANNED}), r(rank, rule, severity, pat) AS (VALUES {values}),
s AS (SELECT o.*, r.*, regexp_extract_all(line, pat) AS ms, string_split_regex(line, pat) AS gs FROM (SELECT * FROM o WHERE contains(line, '://') OR contains(line, 'jdbc:')) o ANTI JOIN {_lists(item)} USING (project, path), r),
i AS (SELECT *, unnest(ms) AS m, unnest(generate_series(1, len(ms))) AS i FROM s),
j AS (SELECT *, list_reduce(list_transform(generate_series(1, i), lambda k: gs[k] || CASE WHEN k < i THEN ms[k] ELSE '' END), lambda x, y: x || y) AS before, CASE WHEN contains(m, '://') THEN m[position('://' IN m) + 3:] ELSE '' END AS rest FROM i),
k AS (SELECT *, length(before) AS b, length(before) + length(m) AS e, regexp_extract(rest, '{_CREDENTIALS}', 1) AS creds, regexp_extract(rest, '{_CREDENTIALS}', 2) AS secret, regexp_extract(rest, '{_CREDENTIALS}', 3) AS host FROM j
  WHERE NOT CASE WHEN rank BETWEEN 1 AND 6 THEN {_host_exempt("rest")} WHEN rank = {last} THEN {_host_exempt("rest")} OR {markup} WHEN rank > 0 THEN contains(m, '://') AND NOT contains(rest, '@') AND {_host_exempt("rest")} ELSE FALSE END),
q AS (SELECT project, path, seq, line_no, list_reduce(list([struct_pack(rank := rank, rule := rule, severity := severity, b := b, e := e, text := m, shown := rank > 0 OR NOT (regexp_matches(rest, '{_CREDENTIALS}') AND {_non_secret()}))] ORDER BY rank, b),
  lambda x, y: CASE WHEN len(list_filter(x, lambda z: z.b < y[1].e AND y[1].b < z.e)) > 0 THEN x ELSE list_concat(x, y) END) AS claimed FROM k GROUP BY ALL)
SELECT project, path, line_no, c.rule AS rule, c.severity AS severity, c.text AS text FROM (SELECT *, unnest(claimed) AS c FROM q) WHERE c.shown"""


def env_example_uncommented(files: str) -> str:
    """files: the derived files as CTEs."""
    return f"""{files}, x AS (SELECT project || '/' || seq AS project, CASE WHEN seq % 5 = 0 THEN '.env.example' ELSE path END AS path, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM files),
y AS (SELECT project, path, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS line_no FROM x WHERE path IN {_in(R.ENV_EXAMPLES)}),
z AS (SELECT *, trim(line, ' ') AS t FROM y),
w AS (SELECT *, last_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY project, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, regexp_extract(t, '^([A-Za-z0-9_]+)=', 1) AS key FROM z)
SELECT project, path, line_no, key FROM w WHERE key <> '' AND NOT starts_with(coalesce(above, ''), '#') AND NOT contains(regexp_replace(line, '''[^'']*(''|$)|"[^"]*("|$)', '', 'g'), '#')"""
