"""Column functions of lines: matches with offsets, addresses, URLs."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R


#: Items that a fold takes together: outputs are copied once for each such lot, not once for each item.
_LOT = 256


def scan(items: Column, start: Column, none: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """All outputs of a fold over an array, in order. step(state, item): the next state, and an array of outputs; none: an empty one.

    Time grows with the number of items times its square root, at most.
    """

    def one(acc, x):
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def lot(acc, xs):
        own = F.aggregate(xs, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        # the array of one array: what it holds is computed once, not at each use
        return F.transform(F.array(own), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")))[0]

    def folded(xs):
        starts = F.filter(F.sequence(F.lit(0), F.size(xs), F.lit(_LOT)), lambda i: i < F.size(xs))
        return F.aggregate(F.transform(starts, lambda i: F.slice(xs, i + 1, F.lit(_LOT))), F.struct(start.alias("state"), none.alias("out")), lot, lambda acc: acc["out"])

    return F.transform(F.array(items), folded)[0]


def find_all(line: Column, pattern: str) -> Column:
    """All non-overlapping matches as array<struct<start, end, text>>; offsets are code points."""
    matches = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(F.slice(F.split(line, pattern, -1), 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("text")))

    def step(at, x):
        begin = at + x["gap"]
        return begin + x["size"], F.array(F.struct(begin.alias("start"), (begin + x["size"]).alias("end"), x["text"].alias("text")))

    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return F.when(line.rlike(pattern), scan(sizes, F.lit(0), none, step)).otherwise(none)


def claimed(spans: Column) -> Column:
    """Of spans (rank, start, end, text) those that overlap none of a lower rank, or of the same rank before them, that is itself kept.

    Spans are swept by start; only those whose overlaps hang together are held against each other.
    """
    kind = "struct<start:int,end:int,rank:int,text:string>"
    none = F.array().cast(f"array<{kind}>")
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["text"].alias("text"))))
    last = F.struct(F.lit((1 << 31) - 1).alias("start"), F.lit((1 << 31) - 1).alias("end"), F.lit(0).alias("rank"), F.lit("").alias("text"))

    def step(state, x):
        apart = x["start"] >= state["reach"]
        own = F.array(x)
        held = F.when(apart, own).otherwise(F.concat(state["held"], own))
        reach = F.when(apart, x["end"]).otherwise(F.greatest(state["reach"], x["end"]))
        full = F.when(apart & (F.size(state["held"]) > 0), F.array(state["held"])).otherwise(F.array().cast(f"array<array<{kind}>>"))
        return F.struct(reach.alias("reach"), held.alias("held")), full

    groups = scan(F.concat(by_start, F.array(last)), F.struct(F.lit(0).alias("reach"), none.alias("held")), F.array().cast(f"array<array<{kind}>>"), step)
    ranked = lambda g: F.array_sort(F.transform(g, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))))
    none = F.array().cast("array<struct<rank:int,start:int,end:int,text:string>>")
    clear = lambda kept, c: ~F.exists(kept, lambda k: (c["start"] < k["end"]) & (k["start"] < c["end"]))
    chosen = lambda g: F.aggregate(ranked(g), none, lambda kept, c: F.when(clear(kept, c), F.concat(kept, F.array(c))).otherwise(kept))
    return F.when(F.size(spans) > 0, F.flatten(F.transform(groups, chosen))).otherwise(none)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), where the value is computed once and not at each use (as the item of an array of one)."""
    return F.transform(F.array(value), of)[0]


def _half(groups: Column) -> Column:
    """Four groups of hexadecimal digits as a number."""
    return F.aggregate(groups, F.lit(0).cast("long"), lambda n, g: F.shiftleft(n, 16).bitwiseOR(F.conv(g, 16, 10).cast("long")))


def ipv6(text: Column) -> Column:
    """(high, low) of an IPv6 address, its 128 bits as two longs; null if it is none. A zone behind % is passed over; the last
    two groups may be a dotted quad."""
    quad = r"(?:^|:)([0-9]+(?:\.[0-9]+){3})\z"
    shape = r"^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?(?:::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)?\z"

    def plain(own: Column) -> Column:  # the quad as two groups
        hexed = lambda n: F.concat_ws(":", F.lower(F.hex(F.shiftright(n, 16))), F.lower(F.hex(n.bitwiseAND(0xFFFF))))
        replaced = lambda q: let(ipv4(q), lambda n: F.when(n.isNotNull(), F.concat(F.left(own, F.length(own) - F.length(q)), hexed(n))))
        return F.when(own.rlike(quad), let(F.regexp_extract(own, quad, 1), replaced)).otherwise(own)

    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")

    def whole(own: Column) -> Column:  # eight groups, or null
        both = F.struct(groups(F.substring_index(own, "::", 1)).alias("front"), groups(F.substring_index(own, "::", -1)).alias("back"))
        gap = lambda x: 8 - F.size(x["front"]) - F.size(x["back"])
        filled = let(both, lambda x: F.when(gap(x) >= 1, F.concat(x["front"], F.array_repeat(F.lit("0"), gap(x)), x["back"])))
        return F.when(own.rlike(shape), F.when(own.contains("::"), filled).otherwise(let(groups(own), lambda g: F.when(F.size(g) == 8, g))))

    halves = lambda g: F.when(g.isNotNull(), F.struct(_half(F.slice(g, 1, 4)).alias("high"), _half(F.slice(g, 5, 4)).alias("low")))
    return let(F.regexp_replace(text, r"%[0-9A-Za-z._~-]+\z", ""), lambda own: let(plain(own), lambda p: let(whole(p), halves)))


def _v6_range(net: str) -> tuple[int, int, int, int]:
    """First and last address of a network, each as two signed longs."""
    own = ipaddress.IPv6Network(net)
    halves = [h for a in (int(own[0]), int(own[-1])) for h in (a >> 64, a & ((1 << 64) - 1))]
    return tuple(h - (1 << 64) if h >> 63 else h for h in halves)


#: Category -> networks of IPv6, in the order of precedence.
V6_NETS = (
    ("loopback", ["::1/128"]),
    ("unspecified", ["::/128"]),
    ("link-local", ["fe80::/10", "ff02::/16"]),
    ("doc-range", ["2001:db8::/32", "3fff::/20"]),
    ("private", ["fc00::/7"]),
    ("multicast", ["ff00::/8"]),
)


def classify_ipv6(n: Column) -> Column:
    """Category of an address (high, low); a mapped IPv4 address has the category of that. Null for null."""
    flip = lambda c: c.bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  unsigned order

    def within(net):
        a, b, c, d = (F.lit(x).cast("long") for x in _v6_range(net))
        high, low = flip(n["high"]), flip(n["low"])
        return ((high > flip(a)) | ((high == flip(a)) & (low >= flip(b)))) & ((high < flip(c)) | ((high == flip(c)) & (low <= flip(d))))

    mapped = (n["high"] == 0) & (F.shiftrightunsigned(n["low"], 32) == 0xFFFF)
    out = F.when(n.isNull(), F.lit(None).cast("string")).when(mapped, classify_ipv4(n["low"].bitwiseAND(F.lit(0xFFFFFFFF))))
    for name, nets in V6_NETS:
        for net in nets:
            out = out.when(within(net), name)
    return out.otherwise("public")


def ipv4(text: Column) -> Column:
    """Dotted quad as a number; null if an octet exceeds 255 or has a leading zero."""
    octets = F.transform(F.split(text, r"\."), lambda o: o.cast("long"))
    valid = text.rlike(r"^(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})\z")
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o)
    return F.when(valid, F.when(F.forall(octets, lambda o: o <= 255), number))


def _range(net: str) -> tuple[int, int]:
    address, bits = net.split("/")
    a, b, c, d = map(int, address.split("."))
    low = (a << 24) + (b << 16) + (c << 8) + d
    return low, low + (1 << (32 - int(bits))) - 1


def number(address: str) -> int:
    return _range(address + "/32")[0]


#: Category -> networks, in the order of precedence, up to the private ones.
NETS_FIRST = (
    ("loopback", ["127.0.0.0/8"]),
    ("unspecified", ["0.0.0.0/32"]),
    ("link-local", ["169.254.0.0/16", "224.0.0.0/24"]),
    ("doc-range", R.DOC_NETS),
    ("private", ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"]),
)
NETS_LAST = (("broadcast", ["255.255.255.255/32"]), ("multicast", ["224.0.0.0/4"]), ("reserved", ["240.0.0.0/4"]))


def classify_ipv4(n: Column) -> Column:
    def within(nets):
        out = F.lit(False)
        for net in nets:
            out = out | n.between(*_range(net))
        return out

    octet = [F.shiftright(n, s).bitwiseAND(255) for s in (24, 16, 8, 0)]
    up = (octet[1] == octet[0] + 1) & (octet[2] == octet[1] + 1) & (octet[3] == octet[2] + 1)
    down = (octet[1] == octet[0] - 1) & (octet[2] == octet[1] - 1) & (octet[3] == octet[2] - 1)
    out = F.when(n.isNull(), F.lit(None))
    for name, nets in NETS_FIRST:
        out = out.when(within(nets), name)
    out = out.when(up | down, "doc-placeholder").when(n.isin([number(a) for a in R.PUBLIC_RESOLVERS]), "public-resolver")
    for name, nets in NETS_LAST:
        out = out.when(within(nets), name)
    return out.otherwise("public")


def host_exempt(rest: Column) -> Column:
    """Whether the host at the start of what follows `://` is never on the public internet, or a standard's."""
    host = F.lower(F.regexp_extract(rest, r"^([^/:?#]*)", 1))
    n = ipv4(host)
    reserved = classify_ipv4(n).isin("loopback", "private", "unspecified") | n.between(*_range("169.254.0.0/16")) | n.between(*_range("100.64.0.0/10"))
    names = host.isin("", "localhost", "0.0.0.0", "::1", "example.com", "internal") | host.rlike(r"\.(example\.com|test|localhost|invalid|local|internal)\z")
    spec = host.rlike(r"(?:^|\.)(?:" + "|".join(h.replace(".", r"\.") for h in R.SPEC_HOSTS) + r")\z")
    return names | F.coalesce(reserved, F.lit(False)) | ~host.contains(".") | spec


_GROUP = r"(?:\$\{[^}]*\}|\{\{.*?\}\}|[^:@])*?"


def creds_non_secret(url: Column) -> Column:
    """Whether user and password of a URL are a template, defaults, or a stand-in."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    split = r"(?s)^((?:\$\{[^}]*\}|\{\{.*?\}\}|[^:@])*):((?:\$\{[^}]*\}|\{\{.*?\}\}|[^@])*)@(.*)$"
    user, secret, host = (F.regexp_extract(rest, split, k) for k in (1, 2, 3))
    found = rest.rlike(split)
    low_user, low = F.lower(user), F.lower(secret)
    structural = lambda c: (c != "") & (c.rlike(R.REGEX_SYNTAX) | (F.length(c) <= 2))
    prefix = "|".join(R.PLACEHOLDER_PREFIXES)
    stand_in = low.rlike(R.PLACEHOLDER_WORD) | low.rlike(rf"^(?:{prefix})(?:\z|[_.-]|(?:{'|'.join(R.PLACEHOLDER_NOUNS)})\z)")
    shouted = secret.rlike("[_-]") & ~secret.rlike("[a-z]") & (secret == F.upper(secret))
    equal = (user != "") & (low_user == low) & host_exempt(host)
    return found & (secret.rlike(R.TEMPLATE_TOKEN) | (low_user.isin(R.DEFAULT_CREDENTIALS) & low.isin(R.DEFAULT_CREDENTIALS)) | equal | structural(user) | structural(secret) | ((secret != "") & (stand_in | shouted)))


def shannon_entropy(s: Column) -> Column:
    """Bits a character."""
    chars = F.split(s, "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def human_size(n: Column) -> Column:
    return (
        F.when(n >= 1 << 30, F.format_string("%.1f GiB", n / (1 << 30)))
        .when(n >= 1 << 20, F.format_string("%.1f MiB", n / (1 << 20)))
        .when(n >= 1 << 10, F.format_string("%.1f KiB", n / (1 << 10)))
        .otherwise(F.format_string("%d B", n))
    )


def heading_slug(title: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(F.trim(title)), r"[^\p{L}\p{Nd}\p{M}_ -]", ""), F.lit(" "), F.lit("-"))


def valid_json(s: Column) -> Column:
    """Strict: one value and nothing after it."""
    s = F.regexp_replace(s, "^\ufeff", "")
    return F.try_parse_json(s).isNotNull() & F.try_parse_json(F.concat(F.lit("["), s, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"k":'), s, F.lit("}"))).isNotNull()


def jsonc_stripped(s: Column) -> Column:
    """Possessive repeats keep long strings off the stack."""
    out = F.regexp_replace(s, r'("(?:\\.|[^"\\])*+")|//[^\n]*|/\*[\s\S]*?\*/', "$1")
    return F.regexp_replace(out, r'("(?:\\.|[^"\\])*+")|,(?=[\s]*[}\]])', "$1")


def shell_quoted(s: Column) -> Column:
    """In single quotes where a shell would read more than the characters."""
    special = s.rlike(r"""[ \t\n"'\\$`!*?\[\]{}()<>|;&#~]""") | (s == "")
    return F.when(special, F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("'\\''")), F.lit("'"))).otherwise(s)


def one_line(s: Column) -> Column:
    """A message's pieces in one line, with single spaces."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))
