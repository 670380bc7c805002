"""Line deduplication by a log-template tree.

A line's words with a digit in them are masked, and the line falls down a tree of fixed
depth: by its number of words, then by its four first words, of which one may be anything,
so a line is in four leaves. In its leaves a line stands for the most typical line that
shares a segment of its further words and at least 80 % of all words, place by place.
Typical is a line whose segments many lines of its leaves share; ties go by digest. So
field values, however many lines share one, and edits at different places lead to one
template. A template that occurs in several documents is dropped from all but the first
(smallest doc_id).

Of two lines that differ in k words, one of k + 1 segments is equal: lines meet only the most
typical line of a segment, so that pairs stay in proportion to lines. A line whose most
typical line itself stands for a third one stands for that. Lines of under 5 words have no
word to spare and stand for themselves; lines without a word that isn't masked (numbers)
have no template and stay. Lines whose first words differ in more than one place don't
meet.

Lines move as hashes; words are laid out only for distinct lines in leaves that hold
several. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, without

#: Leading words that the tree splits on; at one of them a leaf takes any word.
DEPTH = 4
#: Share of a line's words that it has in common with its template, at least.
SIMILAR = 0.8
MASK = "<*>"
#: Tables of up to so many line keys (24 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_LINES = 300_000
_LAST = (1 << 63) - 1
#: Above any text of Unicode characters that are in use.
_LAST_TEXT = "\U0010ffff"
_ODD_SPACE = r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*+|\x20[\x20\x09\x0B-\x0D]++"
_WITH_DIGIT = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def masked(line: Column) -> Column:
    """A line's words, masked, with single spaces between. Most lines need no rewriting, and finding that out is cheap."""
    again = line.contains("  ") | line.rlike(r"[0-9\x09\x0B-\x0D]")
    return F.trim(F.when(again, F.regexp_replace(F.regexp_replace(line, _ODD_SPACE, " "), _WITH_DIGIT, MASK)).otherwise(line))


def doc_key(docs: DataFrame) -> Column:
    """doc_id as something to order by, null last: whole numbers as such, other types as text."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(_LAST_TEXT))


def _n_words(line: str) -> Column:
    """Words of a masked line."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, row, pos, m, n, h) of the lines with a constant word; row: hash of id and text."""
    keyed = docs.select(doc_key(docs).alias("doc"), F.xxhash64("doc_id", "text").alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    each = keyed.select("doc", "row", "pos", masked(F.col("line")).alias("m"))
    constant = F.trim(F.replace(F.concat(F.lit(" "), "m", F.lit(" ")), F.lit(f" {MASK}"), F.lit(""))) != ""
    each = each.where((F.col("m") != "") & F.when(F.col("m").contains(MASK), constant).otherwise(True))
    return each.withColumn("n", _n_words("m")).withColumn("h", F.xxhash64("m"))


def _lead(depth: int) -> list[Column]:
    """Hashes of the first words, two in a number."""
    word = lambda j: F.hash(F.substring_index(F.substring_index("m", " ", j + 1), " ", -1)).cast("long").bitwiseAND(F.lit((1 << 32) - 1))
    return [word(j).bitwiseOR(F.shiftleft(word(j + 1), 32)) if j + 1 < depth else word(j) for j in range(0, depth, 2)]


def _most(n: Column, similar: float) -> Column:
    """Words of n in which a line may differ from its template."""
    return F.floor(n * (1 - similar) + 1e-9).cast("int")


def _leaves(variants: DataFrame, depth: int, similar: float) -> DataFrame:
    """(h, leaf) of the lines that may differ in a word, in leaves that hold several.

    A leaf is named by the lines that it holds, so leaves of the same lines are one.
    """
    word = lambda j: F.shiftright(F.col(f"w{j // 2}"), 32 * (j % 2)).bitwiseAND(F.lit((1 << 32) - 1))
    open_at = lambda i: F.xxhash64("n", F.lit(i), *[word(j) for j in range(depth) if j != i])
    keys = variants.where(_most(F.col("n"), similar) > 0).select("h", F.explode(F.array(*[open_at(i) for i in range(depth)])).alias("key"))
    # a window moves the keys once, where an aggregate and a join move them twice
    own = W.partitionBy("key")
    held = keys.select("h", F.count("*").over(own).alias("k"), *[f("h").over(own).alias(f.__name__) for f in (F.min, F.max, F.bit_xor)]).where("k > 1")
    return held.select("h", F.xxhash64("k", "min", "max", "bit_xor").alias("leaf")).distinct()


def _templates(text: DataFrame, leaves: DataFrame, depth: int, similar: float) -> DataFrame:
    """(h, template: the h of the line that it stands for) of the lines that don't stand for themselves."""
    most = _most(F.col("n"), similar)
    free = F.greatest(F.col("n") - depth, F.lit(0))
    begin = lambda i: F.floor(i * free / (most + 1)).cast("int") + depth
    segment = lambda w, i: F.xxhash64("leaf", i, F.array_join(F.slice(w, begin(i) + 1, begin(i + 1) - begin(i)), " "))
    # the array of one array: words are split once a line, not once a segment
    keys = F.flatten(F.transform(F.array(F.split("m", " ")), lambda w: F.transform(F.sequence(F.lit(0), most), lambda i: segment(w, i))))
    keyed = text.join(leaves, "h").select("h", F.unhex(F.md5(F.col("m").cast("binary"))).alias("tie"), F.explode(keys).alias("key"))
    keyed = checkpointed(keyed.withColumn("k", F.count("*").over(W.partitionBy("key"))).where("k > 1"))
    who = keyed.groupBy("h").agg(F.struct((-F.sum("k")).alias("rank"), F.min("tie").alias("tie")).alias("who"))
    ranked = keyed.select("h", "key").join(who, "h")
    chief = ranked.groupBy("key").agg(F.min(F.struct("who", "h")).alias("chief"))
    pairs = ranked.select("h", "key").join(chief, "key").where(F.col("chief.h") != F.col("h")).select("h", "chief").distinct()
    one, other = text.select("h", "n", F.col("m").alias("m1")), text.select(F.col("h").alias("g"), F.col("m").alias("m2"))
    same = F.size(F.filter(F.zip_with(F.split("m1", " "), F.split("m2", " "), lambda a, b: a == b), lambda x: x))
    met = pairs.withColumn("g", F.col("chief.h")).join(one, "h").join(other, "g").where(F.col("n") - same <= most)
    first = checkpointed(met.groupBy("h").agg(F.min("chief")["h"].alias("g")))
    further = first.select(F.col("h").alias("g"), F.col("g").alias("g2"))
    return first.join(further, "g", "left").select("h", F.coalesce("g2", "g").alias("template"))


def _texts_of(docs: DataFrame, slim: DataFrame, asked: DataFrame) -> DataFrame:
    """(h, n, m): one whole line for each asked (h, doc)."""
    few = asked.count() <= BROADCAST_LINES
    hint = F.broadcast if few else (lambda x: x)
    places = slim.join(hint(asked), ["h", "doc"]).groupBy("h").agg(F.min(F.struct("row", "pos")).alias("at"))
    places = checkpointed(places.groupBy("at.row").agg(F.collect_list(F.struct("at.pos", "h")).alias("places")))
    own = docs.withColumn("_r", F.xxhash64("doc_id", "text")).join(hint(places), F.col("_r") == F.col("row"))
    # the array of one array: the text is split once, not once a line
    found = F.transform(F.array(F.split("text", "\n")), lambda ls: F.transform("places", lambda p: F.struct(p["h"].alias("h"), masked(F.get(ls, p["pos"])).alias("m"))))[0]
    return own.select(F.inline(found)).dropDuplicates(["h"]).withColumn("n", _n_words("m"))


def dropped_lines(docs: DataFrame, depth: int = DEPTH, similar: float = SIMILAR) -> DataFrame:
    """(row, dropped): the 0-based numbers of the lines to drop, for rows that have some."""
    lead = _lead(depth)
    slim = checkpointed(_lines(docs).select("doc", "row", "pos", "h", "n", *[c.alias(f"w{k}") for k, c in enumerate(lead)]))
    # lines with one hash are alike in all but doc, row and pos
    variants = checkpointed(slim.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), *[F.min(c).alias(c) for c in ("n", *(f"w{k}" for k in range(len(lead))))]))
    leaves = checkpointed(_leaves(variants, depth, similar))
    asked = checkpointed(variants.join(leaves.select("h").distinct(), "h", "left_semi").select("h", F.col("low").alias("doc")))
    text = checkpointed(_texts_of(docs, slim, asked))
    moved = checkpointed(_templates(text, leaves, depth, similar))
    recurring = _recurring(variants.select("h", "low", "high"), moved)
    return slim.select("doc", "row", "pos", "h").join(recurring, "h").where("doc <> first").groupBy("row").agg(F.collect_set("pos").alias("dropped"))


def _recurring(variants: DataFrame, moved: DataFrame) -> DataFrame:
    """(h, first): lines whose template occurs in several documents, with the first of these.

    moved: (h, template) of the lines that don't stand for themselves. All others but the lines that these
    stand for are templates of their own, and most occur in one document only.
    """
    group = checkpointed(moved.select("h", "template").union(moved.select("template", "template")).distinct())
    known = checkpointed(variants.join(group, "h"))
    again = known.groupBy("template").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first <> last")
    alone = variants.where("low <> high").join(group.select("h"), "h", "left_anti")
    return known.select("h", "template").join(again, "template").select("h", "first").union(alone.select("h", F.col("low").alias("first")))


def dedup_lines(docs: DataFrame, depth: int = DEPTH, similar: float = SIMILAR) -> DataFrame:
    """docs whose text lacks the dropped lines, with n_lines and n_dropped.

    Rows that share a doc_id are one document; all rows without a doc_id are one, the
    last. doc_ids that are no whole numbers are ordered as text. Null text stays null and has
    no lines; an empty text has one, empty. All documents stay; one whose lines all recur has
    an empty text. Very long texts are spread by line. Repeated rows lose the same lines.
    An empty table gives an empty one. Other columns pass through; columns named like the
    added ones are replaced.
    """
    docs = without(docs, "n_lines", "n_dropped", "dropped", "_row", "_r")
    drops = dropped_lines(docs.select("doc_id", "text"), depth, similar).withColumnRenamed("row", "_row")
    out = docs.withColumn("_r", F.xxhash64("doc_id", "text")).join(drops, F.col("_r") == F.col("_row"), "left")
    left = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("dropped"))
    # the array of one array: the text is split once, not once a line
    kept = F.transform(F.array(F.split("text", "\n")), lambda ls: F.array_join(F.transform(left(ls), lambda i: F.get(ls, i)), "\n"))[0]
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_dropped = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long")
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


_SQL_SAME = "len(list_filter(generate_series(1, {a}.n), lambda i: {a}.ws[i] = {b}.ws[i]))"
#: The query's rows; SQL_TEXTS gives the texts themselves.
_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, *, coalesce(doc_id, {_LAST}) AS doc FROM documents),
s AS (SELECT rid, doc, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM d WHERE text IS NOT NULL),
t AS (SELECT rid, doc, pos, list_transform(regexp_extract_all(line, '[^ 	-
]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '{MASK}' ELSE w END) AS ws FROM s),
l AS (SELECT rid, doc, pos, ws, len(ws) AS n, array_to_string(ws, ' ') AS m FROM t WHERE len(list_filter(ws, lambda w: w <> '{MASK}')) > 0),
v AS (SELECT m, any_value(ws) AS ws, any_value(n) AS n, floor(any_value(n) * (1 - {SIMILAR}) + 1e-9)::BIGINT AS most, min(doc) AS low, max(doc) AS high FROM l GROUP BY m),
k0 AS (SELECT m, unnest(list_transform(generate_series(1, {DEPTH}), lambda o: n || ':' || o || ':' || array_to_string(list_transform(ws[1:{DEPTH}], lambda w, j: CASE WHEN j = o THEN '' ELSE w END), ' '))) AS leaf
  FROM v WHERE most > 0),
k1 AS (SELECT leaf AS key, md5(string_agg(m, chr(10) ORDER BY m)) AS leaf FROM k0 GROUP BY k0.leaf HAVING count(*) > 1),
k AS (SELECT DISTINCT m, k1.leaf FROM k0 JOIN k1 ON k1.key = k0.leaf),
a AS (SELECT v.* FROM v WHERE m IN (SELECT m FROM k)),
g AS (SELECT m, leaf, i, array_to_string(ws[{DEPTH} + 1 + floor(i * (n - {DEPTH}) / (most + 1))::BIGINT : {DEPTH} + floor((i + 1) * (n - {DEPTH}) / (most + 1))::BIGINT], ' ') AS part
  FROM (SELECT a.m, leaf, ws, n, most, unnest(generate_series(0, most)) AS i FROM a JOIN k USING (m))),
c AS (SELECT leaf, i, part, count(*) AS n FROM g GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT m, row_number() OVER (ORDER BY sum(c.n) DESC, md5(m)) AS rank FROM g JOIN c USING (leaf, i, part) GROUP BY m),
h AS (SELECT leaf, i, part, min(rank) AS rank FROM g JOIN r USING (m) GROUP BY ALL),
p AS (SELECT DISTINCT g.m, h.rank, r.m AS chief FROM g JOIN h USING (leaf, i, part) JOIN r ON r.rank = h.rank WHERE r.m <> g.m),
q AS (SELECT p.m, arg_min(chief, rank) AS chief FROM p JOIN a x ON x.m = p.m JOIN a y ON y.m = p.chief WHERE x.n - {_SQL_SAME.format(a="x", b="y")} <= x.most GROUP BY p.m),
u AS (SELECT v.m, low, high, coalesce(q2.chief, q1.chief, v.m) AS template FROM v LEFT JOIN q q1 ON q1.m = v.m LEFT JOIN q q2 ON q2.m = q1.chief),
f AS (SELECT template, min(low) AS first FROM u GROUP BY template HAVING min(low) <> max(high)),
z AS (SELECT rid, pos FROM l JOIN u USING (m) JOIN f USING (template) WHERE doc <> first),
e AS (SELECT rid, list(pos) AS ps FROM z GROUP BY rid),
o AS (SELECT d.*, ps, CASE WHEN ps IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda y, i: NOT list_contains(ps, i)), chr(10)) END AS kept
  FROM d LEFT JOIN e USING (rid))
"""
SQL = (
    _SQL
    + "SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(len(ps), 0)::BIGINT AS n_dropped, sha256(kept) AS text_sha256 FROM o"
)
SQL_TEXTS = _SQL + "SELECT doc_id, kept AS text FROM o"
