"""Line dedup by a log-template tree (operator 4).

A line's tokens are split at white space; tokens with a digit are variable
fields, where most of the line's tokens are not (other lines are taken as they
are). The tree has a fixed depth: lines fall into a leaf by their number of
tokens and their first LEADING tokens (fields as wildcards). Within a leaf,
lines that agree once fields are wildcards have one template. A leaf of
several such templates is generalised: a position where one token holds
STABLE of the leaf's lines is a constant, every other is a variable field too,
and lines that agree with at least SIMILAR of the constants, where most of the
template is constant, belong to the leaf's general template.

A leaf may hold several templates besides. A line's frequent tokens (at least
so many of the leaf's lines have them at that position, for counts from
DOCUMENTS up in powers of two), or all of the least frequent but one, are the
constants of a family; each family is judged on its own members' documents.

A template that occurs in DOCUMENTS documents or more is recurring: all its
lines are dropped but those of its first document (the smallest doc_id), so
one copy of what is said stays in the corpus. Lines without a token are left
alone. Lines of fewer than MIN_TOKENS tokens and SHORT characters ask
SHORT_DOCUMENTS documents, and long ones (LONG tokens, or LONG_CHARACTERS in
fewer than MIN_TOKENS, as in scripts without spaces) ask LONG_DOCUMENTS.

Only DataFrame functions run. A document sends each template once, counts are
aggregated before they are exchanged, and no task holds a template's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WorkTables, sealed

LEADING, STABLE, SIMILAR = 3, 0.9, 0.9
DOCUMENTS, MIN_TOKENS = 3, 3
SHORT, SHORT_DOCUMENTS = 18, 10
LONG, LONG_CHARACTERS, LONG_DOCUMENTS = 50, 300, 2
FIELD = "<*>"


#: Slots of a broadcast filter; its size is bounded whatever the data.
SLOTS = 1 << 20
_LAST = 2**63 - 1


_BLANK = "\t\r\x0b\f"
#: A whole token that holds a digit, found without going back.
_WITH_DIGIT = "(?<![^ ])[^0-9 ]*+[0-9][^ ]*+"


def _with_tokens(rows: DataFrame) -> DataFrame:
    """rows with tokens, of __line; fields are masked where they are fewer than half of all. Blank lines go.

    Conditions on tokens would be pushed down and cut every line once more.
    """
    cut = lambda x: F.array_remove(F.split(x, " "), "")
    # translate looks up every character, and few lines hold such a blank
    blank = F.contains("__line", F.lit(_BLANK[0]))
    for x in _BLANK[1:]:
        blank = blank | F.contains("__line", F.lit(x))
    line = F.when(blank, F.translate("__line", _BLANK, " " * len(_BLANK))).otherwise(F.col("__line"))
    spaced = rows.withColumn("__line", line).where(F.btrim("__line") != "")
    masked = F.when(F.col("__line").rlike("[0-9]"), cut(F.regexp_replace("__line", _WITH_DIGIT, FIELD)))
    both = spaced.withColumn("__plain", cut(F.col("__line"))).withColumn("__masked", masked).drop("__line")
    mostly = 2 * F.size(F.filter("__masked", lambda x: x == FIELD)) < F.size("__masked")
    return both.withColumn("tokens", F.when(mostly, F.col("__masked")).otherwise(F.col("__plain"))).drop("__plain", "__masked")


def _keys(docs: DataFrame) -> DataFrame:
    """A row's identity: doc_id and a hash of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64(text).alias("__text"), text.alias("__body"))


def _least() -> Column:
    """Documents in which a template, given as tokens, recurs."""
    size, few = F.size("tokens"), F.size("tokens") < MIN_TOKENS
    characters = F.length(F.array_join("tokens", ""))
    least = F.when((size >= LONG) | (few & (characters >= LONG_CHARACTERS)), LONG_DOCUMENTS)
    return least.when(few & (characters < SHORT), SHORT_DOCUMENTS).otherwise(DOCUMENTS)


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line: __id, __text, __at, leaf, template, least."""
    rows = _keys(docs).select("__id", "__text", F.posexplode(F.split("__body", "\n")).alias("__at", "__line"))
    return _with_tokens(rows).select("__id", "__text", "__at", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, LEADING)).alias("leaf"), F.xxhash64("tokens").alias("template"), _least().alias("least"))


def recurring_lines(docs: DataFrame, tables: WorkTables) -> DataFrame:
    """Lines to drop: __id, __text, __drop (an array of line numbers)."""
    lines = tables.save(_lines(docs), "lines")
    number = F.coalesce("__id", F.lit(_LAST))
    document = F.xxhash64("__id", "__text")
    once = lines.groupBy("leaf", "template", "__id", "__text").agg(F.max("least").alias("least"))
    sums = once.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("documents"), F.min(number).alias("first"), F.min(document).alias("low"), F.max(document).alias("high"), F.max("least").alias("least"))
    sums = tables.save(sums, "templates")
    exact = sums.where(F.col("documents") >= F.col("least")).select("leaf", "template", "first")
    # leaves of several templates, which may share a general one
    wide = sums.groupBy("leaf").agg(F.count(F.lit(1)).alias("templates"), F.sum("documents").alias("documents"), F.max("least").alias("least"))
    wide = wide.where((F.col("templates") > 1) & (F.col("documents") >= F.col("least"))).select("leaf")
    rows = _wide(docs, sums.drop("least").join(wide, "leaf"), tables)
    held, marks = _marks(rows, tables)
    found = exact.unionByName(_general(held, marks)).unionByName(_families(marks, tables)).groupBy("leaf", "template").agg(F.min("first").alias("first"))
    hit = lines.join(tables.save(found, "found"), ["leaf", "template"]).where(number != F.col("first"))
    return hit.groupBy("__id", "__text").agg(F.collect_set("__at").alias("__drop"))


def _wide(docs: DataFrame, templates: DataFrame, tables: WorkTables) -> DataFrame:
    """Wide leaves' templates (leaf, template, documents, first, low, high) with their tokens; documents as n.

    The tokens of one line of each template are read again; documents without
    such a line are left out before the exchange by filters of SLOTS slots.
    """
    templates = tables.save(templates, "wide")
    number = F.coalesce("__id", F.lit(_LAST))
    slot = lambda x: F.pmod(F.xxhash64(x), F.lit(SLOTS)).cast("int").alias("__slot")
    slots = templates.select(slot(F.col("first"))).distinct()
    near = _keys(docs).select("__body", number.alias("first"), slot(number)).join(F.broadcast(slots), "__slot", "left_semi")
    read = near.join(templates.select("first").distinct().hint("shuffle_hash"), "first", "left_semi")
    tokens = read.select(F.explode(F.split("__body", "\n")).alias("__line"))
    tokens = _with_tokens(tokens).select("tokens", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, LEADING)).alias("leaf"), F.xxhash64("tokens").alias("template"))
    wanted = templates.select(slot(F.col("template"))).distinct()
    # slots are distinct; a semi-join would be pushed below the cut of lines
    tokens = tokens.withColumn("__slot", slot(F.col("template"))).join(F.broadcast(wanted), "__slot").drop("__slot")
    rows = tokens.join(templates.hint("merge"), ["leaf", "template"]).groupBy("leaf", "template").agg(F.first("tokens").alias("tokens"), F.max("documents").alias("n"), F.min("first").alias("first"), F.min("low").alias("low"), F.max("high").alias("high"))
    return tables.save(rows, "general")


def _marks(rows: DataFrame, tables: WorkTables) -> tuple[DataFrame, DataFrame]:
    """Wide leaves' places (a token at a position, by its hash h) that two lines or more hold, and the templates with theirs.

    A place is constant where STABLE of the leaf's lines hold it. The first
    table has leaf, h, held, constant, size, the second one row per template.
    """
    places = rows.select("leaf", "template", "n", F.posexplode("tokens").alias("at", "token")).where(F.col("token") != FIELD)
    places = places.select("leaf", "template", "n", F.xxhash64("at", "token").alias("h"))
    total = rows.groupBy("leaf").agg(F.sum("n").alias("lines"), F.max(F.size("tokens")).alias("size"))
    held = places.groupBy("leaf", "h").agg(F.sum("n").alias("held")).where(F.col("held") >= LONG_DOCUMENTS).join(total, "leaf")
    held = tables.save(held.select("leaf", "h", "held", (F.col("held") >= STABLE * F.col("lines")).alias("constant"), "size"), "places")
    mark = F.struct("h", "held", "constant")
    marks = places.drop("n").join(held.drop("size"), ["leaf", "h"]).groupBy("leaf", "template").agg(F.collect_list(mark).alias("marks"))
    whole = rows.select("leaf", "template", F.size("tokens").alias("size"), _least().alias("least"), "n", "first", "low", "high")
    return held, tables.save(whole.join(marks, ["leaf", "template"]), "marks")


def _general(held: DataFrame, marks: DataFrame) -> DataFrame:
    """Of wide leaves' templates, those that fit the leaf's recurring general template: leaf, template, first."""
    shape = held.where("constant").groupBy("leaf").agg(F.count(F.lit(1)).alias("fixed"), F.max("size").alias("size")).where(F.col("fixed") * 2 > F.col("size")).select("leaf", "fixed")
    same = marks.select("leaf", "template", "n", "first", F.size(F.filter("marks", lambda m: m["constant"])).alias("same"))
    members = same.join(shape, "leaf").where(F.col("same") >= SIMILAR * F.col("fixed"))
    whole = members.groupBy("leaf").agg(F.sum("n").alias("lines"), F.min("first").alias("first")).where(F.col("lines") >= DOCUMENTS)
    return members.select("leaf", "template").join(whole.select("leaf", "first"), "leaf")


def _families(marks: DataFrame, tables: WorkTables) -> DataFrame:
    """Of wide leaves' templates, those of a recurring family of their leaf: leaf, template, first."""
    marks = marks.withColumn("marks", F.filter("marks", lambda m: m["held"] >= F.col("least"))).where(F.size("marks") > 0)
    joined = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda all_, m: all_.bitwiseXOR(m["h"]))
    family = lambda key, fixed: F.struct(key.alias("key"), fixed.alias("fixed"))
    highest = F.length(F.bin(F.floor(F.array_max(F.transform("marks", lambda m: m["held"])) / F.col("least")))) - 1  # of the powers of two
    # what a lambda closes over is worked out again for each element, unless it is an element itself
    steps = F.transform(F.sequence(F.lit(0), highest), lambda k: F.col("least") * F.pow(F.lit(2), k))
    levels = F.transform(steps, lambda step: F.filter("marks", lambda m: m["held"] >= step))
    shared = F.transform(levels, lambda some: family(joined(some), F.size(some)))
    every = F.array(F.struct(joined(F.col("marks")).alias("key"), (F.size("marks") - 1).alias("fixed")))
    but_one = F.flatten(F.transform(every, lambda e: F.transform("marks", lambda m: family(e["key"].bitwiseXOR(m["h"]), e["fixed"]))))
    # a key is made of its marks, so equal keys have as many; longs are made distinct by hash, structs by comparing all
    fit = F.transform(F.filter(F.concat(shared, but_one), lambda f: f["fixed"] * 2 > F.col("size")), lambda f: f["key"])
    keys = tables.save(marks.select("leaf", "template", "least", "n", "first", "low", "high", F.explode(F.array_distinct(fit)).alias("key")), "keys")
    # a template of fewer than DOCUMENTS documents has no others than low and high
    ends = keys.groupBy("leaf", "key").agg(F.min("low").alias("lowest"), F.max("high").alias("highest"), F.min("first").alias("first"), F.count(F.lit(1)).alias("templates")).where("templates > 1")
    between = lambda x: (F.col(x) > F.col("lowest")) & (F.col(x) < F.col("highest"))
    members = tables.save(keys.drop("first").join(ends, ["leaf", "key"]), "families")
    enough = (F.col("n") >= F.col("least")) | between("low") | between("high") | ((F.col("least") == 2) & (F.col("lowest") < F.col("highest")))
    recurring = members.where(enough).select("leaf", "key").distinct()
    return members.join(recurring, ["leaf", "key"], "left_semi").groupBy("leaf", "template").agg(F.min("first").alias("first"))


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """docs with recurring lines taken out of text; n_chars, where present, is counted anew.

    Null texts stay null; a text all of whose lines go becomes empty, and its
    row stays. Texts of any length are read whole. Rows that agree in doc_id and text are one document. A null
    doc_id comes last in the choice of a first document. An empty table gives
    no rows. Columns other than text and n_chars pass through.
    """
    tables = WorkTables(docs.sparkSession, "linedup")
    drops = tables.save(recurring_lines(docs.select("doc_id", "text"), tables), "drops")
    return sealed(docs, ("doc_id", "text", "n_chars"), lambda rows: _without(rows, drops))


def _marked(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """docs with __drop, the lines to take out of each text, and __left, the text without them."""
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__text": F.xxhash64(F.col("text").cast("string"))})
    same = keyed["__id"].eqNullSafe(drops["__id"]) & (keyed["__text"] == drops["__text"])
    # by a shuffle at every size
    joined = keyed.join(drops.hint("merge"), same, "left").drop(drops["__id"], drops["__text"])
    lines = F.split(F.col("text").cast("string"), "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__drop"), i)), "\n")
    return joined.withColumn("__left", F.when(F.col("__drop").isNull(), F.col("text")).otherwise(left))


def _without(docs: DataFrame, drops: DataFrame) -> DataFrame:
    out = _marked(docs, drops).withColumn("text", F.col("__left"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__drop").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def line_digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text_md5 of the text that is left (null: empty).

    The same rules, and the same cases, as drop_recurring_lines. Other columns
    of docs are not read.
    """
    lean = docs.select("doc_id", "text")
    tables = WorkTables(docs.sparkSession, "linedup")
    out = _marked(lean, tables.save(recurring_lines(lean, tables), "drops"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    dropped = F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop"))
    return out.select("doc_id", n_lines.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), F.md5(F.coalesce("__left", F.lit("")).cast("binary")).alias("text_md5"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS num, text, md5(text) AS h FROM documents),
l AS (
  SELECT rid, num, h, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ln
  FROM d WHERE text IS NOT NULL),
u AS (
  SELECT *, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS msk
  FROM (SELECT *, list_filter(regexp_split_to_array(line, '[ \t\r\x0b\f]+'), lambda x: x <> '') AS raw FROM l)),
t AS (SELECT *, CASE WHEN 2 * len(list_filter(msk, lambda x: x = '<*>')) < len(msk) THEN msk ELSE raw END AS tok FROM u),
k AS (
  SELECT rid, num, h, ln, tok, len(tok) AS n, tok[1:3] AS head,
         CASE WHEN len(tok) >= 50 OR (len(tok) < 3 AND length(array_to_string(tok, '')) >= 300) THEN 2
              WHEN len(tok) < 3 AND length(array_to_string(tok, '')) < 18 THEN 10 ELSE 3 END AS least
  FROM t WHERE len(tok) >= 1),
s AS (SELECT n, head, tok, any_value(least) AS least, count(DISTINCT (num, h)) AS docs, min(num) AS first FROM k GROUP BY n, head, tok),
w AS (SELECT n, head, sum(docs)::BIGINT AS lines FROM s WHERE n >= 3 GROUP BY n, head HAVING count(*) > 1 AND sum(docs) >= max(least)),
x AS (SELECT s.*, lines, row_number() OVER () AS id FROM s JOIN w ON s.n = w.n AND s.head = w.head),
p AS (SELECT n, head, id, docs, lines, least, unnest(range(1, n + 1)) AS pos, unnest(tok) AS token FROM x),
c AS (SELECT n, head, pos, token FROM p GROUP BY n, head, pos, token, lines HAVING sum(docs) >= 0.9 * lines AND token <> '<*>'),
f AS (SELECT n, head, count(*) AS fixed FROM c GROUP BY n, head HAVING count(*) * 2 > n),
m AS (
  SELECT p.id FROM p JOIN c ON p.n = c.n AND p.head = c.head AND p.pos = c.pos AND p.token = c.token
  JOIN f ON p.n = f.n AND p.head = f.head GROUP BY p.id, fixed HAVING count(*) >= 0.9 * fixed),
g AS (SELECT n, head, min(first) AS first FROM x JOIN m USING (id) GROUP BY n, head HAVING sum(docs) >= 3),
v AS (SELECT n, head, pos, token, sum(docs)::BIGINT AS held FROM p WHERE token <> '<*>' GROUP BY n, head, pos, token HAVING sum(docs) >= 2),
y AS (
  SELECT id, any_value(p.least) AS least, list({'p': p.pos, 't': p.token, 'h': held} ORDER BY p.pos) AS marks
  FROM p JOIN v ON p.n = v.n AND p.head = v.head AND p.pos = v.pos AND p.token = v.token WHERE held >= least GROUP BY id),
z AS (
  SELECT id, list_filter(marks, lambda e: e.h >= least * (1::BIGINT << e2)) AS chosen
  FROM (SELECT *, unnest(range(0, length(bin(list_max(list_transform(marks, lambda e: e.h)) // least)))) AS e2 FROM y)
  UNION ALL
  SELECT id, list_filter(marks, lambda e: e.p <> q) FROM (SELECT *, unnest(list_transform(marks, lambda e: e.p)) AS q FROM y)),
i AS (
  SELECT DISTINCT x.n, x.head, x.least, x.id, list_transform(chosen, lambda e: {'p': e.p, 't': e.t}) AS key
  FROM z JOIN x USING (id) WHERE len(chosen) * 2 > x.n),
j AS (SELECT n, head, key FROM i GROUP BY n, head, key HAVING count(*) > 1),
e AS (SELECT DISTINCT x.id, k.num, k.h FROM x JOIN k ON x.n = k.n AND x.head = k.head AND x.tok = k.tok),
q AS (
  SELECT i.n, i.head, i.key, min(e.num) AS first FROM i JOIN j ON i.n = j.n AND i.head = j.head AND i.key = j.key JOIN e USING (id)
  GROUP BY i.n, i.head, i.key HAVING count(DISTINCT (e.num, e.h)) >= any_value(i.least)),
a AS (
  SELECT n, head, tok, first FROM s WHERE docs >= least
  UNION ALL SELECT x.n, x.head, x.tok, g.first FROM x JOIN m USING (id) JOIN g ON x.n = g.n AND x.head = g.head
  UNION ALL SELECT x.n, x.head, x.tok, q.first FROM x JOIN i USING (id) JOIN q ON i.n = q.n AND i.head = q.head AND i.key = q.key),
b AS (SELECT n, head, tok, min(first) AS first FROM a GROUP BY n, head, tok),
r AS (SELECT k.rid, k.ln FROM k JOIN b ON k.n = b.n AND k.head = b.head AND k.tok = b.tok WHERE k.num <> b.first),
o AS (
  SELECT l.rid, count(*) AS n_lines, count(r.ln) AS n_dropped,
         md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (r.ln IS NULL), '')) AS text_md5
  FROM l LEFT JOIN r ON r.rid = l.rid AND r.ln = l.ln GROUP BY l.rid)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(text_md5, md5('')) AS text_md5
FROM d LEFT JOIN o USING (rid)
"""
