"""Line deduplication by a fixed-depth log-template tree, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import written

#: Different documents that a template must occur in, and that a token must occur in to be a fixed one of its leaf.
MIN_DOCS = 3
#: Leading tokens of a tree path.
LEAD = 3
#: Least share of fixed tokens of a template, in all and behind the leading ones.
FIXED, FIXED_BELOW = 1 / 2, 1 / 3
#: Tokens of an edge of a line. A line is a document's own unless one of its edges occurs in MIN_DOCS texts, and a
#: document tells for a template only with this share of its bytes in lines of its own; copies have less.
EDGE, OWN = 8, 0.15
#: Leaves that are broadcast to find their lines (8 MB); more are joined by a shuffle.
LEAVES = 1 << 19
VARIABLE = "<*>"


def plain_line(line: Column) -> Column:
    """Single spaces between tokens, none around them."""
    odd = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for c in "\t\v\f\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd, F.trim(F.regexp_replace(line, r"[\t-\r ]+", " "))).otherwise(line)


def masked(plain: Column) -> Column:
    """Tokens with a digit are variable."""
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", VARIABLE)).otherwise(plain)


def leaf_of(plain: Column) -> Column:
    """The leaf of the tree that a plain line falls into: its token count, then its leading tokens."""
    n = F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit(" "), F.lit(""))) + 1
    return F.xxhash64(n, masked(F.substring_index(plain, " ", LEAD)))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, k, t, size, no, line, plain, leaf: a row for each line with a token. t names the text of ``size`` bytes, k the row."""
    text = F.col(text_col)
    own = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.octet_length(text).alias("size"), F.split(text, "\n").alias("lines"))
    # Outer, as Spark else infers a filter on the size of the array that splits every text twice more; none is empty.
    each = own.select("id", row_key("id", "t").alias("k"), "t", "size", F.posexplode_outer("lines").alias("no", "line"))
    each = each.where(F.ltrim("line", F.lit("\t\v\f\r ")) != "").withColumn("plain", plain_line(F.col("line")))
    return each.withColumn("leaf", leaf_of(F.col("plain")))


def without_lines(text: Column, gone: Column) -> Column:
    """``text`` without the lines whose numbers are in ``gone``. The text is split once, not for every line that stays."""
    kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    joined = lambda lines: F.array_join(F.transform(kept(lines), lambda i: lines[i]), "\n")
    return F.transform(F.array(F.split(text, "\n")), joined)[0]


def row_key(id_col: str, hash_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.lit("|"), F.col(hash_col))


def line_templates(lines: DataFrame) -> DataFrame:
    """h, key of the distinct lines (leaf, h, line, texts) that have a template: key names it.

    A token is fixed if it occurs at its place in the leaf in at least MIN_DOCS texts, else a variable field; lines
    of a leaf with the same fixed tokens merge. Every count is a sum over distinct lines, so that a common line is one row.
    """
    own = ["leaf", "pos", "token"]
    tokens = lines.select("leaf", "h", "texts", F.posexplode(F.split("line", " ")).alias("pos", "token"))
    fixed = tokens.where(F.col("token") != VARIABLE).groupBy(*own).agg(F.sum("texts").alias("_n")).where(F.col("_n") >= MIN_DOCS).select(*own, F.lit(True).alias("fixed"))
    every = tokens.join(fixed, own, "left")
    token = F.when(F.col("fixed"), F.col("token")).otherwise(VARIABLE)
    got = every.groupBy("leaf", "h").agg(
        F.array_sort(F.collect_list(F.struct("pos", token.alias("token")))).alias("tokens"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("fixed")).alias("fixed"), F.count_if(F.col("fixed") & (F.col("pos") >= LEAD)).alias("below"))
    valid = got.where((F.col("fixed") >= FIXED * F.col("n")) & (F.col("below") >= FIXED_BELOW * (F.col("n") - LEAD)))
    return valid.select("h", F.xxhash64("leaf", F.col("tokens")["token"]).alias("key"))


def recurring(hits: DataFrame, key: str, min_docs: int) -> DataFrame:
    """Values of ``key`` that occur in ``min_docs`` different texts or more, of (key, t)."""
    return hits.select(key, "t").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_docs).select(key)


def telling(lines: DataFrame, texts: DataFrame, min_docs: int) -> DataFrame:
    """The ``texts`` (t, size) that have a share of OWN in lines (t, no, bytes, head, tail) of their own."""
    own = lines.join(texts.select("t"), "t", "left_semi").select("t", "no", "bytes", "head", "tail").distinct()
    edges = own.select("t", "no", "bytes", F.explode(F.array_distinct(F.array("head", "tail"))).alias("edge"))
    common = written(recurring(edges, "edge", min_docs), "edges")
    held = edges.join(common, "edge", "left_semi").select("t", "no", "bytes").distinct().groupBy("t").agg(F.sum("bytes").alias("held"))
    return texts.join(held, "t", "left").where(F.col("size") - F.coalesce("held", F.lit(0)) >= OWN * F.col("size")).select("t")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``docs`` with recurring lines dropped from ``text_col``, and n_lines, n_dropped.

    Lines fall into the leaves of a tree by token count and LEAD leading tokens; below, tokens that are rare at their
    place become variable fields, and lines that then agree share a template, whatever their length. A template that
    recurs stays where it comes first (smallest id, then place) and is dropped everywhere else; all other lines stay as
    they are, in order. It recurs if at least ``min_docs`` documents with different texts hold it that have a share of
    OWN in lines of their own: copies of one document have none, however they were edited, so that a group of copies stays
    whole for near-duplicate detection, and documents that are boilerplate throughout follow what the others tell.
    Blank lines are no templates.

    Null texts stay null with 0 lines; an empty text has one empty line. Repeated rows lose the same lines; null ids
    come first. A text that loses every line becomes empty. All columns are kept; ones named n_lines or n_dropped are
    replaced. An empty table stays empty. A very long text is one row, as in ``docs``; its lines are rows of their own,
    and only its dropped line numbers are gathered.
    """
    lines = lines_of(docs, id_col, text_col)
    edge = lambda n: F.xxhash64(masked(F.substring_index("plain", " ", n)))
    known = written(lines.select("t", "no", F.octet_length("line").alias("bytes"), "leaf", edge(EDGE).alias("head"), edge(-EDGE).alias("tail")), "lines")
    # Leaves of one text only can hold no template; others with fewer than min_docs texts do no harm.
    busy = known.groupBy("leaf").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n")).where((F.col("a") != F.col("b")) & (F.col("n") >= min_docs)).select("leaf")
    busy = written(busy, "leaves")
    busy = F.broadcast(busy) if busy.count() <= LEAVES else busy
    found = lines.join(busy, "leaf").select("id", "k", "no", "t", "size", "leaf", masked(F.col("plain")).alias("line"))
    found = written(found.withColumn("h", F.xxhash64("line")), "found")
    distinct = found.select("leaf", "h", "line", "t").distinct().groupBy("leaf", "h", "line").agg(F.count(F.lit(1)).alias("texts"))
    keyed = found.drop("line", "leaf").join(written(line_templates(written(distinct, "distinct")), "keyed"), "h").drop("h")
    # Written keys share no exchange with the rows that they pick, so that a hot key's rows can be dealt out.
    hits = written(keyed.join(written(recurring(keyed, "key", min_docs), "keys"), "key", "left_semi"), "hits")
    tells = telling(known, hits.groupBy("t").agg(F.max("size").alias("size")), min_docs)
    keys = written(recurring(hits.select("key", "t").distinct().join(tells, "t", "left_semi"), "key", min_docs), "templates")
    hits = hits.join(keys, "key", "left_semi").select("key", "id", "k", "no")
    first = hits.groupBy("key").agg(F.min(F.struct("id", "k", "no")).alias("f")).select(F.col("key").alias("key1"), F.col("f.id").alias("id1"), F.col("f.k").alias("k1"), F.col("f.no").alias("no1"))
    stays = (F.col("k") == F.col("k1")) & (F.col("no") == F.col("no1")) & (F.col("key") == F.col("key1")) & F.col("id").eqNullSafe(F.col("id1"))
    gone = hits.join(first, stays, "left_anti").groupBy("id", "k").agg(F.collect_set("no").alias("gone"))
    gone = gone.select(F.col("id").alias("_id"), F.col("k").alias("_k"), F.col("gone").alias("_gone"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = docs.select(*names, F.xxhash64(text_col).alias("_t")).withColumn("_own", row_key(id_col, "_t"))
    both = own.join(gone.hint("shuffle_hash"), (F.col("_own") == F.col("_k")) & F.col(id_col).eqNullSafe(F.col("_id")), "left")
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(without_lines(F.col(text_col), F.col("_gone")))
    n = F.when(F.col(text_col).isNull(), 0).otherwise(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1).cast("long")
    return both.select(*[text.alias(c) if c == text_col else F.col(c) for c in names], n.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))


#: DuckDB SQL for the columns of the registered query.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) AS raw FROM d WHERE text IS NOT NULL),
m AS (
  SELECT *, list_transform(string_split(trim(regexp_replace(raw, '[\\t-\\r ]+', ' ', 'g')), ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{VARIABLE}' ELSE x END) AS w FROM l
  WHERE regexp_matches(raw, '[^\\t-\\r ]')),
p AS (SELECT r, doc_id, text, no, strlen(raw) AS bytes, array_to_string(w, ' ') AS line, len(w) AS n, array_to_string(w[1:{LEAD}], ' ') AS path, w FROM m),
u AS (SELECT n, path, line, any_value(w) AS w, count(DISTINCT text) AS texts FROM p GROUP BY n, path, line),
k AS (SELECT n, path, line, texts, unnest(range(n)) AS pos, unnest(w) AS token FROM u),
f AS (SELECT n, path, pos, token FROM k WHERE token <> '{VARIABLE}' GROUP BY ALL HAVING sum(texts) >= {MIN_DOCS}),
g AS (
  SELECT k.n AS n, k.path AS path, line, string_agg(coalesce(f.token, '{VARIABLE}'), ' ' ORDER BY k.pos) AS template, count(f.token) AS fixed, count(f.token) FILTER (WHERE k.pos >= {LEAD}) AS below
  FROM k LEFT JOIN f ON k.n = f.n AND k.path = f.path AND k.pos = f.pos AND k.token = f.token GROUP BY k.n, k.path, line),
t AS (SELECT n, path, line, template FROM g WHERE fixed >= {FIXED} * n AND below >= {FIXED_BELOW} * (n - {LEAD})),
h AS (SELECT r, doc_id, text, no, bytes, p.n AS n, p.path AS path, template FROM p JOIN t ON p.n = t.n AND p.path = t.path AND p.line = t.line),
o AS (SELECT n, path, template FROM h GROUP BY ALL HAVING count(DISTINCT text) >= {MIN_DOCS}),
c AS (SELECT h.* FROM h JOIN o ON h.n = o.n AND h.path = o.path AND h.template = o.template),
v AS (SELECT DISTINCT text, no, bytes, array_to_string(w[1:{EDGE}], ' ') AS head, array_to_string(w[-{EDGE}:], ' ') AS tail FROM p WHERE text IN (SELECT text FROM c)),
w AS (SELECT text, no, bytes, head AS edge FROM v UNION SELECT text, no, bytes, tail FROM v),
z AS (SELECT edge FROM w GROUP BY edge HAVING count(DISTINCT text) >= {MIN_DOCS}),
b AS (SELECT text, sum(bytes) AS held FROM (SELECT DISTINCT text, no, bytes FROM w WHERE edge IN (SELECT edge FROM z)) GROUP BY text),
e AS (SELECT DISTINCT c.text AS text FROM c LEFT JOIN b ON c.text = b.text WHERE strlen(c.text) - coalesce(held, 0) >= {OWN} * strlen(c.text)),
q AS (SELECT n, path, template FROM c WHERE text IN (SELECT text FROM e) GROUP BY ALL HAVING count(DISTINCT text) >= {MIN_DOCS}),
s AS (
  SELECT c.r AS r, c.no AS no, row_number() OVER (PARTITION BY c.n, c.path, c.template ORDER BY doc_id, text, no) AS place
  FROM c JOIN q ON c.n = q.n AND c.path = q.path AND c.template = q.template),
x AS (SELECT DISTINCT r, no FROM s WHERE place > 1),
y AS (
  SELECT l.r AS r, count(*) AS n_lines, count(x.no) AS n_dropped, string_agg(CASE WHEN x.no IS NULL THEN raw END, chr(10) ORDER BY l.no) AS kept
  FROM l LEFT JOIN x ON l.r = x.r AND l.no = x.no GROUP BY l.r)
SELECT d.doc_id AS doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM d LEFT JOIN y ON d.r = y.r
"""
