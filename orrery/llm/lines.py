"""Line dedup by a log-template tree, in DataFrame functions only.

A line is a row of tokens; one that holds a digit, an at sign or a slash is masked. The tree has a fixed
depth: the number of tokens, then the first of them, two in short lines and four in long ones. In a leaf a token is fixed at its place if
min_docs texts or more hold it there; at all other places stands a variable field. A line of which half
the tokens or more are fixed belongs to the template of its fixed tokens; a line with fewer is like
nothing else in its leaf and has no template.

A template recurs if min_docs texts or more hold it and no more of them are copies than are not, and its
lines are dropped from every document. Equal texts are one. A text of SHORT tokens or more is a copy if
COPIED percent of them stand at their places in lines of another text too: it is that text with some words
changed, and a matter of document dedup. Without that the lines of every group of near copies would be boilerplate. A copy
loses the lines that recur elsewhere like any other text.

What is joined with the texts grows with them and is never broadcast, whatever its size.
Hot keys (a line of a third of all documents) are counted with map-side combination, and joined back to
tables of one row for each key, which Spark's skew join splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

BLANK = r"[ \t\x0B\f\r]"
TOKEN = r"[^ \t\x0B\f\r]"
#: A token with a variable part. Anchored at the token's begin and without backtracking: linear in its length.
VARIABLE = rf"(?<!{TOKEN})[^ \t\x0B\f\r0-9@/]*+[0-9@/]{TOKEN}*+"
#: Leading tokens that lead to a leaf, besides the number of tokens: in lines of fewer than LONG tokens, and in others.
DEPTH, LONG_DEPTH, LONG = 2, 4, 12
MIN_DOCS = 3
#: Fewer tokens do not tell a copy from a text made of boilerplate.
SHORT = 20
COPIED = 85
SALTS = 16


def _depth(n: Column) -> Column:
    return F.when(n < LONG, F.least(n, F.lit(DEPTH))).otherwise(F.lit(LONG_DEPTH))


def _tokens(line: Column) -> Column:
    """Masked tokens of a line that has some."""
    masked = F.when(line.rlike("[0-9@/]"), F.regexp_replace(line, VARIABLE, "<*>")).otherwise(line)
    return F.split(F.btrim(masked, F.lit(" \t\x0b\f\r")), f"{BLANK}+")


def _line(line: Column) -> Column:
    """The place of a line in the tree: hash of all its masked tokens, hash of its leaf, number of tokens. All are 0 without tokens."""
    hashed = lambda t: F.struct(F.xxhash64(t).alias("path"), F.xxhash64(F.size(t), F.slice(t, F.lit(1), _depth(F.size(t)))).alias("leaf"), F.size(t).alias("n"))
    none = F.struct(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("leaf"), F.lit(0).alias("n"))
    return F.when(line.rlike(TOKEN), F.element_at(F.transform(F.array(_tokens(line)), hashed), 1)).otherwise(none)


def _keys(text: str) -> dict[str, Column]:
    """96 bits that stand for a text; null for a null text."""
    some = F.col(text).isNotNull()
    return {"k1": F.when(some, F.xxhash64(text)), "k2": F.when(some, F.hash(text))}


def _templates(row: DataFrame, lines: DataFrame, min_docs: int) -> DataFrame:
    """path, template (null for none), n_same: the tokens that another text has there too. row: k1, k2, text; lines: k1, k2, line, path, leaf, n."""
    one = F.min(F.struct("k1", "k2", "line")).alias("at")
    texts = lines.groupBy("path", "leaf", "n", "k1", "k2").agg(F.min("line").alias("line")).groupBy("path", "leaf", "n").agg(F.count("*").alias("texts"), one)
    texts = written(texts, "paths")
    leaves = texts.groupBy("leaf").agg(F.sum("texts").alias("in_leaf"), F.count("*").alias("paths"))
    # a line that is alone in its leaf is compared with itself only
    alone = leaves.where("paths = 1 and in_leaf >= 2").join(texts, "leaf").select("path", F.when(F.col("texts") >= min_docs, F.col("path")).alias("template"), F.col("n").alias("n_same"))
    mixed = written(texts.join(leaves.where("paths > 1"), "leaf").select("path", "leaf", "n", "texts", "in_leaf", "at"), "mixed")
    wanted = mixed.select("at.*", "path").groupBy("k1", "k2").agg(F.collect_list(F.struct("line", "path")).alias("wanted"))
    found = row.join(wanted.hint("merge"), ["k1", "k2"]).select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("at")).select("at.path", _tokens(F.get("lines", "at.line")).alias("tokens"))
    rest = F.slice("tokens", _depth(F.size("tokens")) + 1, F.greatest(F.size("tokens"), F.lit(1)))
    found = found.select("path", F.transform(rest, lambda t: F.hash(t)).alias("rest")).distinct()  # equal texts bring a line again
    places = written(mixed.drop("at").join(found, "path").select("path", "leaf", "n", "texts", "in_leaf", F.posexplode_outer("rest").alias("place", "token")), "places")
    held = places.where("token is not null").groupBy("leaf", "place", "token").agg(F.sum("texts").alias("held")).where("held >= 2")
    marked = places.join(held, ["leaf", "place", "token"], "left")
    fixed = F.when(F.col("held") >= min_docs, F.struct("place", "token"))
    own = marked.groupBy("path", "leaf", "n", "in_leaf").agg(F.sort_array(F.collect_list(fixed)).alias("fixed"), F.count("held").cast("int").alias("same"))
    head = _depth(F.col("n"))
    n_fixed = F.when(F.col("in_leaf") >= min_docs, head + F.size("fixed")).otherwise(0)
    template = F.when(n_fixed == F.col("n"), F.col("path")).when(2 * n_fixed >= F.col("n"), F.xxhash64("leaf", "fixed"))
    like = own.select("path", "n", template.alias("template"), (head + F.col("same")).alias("n_same")).where("2 * n_same >= n").drop("n")
    out = written(like.union(alone), "templates")
    discard(texts, mixed, places)
    return out


def recurring_lines(df: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """k1, k2 (of a text), cut: the numbers of its lines, from 0 on, that belong to recurring templates."""
    row = df.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull()).withColumns(_keys("text"))
    parsed = written(row.select("k1", "k2", F.transform(F.split("text", "\n"), _line).alias("lines")), "lines")
    lines = parsed.select("k1", "k2", F.posexplode("lines").alias("line", "at")).select("k1", "k2", "line", "at.*").where("n > 0")
    templates = _templates(row, lines, min_docs)
    hits = written(lines.select("k1", "k2", "line", "path").join(templates, "path").select("k1", "k2", "line", "template", "n_same"), "template-lines")
    sizes = parsed.select("k1", "k2", F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n"))
    # rows of equal texts add the same to either sum
    both = hits.groupBy("k1", "k2").agg(F.sum("n_same").alias("same")).join(sizes.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), ["k1", "k2"])
    copies = both.where((100 * F.col("same") >= COPIED * F.col("n")) & (F.col("n") >= SHORT * F.col("rows"))).select("k1", "k2", F.lit(1).alias("copy"))
    held = hits.where("template is not null").select("template", "k1", "k2").distinct().join(copies, ["k1", "k2"], "left")
    recurring = held.groupBy("template").agg(F.count("*").alias("texts"), F.count("copy").alias("copies")).where((F.col("texts") >= min_docs) & (F.col("texts") >= 2 * F.col("copies"))).select("template")
    spread = recurring.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a row for each recurring template: a hot one's lines go to SALTS tasks
    cut = written(hits.withColumn("salt", F.pmod("k2", F.lit(SALTS))).join(spread, ["template", "salt"]).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("line")).alias("cut")), "cut-lines")
    discard(parsed, templates, hits)
    return cut


def drop_recurring_lines(df: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, counts: bool = False) -> DataFrame:
    """The table with the lines of recurring templates cut from its texts; other columns as they are.

    With counts, the columns n_lines and n_dropped follow. A null text stays null (0 lines), an empty
    text is one blank line, blank lines are never dropped; a document that loses all its lines stays,
    with an empty text. Rows are told apart by their texts alone: ids may be null or repeated, repeated
    rows are one text and each is cut. An empty table gives no rows. Columns may have any names.
    """
    cut = recurring_lines(df, text_col, min_docs).withColumnsRenamed({"k1": "c1", "k2": "c2"})
    row = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("own_text")).withColumns(_keys("own_text"))
    both = row.join(cut.hint("merge"), (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    all_lines, at = F.split("own_text", "\n"), F.col("cut")
    # what stands between one cut line and the next
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(at)), lambda i: F.slice(F.col("lines"), F.coalesce(F.get(at, i - 1), F.lit(-1)) + 2, F.coalesce(F.get(at, i), F.size("lines")) - F.coalesce(F.get(at, i - 1), F.lit(-1)) - 1)))
    done = both.withColumn("lines", all_lines).withColumn("kept_text", F.when(at.isNull(), F.col("own_text")).otherwise(F.array_join(kept, "\n")))
    out = [F.col("kept_text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns]
    if counts:
        out += [F.when(F.col("own_text").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long").alias("n_lines"), F.when(at.isNull(), F.lit(0)).otherwise(F.size(at)).cast("long").alias("n_dropped")]
    return done.select(*out)


def line_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of what is left, UTF-8; of nothing for a null text)."""
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cut = drop_recurring_lines(texts, "text", min_docs, counts=True)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same in DuckDB's SQL: templates by their text, char 1 for a variable field.
LINES_SQL = r"""
WITH split AS (
  SELECT text, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM (SELECT DISTINCT text FROM {docs} WHERE text IS NOT NULL)),
parsed AS (
  SELECT text, i, line, list_filter(regexp_split_to_array(regexp_replace(line, '[^ \t\x0B\f\r]*[0-9@/][^ \t\x0B\f\r]*', '<*>', 'g'), '[ \t\x0B\f\r]+'), lambda t: t <> '') AS tokens FROM split),
kinds AS (
  SELECT tokens, len(tokens) AS n, tokens[1:CASE WHEN len(tokens) < 12 THEN 2 ELSE 4 END] AS head, count(DISTINCT text) AS texts FROM parsed WHERE len(tokens) > 0 GROUP BY ALL),
leaves AS (
  SELECT n, head, sum(texts) AS in_leaf FROM kinds GROUP BY ALL),
places AS (
  SELECT tokens, n, head, texts, p, tokens[p] AS token FROM kinds, unnest(range(len(head) + 1, n + 1)) AS t(p)),
held AS (
  SELECT n, head, p, token, sum(texts) AS held FROM places GROUP BY ALL),
ends AS (
  SELECT places.tokens, count(*) FILTER (WHERE held >= 2) AS same, count(*) FILTER (WHERE held >= 3) AS fixed, string_agg(CASE WHEN held >= 3 THEN token ELSE chr(1) END, ' ' ORDER BY p) AS more
  FROM places JOIN held USING (n, head, p, token) GROUP BY places.tokens),
templates AS (
  SELECT tokens, len(head) + coalesce(same, 0) AS n_same, CASE WHEN in_leaf >= 3 AND 2 * (len(head) + coalesce(fixed, 0)) >= n THEN concat_ws(' ', n, array_to_string(head, ' '), more) END AS template
  FROM kinds JOIN leaves USING (n, head) LEFT JOIN ends USING (tokens) WHERE in_leaf >= 2 AND 2 * (len(head) + coalesce(same, 0)) >= n),
hits AS (
  SELECT text, i, template, n_same FROM parsed JOIN templates USING (tokens)),
copies AS (
  SELECT text, true AS copy FROM (SELECT text, sum(len(tokens)) AS n FROM parsed GROUP BY text) JOIN (SELECT text, sum(n_same) AS same FROM hits GROUP BY text) USING (text) WHERE n >= 20 AND 100 * same >= 85 * n),
recurring AS (
  SELECT template FROM (SELECT DISTINCT template, text FROM hits WHERE template IS NOT NULL) LEFT JOIN copies USING (text) GROUP BY template HAVING count(*) >= greatest(3, 2 * count(copy))),
cut AS (
  SELECT text, i FROM hits SEMI JOIN recurring USING (template)),
report AS (
  SELECT text, count(*) AS n_lines, count(cut.i) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE cut.i IS NULL) AS kept FROM parsed LEFT JOIN cut USING (text, i) GROUP BY text)
"""
LINE_REPORT_SQL = LINES_SQL.format(docs="documents") + """
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN report r ON d.text = r.text
"""
