"""Line dedup by a fixed-depth template tree, all in DataFrame functions.

Every line with a letter descends a tree of fixed depth: first by its number of tokens (runs of characters other
than \\x09-\\x0D and \\x20), then by its first DEPTH tokens, with each run of ASCII digits read as one variable
field. The leaf is the line's template: what comes after the leading tokens is variable, as far as the token
count stays the same. Lines without a letter (blank, numbers, rules) have no template, are kept, and are passed over
when lines are said to be neighbours.

A template is frequent if it stands in MIN_DOCUMENTS different texts (SHORT_DOCUMENTS, if it has fewer than SHORT_TOKENS
tokens: such lines recur by chance). On either side it is open if what stands there differs from text to text: if the
neighbours there, told apart by their first COMPANY tokens (and the text's edge as one more), are MIN_DOCUMENTS or more
and at least one for SHARE of its texts. Frequent lines that follow each other in a text belong to one block where
neither side between them is open. A block is set into documents, and is dropped whole, if one of its ends is open;
so a footer of ten lines goes like one of a single line. The lines of a document that was copied, exactly or with
edits, keep the same company on both sides in most copies: they are a block without an open end, and are left to
near-duplicate removal. Documents themselves all stay.

A null text stays null (0 lines). Texts that repeat, whatever their doc_id, count once, and all rows get the same
result. Empty tables give no rows; other columns pass through. A template's texts and neighbours are counted by partial
sums, so a line that a third of all documents have is no hot group; a text's own lines are the largest thing that is
ordered together. Hashes of 64 bits stand for lines, texts and templates in all that is shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, fresh, read_table, settle

DEPTH = 8
COMPANY = 4
MIN_DOCUMENTS = 5
SHORT_TOKENS, SHORT_DOCUMENTS = 3, 20
SHARE = 5


def _masked_lines(text: Column) -> Column:
    """The lines of a text with digit runs masked and other white space as single spaces; most texts need neither.

    Conditions read the text itself: an expression that is named twice here would be computed twice.
    """
    masked = F.when(text.rlike("[0-9]"), F.regexp_replace(text, "[0-9]+", "<*>")).otherwise(text)
    odd = [F.contains(text, F.lit(c)) for c in ("  ", "\t", "\x0b", "\x0c", "\r")]
    spaced = F.regexp_replace(masked, "[\\x09\\x0B-\\x0D ]{2,}|[\\x09\\x0B-\\x0D]", " ")
    return F.split(F.when(reduce(or_, odd), spaced).otherwise(masked), "\n", -1)


def _entry(line: Column, pos: Column) -> Column:
    """A trimmed, masked line: its place, its leaf (the last bit tells a short line; null without a letter), its company."""
    spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    path = F.xxhash64(spaces, F.substring_index(line, " ", DEPTH))
    short = F.when(spaces < SHORT_TOKENS - 1, F.lit(1)).otherwise(F.lit(0)).cast("long")
    leaf = F.when(line.rlike("\\p{L}"), F.shiftleft(F.shiftright(path, 1), 1) + short)
    return F.struct(pos.alias("pos"), leaf.alias("leaf"), F.xxhash64(F.substring_index(line, " ", COMPANY)).alias("head"))


def template_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """(text_hash, idx, pos, leaf, prev, next) of each line of each row that has a template.

    pos is its place among all lines, idx among those with a template; prev and next are the company there, 0 at an edge.
    """
    trimmed = texts.select(F.xxhash64(col(text)).alias("text_hash"), F.transform(_masked_lines(col(text)), lambda x: F.trim(x)).alias("lines"))
    entries = trimmed.select("text_hash", F.filter(F.transform("lines", _entry), lambda x: x["leaf"].isNotNull()).alias("own"))
    edge = F.lit(0).cast("long")
    beside = lambda i: F.coalesce(F.get("own", i)["head"], edge)
    rows = F.transform("own", lambda x, i: F.struct(i.alias("idx"), x["pos"], x["leaf"], beside(i - 1).alias("prev"), beside(i + 1).alias("next")))
    return entries.select("text_hash", F.explode(rows).alias("x")).select("text_hash", "x.*")


def frequent(lines: DataFrame) -> DataFrame:
    """(leaf, n_texts) of the templates that stand in enough different texts."""
    counts = lines.select("leaf", "text_hash").distinct().groupBy("leaf").agg(F.count("*").alias("n_texts"))
    least = F.when(F.col("leaf").bitwiseAND(1) == 1, SHORT_DOCUMENTS).otherwise(MIN_DOCUMENTS)
    return counts.where(F.col("n_texts") >= least)


def sides(lines: DataFrame) -> DataFrame:
    """(leaf, before, after): whether each template's sides are open. A text that has it several times counts by the first."""
    once = lines.groupBy("leaf", "text_hash").agg(F.min_by("prev", "idx").alias("prev"), F.min_by("next", "idx").alias("next"))
    both = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("company")) for i, c in enumerate(("prev", "next"))])
    per = once.select("leaf", F.explode(both).alias("s")).groupBy("leaf", "s.side", "s.company").agg(F.count("*").alias("n"))
    counts = per.groupBy("leaf").agg(
        F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("n_texts"),
        F.count(F.when(F.col("side") == 0, 1)).alias("prev"),
        F.count(F.when(F.col("side") == 1, 1)).alias("next"),
    )
    is_open = lambda c: (F.col(c) >= MIN_DOCUMENTS) & (F.col(c) * SHARE >= F.col("n_texts"))
    return counts.select("leaf", is_open("prev").alias("before"), is_open("next").alias("after"))


def block_drops(lines: DataFrame, opened: DataFrame) -> DataFrame:
    """(text_hash, flags, n_dropped): for each text that loses lines, true at the places of those, up to the last."""
    in_order = W.partitionBy("text_hash").orderBy("idx")
    marked = lines.join(opened, "leaf").select("text_hash", "idx", "pos", "before", "after")
    bound = (F.lag("idx").over(in_order) == F.col("idx") - 1) & ~F.lag("after").over(in_order) & ~F.col("before")
    starts = F.when(F.coalesce(bound, F.lit(False)), 0).otherwise(1)
    blocks = marked.withColumn("starts", starts).withColumn("block", F.sum("starts").over(in_order))
    # inside a block no side is open: one that is, is its end's
    gone = blocks.withColumn("gone", F.max(F.col("before") | F.col("after")).over(W.partitionBy("text_hash", "block"))).where("gone")
    gap = F.col("pos") - F.coalesce(F.lag("pos").over(in_order), F.lit(-1)) - 1
    lists = gone.withColumn("gap", gap).groupBy("text_hash").agg(F.sort_array(F.collect_list(F.struct("pos", "gap"))).alias("gone"))
    flags = F.flatten(F.transform("gone", lambda x: F.concat(F.array_repeat(F.lit(False), x["gap"]), F.array(F.lit(True)))))
    return lists.select("text_hash", flags.alias("flags"), F.size("gone").alias("n_dropped"))


def drop_recurring_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the lines of recurring blocks dropped from `text`, and long columns n_lines and n_dropped.

    If docs has columns of those names already, the new ones get leading underscores.
    """
    lines = settle(template_lines(docs.where(col(text).isNotNull()), text))
    often = settle(frequent(lines).select("leaf"))
    some = settle(lines.join(often, "leaf", "left_semi").distinct())  # a text that repeats has its lines once
    drops = settle(block_drops(some, settle(sides(some))))
    key, flags, gone = fresh(docs, "text_hash"), fresh(docs, "flags"), fresh(docs, "gone")
    n_lines, n_dropped = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    hashed = docs.withColumn(key, F.when(col(text).isNotNull(), F.xxhash64(col(text))))
    # the texts with drops grow with the input, so they are never broadcast; AQE splits a text with many copies
    found = drops.select(F.col("text_hash").alias(key), F.col("flags").alias(flags), F.col("n_dropped").alias(gone)).hint("merge")
    joined = hashed.join(found, key, "left")
    split = F.split(col(text), "\n", -1)
    kept = F.array_join(F.filter(split, lambda x, i: ~F.coalesce(F.get(col(flags), i), F.lit(False))), "\n")
    return joined.select(
        *[F.when(col(flags).isNull(), col(c)).otherwise(kept).alias(c) if c == text else col(c) for c in docs.columns],
        F.when(col(text).isNull(), F.lit(0)).otherwise(F.size(split)).cast("long").alias(n_lines),
        F.coalesce(col(gone), F.lit(0)).cast("long").alias(n_dropped),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without the lines of recurring blocks, with its numbers of lines and of dropped lines."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


#: The rule as the docstring states it, over strings in place of hashes.
SQL = f"""
WITH d AS (SELECT doc_id, text, dense_rank() OVER (ORDER BY text) AS t FROM documents),
u AS (SELECT t, any_value(text) AS text FROM d WHERE text IS NOT NULL GROUP BY t),
m AS (SELECT t, string_split(regexp_replace(regexp_replace(text, '[0-9]+', '<*>', 'g'),
        '[\\x09\\x0B-\\x0D ]+', ' ', 'g'), chr(10)) AS ls FROM u),
l AS (SELECT t, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM m),
k AS (SELECT t, pos, string_split(trim(line, ' '), ' ') AS w FROM l WHERE regexp_matches(line, '\\pL')),
a AS (SELECT t, pos, len(w) AS n, len(w) || ':' || array_to_string(w[1:{DEPTH}], ' ') AS leaf,
        array_to_string(w[1:{COMPANY}], ' ') AS head, row_number() OVER (PARTITION BY t ORDER BY pos) AS idx FROM k),
n AS (SELECT *, coalesce(lag(head) OVER (PARTITION BY t ORDER BY pos), '') AS prev,
        coalesce(lead(head) OVER (PARTITION BY t ORDER BY pos), '') AS next FROM a),
f AS (SELECT leaf FROM n GROUP BY leaf
        HAVING count(DISTINCT t) >= CASE WHEN min(n) < {SHORT_TOKENS} THEN {SHORT_DOCUMENTS} ELSE {MIN_DOCUMENTS} END),
o AS (SELECT leaf, t, arg_min(prev, idx) AS prev, arg_min(next, idx) AS next FROM n SEMI JOIN f USING (leaf) GROUP BY leaf, t),
s AS (SELECT leaf, count(DISTINCT prev) >= {MIN_DOCUMENTS} AND count(DISTINCT prev) * {SHARE} >= count(*) AS before,
        count(DISTINCT next) >= {MIN_DOCUMENTS} AND count(DISTINCT next) * {SHARE} >= count(*) AS after FROM o GROUP BY leaf),
b AS (SELECT n.t, n.pos, n.idx, s.before, s.after, coalesce(lag(n.idx) OVER p = n.idx - 1 AND NOT lag(s.after) OVER p
        AND NOT s.before, false) AS bound FROM n JOIN s USING (leaf) WINDOW p AS (PARTITION BY n.t ORDER BY n.idx)),
g AS (SELECT *, count(*) FILTER (NOT bound) OVER (PARTITION BY t ORDER BY idx) AS block FROM b),
h AS (SELECT t, block FROM g GROUP BY t, block HAVING arg_min(before, idx) OR arg_max(after, idx)),
x AS (SELECT t, pos FROM g SEMI JOIN h USING (t, block)),
r AS (SELECT t, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM u),
c AS (SELECT r.t, string_agg(r.line, chr(10) ORDER BY r.pos) FILTER (x.pos IS NULL) AS kept,
        CAST(count(*) AS BIGINT) AS n_lines, CAST(count(x.pos) AS BIGINT) AS n_dropped
        FROM r LEFT JOIN x ON r.t = x.t AND r.pos = x.pos GROUP BY r.t)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE c.n_lines END AS n_lines,
  CASE WHEN d.text IS NULL THEN 0 ELSE c.n_dropped END AS n_dropped,
  CASE WHEN d.text IS NOT NULL THEN coalesce(c.kept, '') END AS text
FROM d LEFT JOIN c ON d.t = c.t
"""

QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLE_SQL = {"op4_line_dedup": SQL}
