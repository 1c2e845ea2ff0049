"""Line dedup by a log-template tree, in DataFrame operations only.

The tree has a fixed depth: a line goes by its number of tokens, then by its LEAD leading tokens, to a leaf. Tokens with
a digit are variable fields from the start, if enough of the line is left; else the line stands for itself. In a leaf, a
position's token stays in the template if lines with it there are in min_docs documents, whatever else the leaf holds;
else the field is generalised. A line takes the generalised template if at least `fixed` of all its tokens and half of
those after the leading ones stay, and else keeps its own. A template that occurs in min_docs documents or more is
recurring: its first line stays, all others are dropped. Lines too short for the tree count by their exact text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_text, materialise, quoted, unused

LEAD = 3
FIELD = "<*>"
#: least share of the tokens after the leading ones that a template has in common
TAIL = 0.5
#: parts that a leaf's lines are dealt into where they are joined with what is known of the leaf
PARTS = 16


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)


def _masked(text: Column, fixed: float) -> Column:
    """The lines of a text with single blanks, each with FIELD for its tokens with a digit if enough of it is left.

    Lambda variables make each step run once a line; the patterns run only where they can match, and take a token from
    its start on without going back."""
    flat = F.transform(F.split(text, "\n"), lambda line: F.trim(F.when(line.rlike("  |[\t\r]"), F.regexp_replace(line, "[ \t\r]+", " ")).otherwise(line)))

    def mask(line: Column) -> Column:
        n = _count(line, " ") + 1
        fields = F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)
        return F.transform(
            F.array(fields), lambda m: F.when((n - _count(m, FIELD) >= fixed * n) & (n - LEAD - (_count(m, FIELD) - _count(F.substring_index(m, " ", LEAD), FIELD)) >= TAIL * (n - LEAD)), m).otherwise(line)
        )[0]

    return F.transform(flat, lambda line: F.when(line.rlike("[0-9]") & line.rlike(" [^ ]+ [^ ]+ "), mask(line)).otherwise(line))


def line_table(docs: DataFrame, min_tokens: int, fixed: float) -> DataFrame:
    """doc_id, h (hash of the text), pos, th (hash of the masked line), leaf (null for short lines), masked: lines of min_tokens tokens or more."""
    # the hash is made below the generator: above it, each line would carry and hash its whole text
    rows = ids_text(docs).withColumn("h", F.xxhash64("text")).select("doc_id", "h", F.posexplode(_masked(F.col("text"), fixed)).alias("pos", "masked"))
    # tokens are counted by their blanks: no array is made of lines that go no further
    rows = rows.withColumn("n", F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1).where((F.col("n") >= min_tokens) & (F.col("masked") != ""))
    lead = F.when(F.col("n") > LEAD, F.xxhash64("n", F.substring_index("masked", " ", LEAD)))
    return rows.select("doc_id", "h", "pos", F.xxhash64("masked").alias("th"), lead.alias("leaf"), "masked")


def templates(lines: DataFrame, texts: DataFrame, min_docs: int, fixed: float) -> DataFrame:
    """th -> template, for the lines that can share one with others.

    lines: th, leaf, docs (documents of each masked line); texts: th, masked of all lines. Only leaves with two masked
    lines or more, in min_docs documents or more together, are looked into."""
    lines = lines.where("leaf is not null")
    part = lambda of: F.pmod(F.col(of), F.lit(PARTS)).alias("part")
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("docs").alias("docs")).where((F.col("lines") > 1) & (F.col("docs") >= min_docs)).select("leaf", parts)
    wanted = lines.select("th", "leaf", "docs", part("th")).join(leaves, ["leaf", "part"]).drop("part")
    # each task's lines are made distinct before they are dealt out
    own = texts.dropDuplicates(["th"]).join(wanted, "th").withColumn("tokens", F.split("masked", " "))
    # the leading tokens are equal all over a leaf
    led = F.size(F.filter(F.slice("tokens", 1, LEAD), lambda t: t != FIELD))
    fields = own.select("th", "leaf", "docs", part("th"), F.size("tokens").alias("n"), led.alias("led"), F.posexplode(F.slice("tokens", LEAD + 1, F.size("tokens"))).alias("at", "token"))
    fields = materialise(fields, "fields")
    agreed = fields.where(F.col("token") != FIELD).groupBy("leaf", "at", "token").agg(F.sum("docs").alias("d")).where(F.col("d") >= min_docs)
    named = fields.join(agreed.select("leaf", "at", "token", parts, F.lit(1).alias("stays")), ["leaf", "at", "token", "part"], "left")
    kept = F.when(F.col("stays").isNotNull(), F.col("token"))
    whole = named.groupBy("th", "leaf", "n", "led").agg(F.count(kept).alias("c"), F.array_sort(F.collect_list(F.struct("at", F.coalesce(kept, F.lit(FIELD)).alias("t")))).alias("t"))
    enough = (F.col("c") + F.col("led") >= fixed * F.col("n")) & (F.col("c") >= TAIL * (F.col("n") - LEAD))
    return whole.where(enough).select("th", F.xxhash64("leaf", F.array_join(F.col("t.t"), " ")).alias("template"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = 5, min_tokens: int = 2, fixed: float = 0.7, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """documents with the lines of recurring templates dropped from all documents but the first.

    All columns stay; text is the kept lines joined by newlines; two more columns at the end count the lines and those
    dropped, with the names in `counts`, after underscores where docs has such a name. The first line of a template is
    that of the least doc_id, then the least hash of the text, then the first position. Empty lines and lines of fewer
    than min_tokens tokens are never dropped. Null text: stays null, no lines. Rows that repeat, with one doc_id and
    text, count as one document and are treated alike. Null doc_ids come first. An empty table gives an empty result.
    Other columns may have any name."""
    lines = line_table(docs, min_tokens, fixed)
    held = materialise(lines.drop("masked"), "lines")
    per_doc = held.groupBy("th", "doc_id", "h").agg(F.min("leaf").alias("leaf"), F.min("pos").alias("pos"))
    masked = materialise(per_doc.groupBy("th").agg(F.first("leaf").alias("leaf"), F.count("*").alias("docs"), F.min(F.struct("doc_id", "h", "pos")).alias("first")), "masked")
    general = materialise(templates(masked, lines.select("th", "masked"), min_docs, fixed), "templates")

    # generalised templates count each document once; all others have their count already
    named = held.join(general, "th")
    grown = named.groupBy("template", "doc_id", "h").agg(F.min("pos").alias("pos")).groupBy("template").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "h", "pos")).alias("first"))
    plain = masked.join(general, "th", "left_anti").select(F.col("th").alias("template"), "docs", "first", F.lit(0).alias("kind"))
    recurring = plain.union(grown.select("template", "docs", "first", F.lit(1).alias("kind"))).where(F.col("docs") >= min_docs)
    recurring = materialise(recurring.select("template", "kind", "first"), "recurring")
    one = held.join(recurring.where("kind = 0").select(F.col("template").alias("th"), "first"), "th").select("doc_id", "h", "pos", "first")
    two = named.join(recurring.where("kind = 1").select("template", "first"), "template").select("doc_id", "h", "pos", "first")
    i, h, gone, key = unused(docs, "__id", "__h", "__gone", "__key")
    found = one.union(two).where(~F.struct("doc_id", "h", "pos").eqNullSafe(F.col("first"))).groupBy("doc_id", "h").agg(F.collect_set("pos").alias(gone))
    found = found.select(F.col("doc_id").alias(i), F.col("h").alias(h), gone)

    cols = docs.columns
    joined = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(key) == F.col(h)), "left")
    split = F.split("text", "\n")
    kept = F.array_join(F.filter(split, lambda x, at: ~F.array_contains(gone, at)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(split))
    dropped = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone))
    names = unused(docs, *counts)
    return joined.select(*(text.alias(c) if c == "text" else quoted(c) for c in cols), n_lines.cast("long").alias(names[0]), dropped.cast("long").alias(names[1]))
