"""Line deduplication with a log-template tree of fixed depth, in DataFrame functions only.

A line's tokens with digits become `<*>`, unless too few of its tokens are words. The tree's first level is the token count, the next LEAD levels are the leading
tokens; a leaf's lines vote on each further position, and a position without a majority token is a variable field. A line
that has all the fixed tokens of its leaf's template is counted under it, any other line under itself. A template is
boilerplate if it recurs in at least LEAST_TEXTS families of texts, or a long one in LEAST_LONG mostly original texts.

Exact copies are one text. A line's first and last words are its parts; a line neither part of which is in another text
is the text's own. Boilerplate is never a text's own, and an edited line of a near copy seldom is, as one of its parts is
mostly left. Texts are grouped by one of their parts that is about as frequent as most of theirs, so near copies come
together. Where most of a group have lines of their own, each of these is a family; any other group is one family.
Lines of boilerplate templates are dropped everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import BROADCAST_IDS, Workspace, spread_join

#: Shorter lines recur by chance and are left alone.
LEAST_TOKENS = 4
LEAD = 3
#: Families that a template must recur in; one of LONG tokens needs only so many texts, at least MOSTLY of whose lines are their own.
LEAST_TEXTS, LEAST_LONG, LONG, MOSTLY = 5, 2, 20, 0.5
#: Words of a line's part at most. Part of a text's lines that must be its own, part of a group's texts that must have such
#: lines, and part of the texts with a group's mark that must be in the group for it to count.
PART, OWN, GROUP, MARKED = 5, 0.1, 0.5, 0.5
#: Part of a leaf's lines that a token needs to stand in the template, and part of a template's tokens that must be fixed words.
MAJORITY, FIXED = 0.5, 0.6
FIELD = "<*>"
#: Bytes of the list of lines to drop, up to which it is broadcast.
BROADCAST_BYTES = 16 << 20


def _words(tokens: Column) -> Column:
    """Number of tokens with letters and no digit: neither fields nor punctuation."""
    return F.size(F.filter(tokens, lambda x: x.rlike(r"^[^0-9]*\p{L}[^0-9]*$")))


def _tokens(line: Column) -> Column:
    """Blank-separated tokens, those with digits generalised where the rest says enough: a row of numbers stands for itself."""
    general = F.array(F.split(F.regexp_replace(line, r"[^ 0-9]*[0-9][^ ]*", FIELD), " "))
    general = F.get(F.filter(general, lambda x: _words(x) >= FIXED * F.size(x)), F.lit(0))
    return F.coalesce(F.when(line.rlike("[0-9]"), general), F.split(line, " "))


def _leaf(tokens: Column) -> Column:
    return F.xxhash64(F.size(tokens), F.slice(tokens, 1, LEAD))


def _line(line: Column, tokens: Column) -> Column:
    """Hashes of a line as it stands and of its tokens, its leaf, its size, and the hashes of its first and last words; of all, where they are few."""
    n = F.size(tokens)
    size = F.when(n < LEAST_TOKENS, n).otherwise(F.least(F.lit(PART), F.floor(n / 2).cast("int")))
    head, tail = F.xxhash64(F.lit(0), F.slice(tokens, F.lit(1), size)), F.xxhash64(F.lit(1), F.slice(tokens, n - size + 1, size))
    return F.struct(F.xxhash64(line).alias("raw"), F.xxhash64(tokens).alias("key"), _leaf(tokens).alias("leaf"), n.alias("n"), head.alias("head"), tail.alias("tail"))


def _families(texts: DataFrame, work: Workspace) -> DataFrame:
    """(text_key, family, mostly) of every text: family is null where it counts for nothing, mostly tells a mostly original text."""
    of = lambda c: F.transform("lines", lambda x: x[c])
    again = texts.select(F.explode(F.array_distinct(F.concat(of("head"), of("tail")))).alias("part")).groupBy("part").agg(F.count("*").alias("n")).filter("n > 1")
    again = work.save(again.withColumn("rows", F.col("n")))
    rows = texts.select("text_key", F.explode("lines").alias("x")).select("text_key", "x.key", F.explode(F.array("x.head", "x.tail")).alias("part"))
    lines = spread_join(rows, again, ["part"], "rows", "inner").repartition("text_key").groupBy("text_key", "key").agg(F.max(F.struct("n", "part")).alias("x"))
    shared = lines.groupBy("text_key").agg(F.array_sort(F.collect_list("x")).alias("shared"))
    texts = texts.select("text_key", F.size(F.array_distinct(of("key"))).alias("lines")).join(shared.hint("merge"), "text_key", "left")
    texts = texts.withColumn("shared", F.coalesce("shared", F.array().cast("array<struct<n: bigint, part: bigint>>")))
    middle = F.get("shared", F.floor(F.size("shared") / 2).cast("int"))["n"]
    like = F.filter("shared", lambda x: (2 * x["n"] >= F.col("middle")) & (x["n"] <= 2 * F.col("middle")))
    texts = texts.withColumn("middle", middle).withColumn("mark", F.array_min(F.transform(like, lambda x: F.struct(F.xxhash64(x["part"]).alias("part"), x["n"].alias("n")))))
    own = F.col("lines") - F.size("shared")
    texts = work.save(texts.select("text_key", "mark.part", "mark.n", (own >= F.greatest(F.lit(1), OWN * F.col("lines"))).alias("own"), (own >= MOSTLY * F.col("lines")).alias("mostly")))
    groups = work.save(texts.filter("part is not null").groupBy("part").agg(F.count("*").alias("texts"), F.sum(F.col("own").cast("int")).alias("owns"), F.count("*").alias("rows")))
    free = F.col("own") & (F.col("mark").isNull() | (F.col("owns") >= GROUP * F.col("texts")))
    family = F.when(free, F.col("text_key")).when(F.col("texts") >= MARKED * F.col("n"), F.col("mark"))
    # a text without a mark gets a key of its own, so that such texts don't meet in one task
    texts = texts.select("text_key", F.col("part").alias("mark"), F.coalesce("part", "text_key").alias("part"), "n", "own", "mostly")
    return spread_join(texts, groups, ["part"], "rows").select("text_key", family.alias("family"), "mostly")


def _templates(rows: DataFrame, work: Workspace) -> DataFrame:
    """(leaf, key, template) from the different lines (leaf, lines, key, tokens) of the leaves, where a leaf has so many lines: those that agree with their leaf's template."""
    votes = rows.select("leaf", "lines", F.size("tokens").alias("size"), F.posexplode("tokens").alias("at", "token"))
    votes = votes.groupBy("leaf", "at", "token").agg(F.count("*").alias("n"), F.max("lines").alias("lines"), F.max("size").alias("size"))
    # a position has one token with a majority at most; what has none is a field, and never leaves this count
    fixed = votes.filter((F.col("n") > MAJORITY * F.col("lines")) & (F.col("token") != FIELD))
    shape = fixed.groupBy("leaf").agg(F.collect_list(F.struct("at", "token")).alias("fixed"), F.max("size").alias("size"), F.max("lines").alias("rows"))
    shape = shape.filter(_words(F.col("fixed")["token"]) >= FIXED * F.col("size"))
    shape = work.save(shape.select("leaf", "fixed", F.xxhash64("leaf", F.lit("template")).alias("template"), "rows"))
    fits = F.forall("fixed", lambda x: F.get("tokens", x["at"]) == x["token"])
    return spread_join(rows, shape, ["leaf"], "rows", "inner").filter(fits).select("leaf", "key", "template")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it is counted to be small: for tables of a few numbers a row."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def boilerplate(spark: SparkSession, docs: DataFrame, work: Workspace) -> DataFrame:
    """(text_key, raws, copies): for each different text that holds any, the hashes of its lines under recurring templates, and its copies."""
    raw = docs.filter("text is not null").select(F.xxhash64("text").alias("text_key"), F.array_distinct(F.split("text", "\n")).alias("lines"))
    told = F.filter(F.transform(F.transform("lines", lambda x: F.struct(x.alias("line"), _tokens(x).alias("tokens"))), lambda x: _line(x["line"], x["tokens"])), lambda x: x["n"] > 1)
    texts = work.save(raw.select("text_key", told.alias("lines")).groupBy("text_key").agg(F.first("lines").alias("lines"), F.count("*").alias("copies")))
    families = _families(texts.select("text_key", "lines"), work)
    keyed = texts.select("text_key", F.filter("lines", lambda x: x["n"] >= LEAST_TOKENS).alias("lines")).filter(F.size("lines") > 0)
    seen = keyed.join(families.hint("merge"), "text_key").select("text_key", "family", "mostly", F.explode("lines").alias("x"))
    seen = work.save(seen.select("text_key", "family", "mostly", "x.raw", "x.key", "x.leaf", (F.col("x.n") >= LONG).alias("long")))
    forms = seen.groupBy("leaf", "key", "family").agg(F.max("long").alias("long"), F.max(F.col("mostly") & (F.col("family") == F.col("text_key"))).alias("mostly"), F.min("text_key").alias("text_key"))
    forms = work.save(forms)
    # a leaf that may generalise: several different lines, in enough families
    lone = work.save(forms.groupBy("leaf", "key").agg(F.count("family").alias("families"), F.max("long").alias("long"), F.min("text_key").alias("text_key")))
    enough = F.col("families") >= F.when(F.col("long"), LEAST_LONG).otherwise(LEAST_TEXTS)
    leaves = work.save(lone.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("families").alias("families"), F.max("long").alias("long")).filter((F.col("lines") > 1) & enough).select("leaf", "lines"))
    # each of their lines is read again in one text that holds it
    there = work.save(lone.join(_small(leaves), "leaf", "left_semi").select("text_key").distinct())
    tokens = raw.join(_small(there), "text_key", "left_semi").select(F.explode(F.transform("lines", _tokens)).alias("tokens")).filter(F.size("tokens") >= LEAST_TOKENS)
    tokens = tokens.select("tokens", _leaf(F.col("tokens")).alias("leaf"), F.xxhash64("tokens").alias("key")).join(_small(leaves), "leaf")
    grown = work.save(_templates(work.save(tokens.groupBy("leaf", "key").agg(F.first("tokens").alias("tokens"), F.max("lines").alias("lines"))), work))
    under = forms.join(_small(grown), ["leaf", "key"], "left").withColumn("template", F.coalesce("template", "key"))
    spread = under.groupBy("template", "family").agg(F.max("long").alias("long"), F.max("mostly").alias("mostly"))
    spread = spread.groupBy("template").agg(F.count("family").alias("families"), F.max("long").alias("long"), F.count(F.when(F.col("mostly"), 1)).alias("mostly"))
    common = spread.filter((F.col("families") >= LEAST_TEXTS) | (F.col("long") & (F.col("mostly") >= LEAST_LONG))).select("template")
    drop = work.save(under.select("key", "template").distinct().join(common, "template").select("key").distinct())
    held = seen.select("text_key", "raw", "key").join(_small(drop), "key", "left_semi").groupBy("text_key").agg(F.collect_set("raw").alias("raws"))
    return work.save(held.join(texts.select("text_key", "copies"), "text_key"))


def drop_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with its text cut, and n_lines and n_dropped added (they replace columns of these names).

    A null text stays null with no lines; an empty one has one empty line, which stays. Lines of fewer than LEAST_TOKENS
    tokens stay. Repeated rows and copies are one text for the counts and lose the same lines; texts are told apart by a
    64-bit hash. Every line of a text is parsed, however long the text. An empty table gives no rows. Texts are moved only
    where the list of lines to drop is beyond BROADCAST_BYTES; a text with many copies then goes to several tasks.
    """
    work = Workspace(spark)
    docs = docs.drop("n_lines", "n_dropped")
    held = boilerplate(spark, docs.select("text"), work).withColumnRenamed("text_key", "_k").withColumnRenamed("raws", "_raws")
    size = held.agg(F.count("*"), F.sum(F.size("_raws"))).first()
    # a null text has a key of its own row, as all of them would meet in one task
    rows = docs.withColumn("_k", F.when(F.col("text").isNotNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.monotonically_increasing_id())))
    if 40 * size[0] + 8 * (size[1] or 0) <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(held.drop("copies")), "_k", "left")
    else:
        rows = spread_join(rows, held, ["_k"], "copies")
    cut = F.col("_raws").isNotNull() & F.col("text").isNotNull()
    rows = rows.withColumn("_kept", F.when(cut, F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_raws", F.xxhash64(x)))))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    left = F.when(F.col("_kept").isNotNull(), F.size("_kept").cast("long")).otherwise(n)
    rows = rows.withColumns({"n_lines": n, "n_dropped": n - left})
    return rows.withColumn("text", F.when(F.col("_kept").isNotNull(), F.array_join("_kept", "\n")).otherwise(F.col("text"))).select(*docs.columns, "n_lines", "n_dropped")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents: n_lines, n_dropped and the digest of what is left; nulls, ties and repeats as in drop_lines()."""
    out = drop_lines(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))
