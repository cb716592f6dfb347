"""Secret scan: fixed patterns, and random-looking strings by a ratio of two character Markov models.

Everything is DataFrame functions. A pattern's matches come from regexp_extract_all, what lies between them from split, and
running sums of their lengths give the positions. Candidate strings are scored by the log-likelihood ratio of a Markov model
of random strings against one of ordinary identifiers, both counted from labelled samples.
"""

from __future__ import annotations

import math
import random
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Strings worth scoring: whole runs of so many characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
#: States of the models: each letter, one state for digits and one for the rest.
STATES = string.ascii_lowercase + string.ascii_uppercase + "0+"
SAMPLES, SMOOTH = 6000, 0.5
#: Log-likelihood ratio, in all and for each step, from which a string counts as random.
LEAST_RATIO, LEAST_STEP = 12.0, 0.45
#: A string of fewer different characters is a separator or filler.
LEAST_DISTINCT = 7
#: Words of which ordinary identifiers are made, beside words made of syllables.
WORDS = (
    "account action address alert amount array asset auth balance batch block body buffer build cache call change channel check client code "
    "column command commit config connect content context control count create cursor data date default delete detail device document "
    "download driver element enable engine entry error event export factory field file filter flag folder format function global group "
    "handler header history image import index info input instance item iterator job json key label layer length level library limit line "
    "link list load local location logger login manager match member memory merge message method mode module monitor name network node "
    "number object option order output package page parameter parent password path policy position prefix process product profile project "
    "provider public query queue range record region register remote render report request reset resource result role root rule sample "
    "schema scope search section server session the and of that with this have from they will"
).split()
ONSETS = "b c d f g h j k l m n p r s t v w z br ch cz dr dz gr kr kw ll mn pl pr rz sch sh sk sl sn sp st str sw sz th tr vr zw".split() + [""] * 6
VOWELS = "a e i o u y a e i o ai au ea ei eu ia ie io oe oo ou ue ui".split()
CODAS = [""] * 4 + "n r s t l m k d ch ck ng nn ss st rt wski tz".split()
ROWS = [string.ascii_lowercase, string.ascii_uppercase, string.digits, string.ascii_lowercase + string.digits, "qwertyuiopasdfghjklzxcvbnm", string.ascii_lowercase[::-1]]
ALPHABETS = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"]


def _ordinary(r: random.Random) -> str:
    """An identifier, compound, path, address, date, separator, alphabet or row of numbers."""
    made = lambda: "".join(r.choice(ONSETS) + r.choice(VOWELS) + r.choice(CODAS) for _ in range(r.randint(1, 5)))
    number = lambda: str(r.randint(0, 10 ** r.randint(1, 6)))
    word = lambda: r.choice(WORDS) if r.random() < 0.5 else made()
    words, style = [word() for _ in range(r.randint(3, 7))], r.randrange(14)
    if style < 4:
        return r.choice("_-/").join(words)
    if style == 4:
        return "_".join(words).upper()
    if style == 5:
        return "".join(words)
    if style < 8:
        return words[0] + "".join(w.title() for w in words[1:])
    if style == 8:
        return r.choice("_-/").join(w + r.choice(["", "", number()]) for w in words)
    if style == 9:
        return r.choice(["https/", "www-", "http-", ""]) + "-".join(words) + r.choice(["-org", "-com", "/wiki/"]) + made().title()
    if style == 10:
        day, time = (r.choice(["", "-"]).join(f"{r.randint(*x):02d}" for x in parts) for parts in (((1900, 2030), (1, 12), (1, 28)), ((0, 23), (0, 59), (0, 59))))
        return day + r.choice("T-_") + time + r.choice(["Z", "-" + word(), "_" + number(), "+0000"])
    if style == 11:
        unit = r.choice(["=", "-", "_", "+", "/", "=-", "-_", "/-", "0"]) if r.random() < 0.5 else r.choice(string.ascii_letters)
        return (unit * 44)[: r.randint(20, 44)]
    if style == 12:
        return (r.choice(ROWS) * 4)[r.randrange(26) :][: r.randint(20, 44)]
    return r.choice("-_/").join(number() for _ in range(r.randint(5, 9)))


def labelled_samples(seed: int = 4) -> list[tuple[str, int]]:
    """(string, 1 for random or 0 for ordinary): made by rule from a seed; another seed gives strings to measure on."""
    r, out = random.Random(seed), []
    for _ in range(SAMPLES):
        out += [("".join(r.choices(r.choice(ALPHABETS), k=r.randint(20, 44))), 1), (_ordinary(r), 0)]
    return out


def _state(c: Column) -> Column:
    """Number of a character's state from 0."""
    a = F.ascii(c)
    return F.when(a.between(97, 122), a - 97).when(a.between(65, 90), a - 39).when(a.between(48, 57), F.lit(52)).otherwise(F.lit(53))


def _steps(s: Column) -> Column:
    """The transitions of a string, each as one number."""
    chars = F.transform(F.split(s, ""), _state)
    n = F.greatest(F.lit(0), F.size(chars) - 1)
    return F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda a, b: a * len(STATES) + b)


def train(spark: SparkSession, samples: list[tuple[str, int]] | None = None) -> list[float]:
    """Log-likelihood ratio of every transition, random over ordinary. The counts have as many rows as there are transitions."""
    k = len(STATES)
    df = spark.createDataFrame(samples or labelled_samples(), "s string, y int")
    counts = [[SMOOTH] * (k * k) for _ in range(2)]
    for r in df.select("y", F.explode(_steps(F.col("s"))).alias("step")).groupBy("y", "step").count().collect():
        counts[r.y][r.step] += r["count"]
    logs = [[math.log(c / sum(row[i - i % k : i - i % k + k])) for i, c in enumerate(row)] for row in counts]
    return [b - a for a, b in zip(*logs, strict=True)]


def _ratio(s: Column, table: Column) -> Column:
    return F.aggregate(_steps(s), F.lit(0.0), lambda a, x: a + F.get(table, x))


def _matches(text: Column, kind: int, pattern: str, good) -> Column:
    """array<struct<kind, before, len, ok>>: the gap before each match, its length, whether it counts; in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    told = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit")),
        lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["gap"]).alias("before"), F.length(x["hit"]).alias("len"), good(x["hit"]).alias("ok")),
    )
    empty = F.array().cast("array<struct<kind:int,before:int,len:int,ok:boolean>>")
    return F.when(text.rlike(pattern), F.filter(told, lambda x: x["len"].isNotNull())).otherwise(empty)


def scan(spark: SparkSession, docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_random, base (spans of the first three kinds), spans (all).

    Spans are `kind:start:end` in code points, end exclusive, by start and then kind. Matches are leftmost and do not overlap
    within a kind; kinds may overlap. A null or empty text has none. Rows that repeat an id are told apart by their place.
    """
    table = table or train(spark)
    told = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    always = lambda m: m.isNotNull()
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= LEAST_VALUE

    def looks_random(m: Column) -> Column:
        ratio = _ratio(m, told)
        return (ratio >= LEAST_RATIO) & (ratio >= LEAST_STEP * F.length(m)) & (F.size(F.array_distinct(F.split(m, ""))) >= LEAST_DISTINCT)

    t = F.coalesce("text", F.lit(""))
    hits = F.concat(*(_matches(t, k, p, g) for k, (p, g) in enumerate(((ASSIGN, value), (ACCESS, always), (HEX, always), (CANDIDATE, looks_random)))))
    rows = docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    rows = rows.select("doc_id", "rid", F.posexplode_outer(hits).alias("at", "hit")).select("doc_id", "rid", "at", "hit.*")
    rows = rows.withColumn("end", F.sum(F.col("before") + F.col("len")).over(Window.partitionBy("rid", "kind").orderBy("at")))
    span = F.when(F.col("ok"), F.struct((F.col("end") - F.col("len")).alias("start"), "kind", "end"))
    out = rows.repartition("rid").groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("all"))
    names = F.array(*map(F.lit, KINDS))
    join = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select("doc_id", *map(count, range(4)), join(F.filter("all", lambda x: x["kind"] < 3)).alias("base"), join(F.col("all")).alias("spans"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents, base spans and those that the models add; nulls, ties and repeats as in scan()."""
    found = scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")
