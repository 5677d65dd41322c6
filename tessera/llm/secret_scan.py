"""Secret scans (DataFrame functions only): patterns of known kinds, and Markov models of strings.

Beside three fixed patterns, long tokens are judged by two first-order character Markov
models, one of random strings and one of ordinary words and identifiers, trained from
labelled samples.  Random samples are made by a rule: digests, base 64, upper-case keys,
UUIDs (such strings are random, whatever they are used for).  Ordinary samples are the
words of all documents, each counted as often as it occurs, and the pieces of identifiers
made of it (snake, kebab and camel case, paths, with numbers).  A model mixes counted
shares with a uniform one (``UNIFORM``), so ratios do not drift as counts grow.

A token whose log-likelihood ratio (random against ordinary) for each character reaches a
cutoff is a span of kind ``markov``, unless a span of the other kinds covers it.  The cutoff
is calibrated on strings that no model was trained on: all words of one hash fold, joined to
identifiers, and other random strings.  It lies halfway between what all but one in a
thousand of the identifiers stay below and what all but one in a hundred of the random
strings reach (but never below the first of the two).

Spans are in code points, end exclusive.  A pattern's matches are the stretches between
the parts of a split by it, so places come from running sums of lengths.

Defined results: null texts are empty and have no spans; repeated rows each get their
row; empty tables give empty results; a class without samples is uniform, and without
words to calibrate on the cutoff is ``MIN_RATIO``; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, table, words

#: Kinds in the order they are listed, with their pattern; ``assign`` needs a value of 6 characters.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
MIN_VALUE, MIN_TOKEN = 6, 20
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
MIN_RATIO, UNIFORM = 0.4, 0.02
#: Characters of tokens lie between + and z; a model is a square table over that range.
LOW, SPAN = 43, 80
#: Characters of tokens, and how many of them there are.
ALPHABET, LETTERS = "[^A-Za-z0-9+/_.=-]", 68
#: Random strings to train from (made by a rule, there is no table of them); words of the calibration fold (one in FOLDS)
#: that are joined among each other, about; parts of 1 that shares of the calibration are told apart by.
SAMPLE_STRINGS, BLOCK_WORDS, FOLDS, BINS = 4000, 1000, 5, 1000


def running(values: Column) -> Column:
    """Running sums before each element, in blocks of about the square root of the length."""

    def in_blocks(v: Column) -> Column:
        b = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(b, F.lit(1)) - 1), lambda j: F.slice(v, j * b + 1, b))
        total = lambda x: F.aggregate(x, F.lit(0), lambda a, e: a + e)

        def offsets(x: Column) -> Column:
            return let(F.transform(x, total), lambda s: F.transform(s, lambda _, j: total(F.slice(s, 1, j))))

        def inside(x: Column, before: Column) -> Column:
            return F.flatten(F.transform(x, lambda y, j: F.transform(y, lambda _, i: F.get(before, j) + total(F.slice(y, 1, i)))))

        return let(blocks, lambda x: let(offsets(x), lambda before: inside(x, before)))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(values, in_blocks))


def matches(text: Column, pattern: str, kind: str, group: int = 0, least: int = 1) -> Column:
    """Array of (start, nth kind, end, found) of the leftmost non-overlapping matches whose ``group`` has ``least`` characters."""
    found = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))

    def placed(gaps: Column, all_found: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, 1, F.size(all_found)), all_found, lambda g, f: F.char_length(g) + F.char_length(f))

        def spans(before: Column) -> Column:
            start = lambda i: F.get(before, i) + F.char_length(F.get(gaps, i))
            return F.transform(all_found, lambda f, i: F.struct(start(i).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start(i) + F.char_length(f)).alias("end"), f.alias("found")))

        return let(running(steps), spans)

    spans = let(F.split(text, pattern), lambda gaps: let(found(0), lambda f: placed(gaps, f)))
    if least > 1:
        spans = let(found(group), lambda values: F.filter(spans, lambda _, i: F.char_length(F.get(values, i)) >= least))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def train(samples: DataFrame) -> list[float]:
    """``samples(sample, random, n)`` to the table of log-likelihood ratios of each character given the
    one before.  A model is ``SPAN`` squared numbers, whatever the samples' size."""
    chars = F.split(F.regexp_replace("sample", ALPHABET, ""), "")
    code = lambda c: F.ascii(c) - LOW
    pairs = let(chars, lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.struct(code(F.get(c, i - 1)).alias("a"), code(F.get(c, i)).alias("b"))))
    seen = samples.select("random", "n", F.inline(pairs)).where("a >= 0 and b >= 0")
    of = lambda side: F.sum(F.when(F.col("random") == side, F.col("n")).otherwise(0))
    counts = seen.groupBy("a", "b").agg(of(True).alias("r"), of(False).alias("o")).collect()  # at most SPAN * SPAN rows
    from math import log

    table_of = [[{}, {}] for _ in range(SPAN)]
    for row in counts:
        table_of[row.a][0][row.b], table_of[row.a][1][row.b] = row.r, row.o
    sums = [[sum(x.values()) for x in pair] for pair in table_of]

    def p(side: int, a: int, b: int) -> float:
        share = table_of[a][side].get(b, 0) / sums[a][side] if sums[a][side] else 1 / LETTERS
        return (1 - UNIFORM) * share + UNIFORM / LETTERS

    return [log(p(0, a, b)) - log(p(1, a, b)) for a in range(SPAN) for b in range(SPAN)]


def ratio(token: Column, model: list[float]) -> Column:
    """Sum of the model's log-likelihood ratios over a token; 0 for a single character."""
    known = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    at = lambda c, i: (F.ascii(F.get(c, i - 1)) - LOW) * SPAN + F.ascii(F.get(c, i)) - LOW
    return let(F.split(token, ""), lambda c: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), F.lit(0.0), lambda s, i: s + F.coalesce(F.get(known, at(c, i)), F.lit(0.0))))


def scan(docs: DataFrame, model: list[float], cutoff: float = MIN_RATIO) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans (arrays of start, kind, end, found, sorted)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.array_sort(F.concat(matches(text, ASSIGN, "assign", 2, MIN_VALUE), matches(text, ACCESS, "access"), matches(text, HEX, "hex")))
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base.alias("base"), matches(text, TOKEN, "markov").alias("_tokens"))
    covered = lambda t: F.exists("base", lambda b: (b["start"] <= t["start"]) & (b["end"] >= t["end"]))
    likely = lambda t: ratio(t["found"], model) >= cutoff * F.char_length(t["found"])
    added = F.filter("_tokens", lambda t: ~covered(t) & likely(t))
    return first.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def as_string(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def random_samples(spark: SparkSession, n: int = SAMPLE_STRINGS, seed: str = "sample") -> DataFrame:
    """Labelled random strings: digests in hexadecimal, base 64, upper-case letters with digits, letters with digits, UUIDs."""
    digest = F.sha2(F.concat(F.lit(f"{seed} "), F.col("id").cast("string")).cast("binary"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "[\r\n=]", "")
    uuid = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12))
    kinds = [digest, base64, F.upper(F.regexp_replace(base64, "[^A-Za-z0-9]", "")), F.regexp_replace(base64, "[^A-Za-z0-9]", ""), uuid]
    return spark.range(n).select(F.get(F.array(*kinds), (F.col("id") % len(kinds)).cast("int")).alias("sample"), F.lit(True).alias("random"), F.lit(1).cast("long").alias("n"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n, held): the words of letters of all documents, how often they occur, and whether they are of
    the calibration fold.  Words with digits are left out: they may be secrets."""
    plain = F.filter(F.transform(words(F.col("text").cast("string")), lambda w: F.regexp_replace(w, r"[.,;:!?]+$", "")), lambda w: w.rlike("^[A-Za-z]{2,24}$"))
    counted = docs.select(F.explode(plain).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("held", F.pmod(F.xxhash64(F.lower("word")), F.lit(FOLDS)) == 0)


def ordinary_samples(known: DataFrame) -> DataFrame:
    """Labelled ordinary strings: each word, and pieces of identifiers that show what stands before and after it."""
    w, h = F.col("word"), F.pmod(F.xxhash64("word", F.lit("number")), F.lit(1000))
    number, year = h.cast("string"), (1990 + h % 40).cast("string")
    around = [F.concat(F.lit(x), w, F.lit(x)) for x in "_-/."]
    joined = [F.concat(w, F.initcap(w)), F.concat(F.upper(w), F.lit("_"), F.upper(w)), F.concat(w, number, F.lit("_")), F.concat(F.lit("_"), year, F.lit("_"), w), F.concat(F.lit("-"), year, F.lit("-"), number, F.lit("-"), w), F.concat(F.lit("/"), number, F.lit("/"), w, F.lit("."))]
    return known.where("not held").select(F.explode(F.array(w, *around, *joined)).alias("sample"), F.lit(False).alias("random"), "n")


def calibration_samples(known: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(sample) identifiers of all words of the calibration fold: in hash blocks of about ``block`` words, each word
    joined to three others of its block in one of six ways."""
    held = materialize(known.where("held").groupBy(F.lower("word").alias("w")).agg(F.lit(1).alias("_one")).select("w"), "held-words")
    blocks = -(-held.count() // block) or 1
    listed = held.groupBy(F.pmod(F.xxhash64("w", F.lit("block")), F.lit(blocks)).alias("_b")).agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("w").alias("h"), "w"))).alias("l"))
    four = F.transform("l", lambda _, i: F.array(*[F.get("l", F.pmod(i + k, F.size("l")))["w"] for k in (0, 7, 31, 103)]))
    rows = listed.select(F.posexplode(four).alias("i", "p"))
    year, p = (1990 + F.pmod(F.hash("i"), F.lit(40))).cast("string"), F.col("p")
    ways = [F.array_join(p, "_"), F.array_join(p, "-"), F.array_join(F.transform(p, lambda x: F.initcap(x)), ""), F.array_join(p, "/"), F.upper(F.array_join(p, "_")), F.concat_ws("_", p[0], p[1], year, p[2])]
    return rows.select(F.get(F.array(*ways), F.pmod("i", F.lit(len(ways)))).alias("sample")).where(F.char_length("sample") >= MIN_TOKEN)


def share_below(samples: DataFrame, each: Column, share: float) -> float | None:
    """A value that at least ``share`` of all samples' ``each`` stay below, the least of ``BINS`` in 1; None without samples.
    Counts of bins are added up, so it is the same however rows are dealt."""
    counts = samples.groupBy(F.floor(each * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n")).where("bin is not null").collect()  # a ratio has a bound: at most some 20 * BINS rows
    total, seen = sum(r.n for r in counts), 0
    for r in sorted(counts):
        seen += r.n
        if seen >= share * total:
            return (r.bin + 1) / BINS
    return None


def calibrate(known: DataFrame, model: list[float]) -> float:
    """The cutoff of the ratio for each character (see above)."""
    spark, each = known.sparkSession, ratio(F.col("sample"), model) / F.char_length("sample")
    high = share_below(calibration_samples(known), each, 0.999)
    if high is None:
        return MIN_RATIO
    low = share_below(random_samples(spark, seed="calibration"), each, 0.01)
    return max(high, (high + low) / 2)


def fitted(docs: DataFrame) -> tuple[list[float], float]:
    """The model of ``docs`` and its cutoff."""
    known = materialize(vocabulary(docs), "vocabulary")
    model = train(random_samples(docs.sparkSession).unionByName(ordinary_samples(known)))
    return model, calibrate(known, model)


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, *fitted(docs))
    n = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(as_string(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_string(F.col("spans")).alias("spans"))
