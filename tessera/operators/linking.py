"""Links in text: matching anchors in tokens, densifying pages, aligning labels, post-processing reports.

Token rows are ``tokens(doc_id, pos, raw)``; ``raw`` keeps the space after a token, so that
joining raws gives back the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# Words that start no match, and the nationality words.
NO_START = ("i", "not", "if", "the", "else", ".", ",")
NATIONALITY_WORDS = (
    "english american french spanish german portuguese greek italian brazilian israeli lebanese swedish turkish kurdish japanese chinese"
    " british scottish welsh estonian australian korean koreans canadian czech czechs britons"
).split()
LONGEST = 5


def tokenize(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to token rows: words and single signs, each with the space after it."""
    raws = F.regexp_extract_all("text", F.lit(r"(?s)\s*(?:[\p{L}\p{N}_]+(?:['’][\p{L}]+)?|[^\s\p{L}\p{N}_])\s*"), F.lit(0))
    return docs.select("doc_id", F.posexplode(raws).alias("pos", "raw"))


def ngrams(tokens: DataFrame, starts: Column, longest: int = LONGEST, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, pos, *keep, n, text): the joined next 1 to ``longest`` tokens of each start, trailing space cut."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    ahead = F.array(*[F.lead("raw", i).over(order) for i in range(longest)])
    rows = tokens.withColumn("_a", ahead).where(starts).withColumn("_a", F.filter("_a", lambda x: x.isNotNull()))
    each = F.transform(F.sequence(F.lit(1), F.size("_a")), lambda n: F.struct(n.alias("n"), F.rtrim(F.array_join(F.slice("_a", 1, n), "")).alias("text")))
    return rows.select("doc_id", "pos", *keep, F.inline(each))


def _known(grams: DataFrame, anchors: DataFrame) -> DataFrame:
    """Grams with the anchor of their lower-case text, else of that without points."""
    a = anchors.select("anchor", "anchor_id", "total")
    low = F.lower("text")
    rows = grams.join(a.select(F.col("anchor").alias("_k1"), F.col("anchor_id").alias("_i1"), F.col("total").alias("_t1")), low == F.col("_k1"), "left")
    rows = rows.join(a.select(F.col("anchor").alias("_k2"), F.col("anchor_id").alias("_i2"), F.col("total").alias("_t2")), F.replace(low, F.lit("."), F.lit("")) == F.col("_k2"), "left")
    return rows.select("doc_id", "pos", "n", "text", F.coalesce("_i1", "_i2").alias("anchor_id"), F.when(F.col("_i1").isNotNull(), F.col("_t1")).otherwise(F.col("_t2")).alias("total")).where("anchor_id is not null")


def not_overlapping(matches: DataFrame) -> DataFrame:
    """``matches(doc_id, pos, n, ...)``: from left to right those that start after the last kept one's end."""
    cols = [c for c in matches.columns if c not in ("doc_id", "pos", "n")]
    rows = matches.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "n", F.struct(*cols).alias("_x")))).alias("_m"))
    kept = F.aggregate("_m", F.struct(F.lit(-1).alias("end"), F.array().cast("array<int>").alias("at")), lambda a, m: F.when(m["pos"] >= a["end"], F.struct((m["pos"] + m["n"]).cast("int").alias("end"), F.array_append(a["at"], m["pos"].cast("int")).alias("at"))).otherwise(a), lambda a: a["at"])
    left = rows.select("doc_id", "_m", kept.alias("_at")).select("doc_id", F.inline(F.filter("_m", lambda m: F.array_contains("_at", m["pos"].cast("int")))))
    return left.select("doc_id", *["_x." + c if c in cols else c for c in matches.columns if c != "doc_id"])


def match_anchors(tokens: DataFrame, anchors: DataFrame, valid: DataFrame) -> DataFrame:
    """Greedy longest matches of capitalised tokens against ``anchors(anchor, anchor_id, total)``: (doc_id, pos, n, text, anchor_id).

    Of a match that ends in a point, the form without it is taken if its anchor is another with more
    links; only anchors in ``valid(anchor_id)`` are kept.
    """
    word = F.rtrim("raw")
    starts = word.rlike(r"^\p{Lu}") & ~F.lower(word).isin(list(NO_START))
    found = _known(ngrams(tokens, starts).where((F.length("text") > 1) & ~F.contains("text", F.lit(","))), anchors)
    best = F.max_by(F.struct("n", "text", "anchor_id", "total"), "n")
    alt = F.max_by(F.struct("n", "text", "anchor_id", "total"), "n")
    top = found.groupBy("doc_id", "pos").agg(best.alias("b"))
    short = found.join(top.select("doc_id", "pos", (F.col("b.n") - 1).alias("n")), ["doc_id", "pos", "n"]).groupBy("doc_id", "pos").agg(alt.alias("a"))
    rows = top.join(short, ["doc_id", "pos"], "left")
    swap = F.col("b.text").rlike(r"(^|\s|\w)\.$") & F.col("a").isNotNull() & (F.col("a.anchor_id") != F.col("b.anchor_id")) & (F.col("a.total") > F.col("b.total"))
    chosen = rows.select("doc_id", "pos", F.when(F.coalesce(swap, F.lit(False)), F.col("a")).otherwise(F.col("b")).alias("c")).select("doc_id", "pos", "c.n", "c.text", "c.anchor_id")
    return not_overlapping(chosen.join(valid.select("anchor_id"), "anchor_id", "left_semi"))


def link_features(tokens: DataFrame, anchors: DataFrame, candidates: DataFrame, links: DataFrame, names: DataFrame, triggers: DataFrame, least_share: float = 0.01) -> DataFrame:
    """Candidate links of unlinked tokens: (doc_id, pos, n, anchor_id, entity, features).

    ``tokens(doc_id, pos, raw, linked)``; ``links(doc_id, entity)`` are the page's links (with repeats);
    a candidate must be linked on the page and have over ``least_share`` of its anchor's counts.
    Features: lower-case first letter, name holds the text, shares before and after it, log1p of the
    page's links, P(entity | anchor), P(anchor | entity), P(trigger | word).
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    # a gram must not reach into a linked token
    reach = F.coalesce(F.min(F.when(F.col("linked"), F.col("pos"))).over(order.rowsBetween(0, LONGEST - 1)), F.lit(1 << 30))
    rows = tokens.withColumn("_stop", reach)
    grams = ngrams(rows, ~F.col("linked"), keep=("_stop",)).where(F.col("pos") + F.col("n") <= F.col("_stop"))
    exact = grams.join(anchors.select("anchor", "anchor_id"), F.lower(F.regexp_replace("text", r"\s+", " ")) == F.col("anchor"))
    spans = not_overlapping(exact.groupBy("doc_id", "pos").agg(F.max_by(F.struct("n", "text", "anchor_id"), "n").alias("b")).select("doc_id", "pos", "b.n", "b.text", "b.anchor_id"))
    share = candidates.withColumns({"_sum": F.sum("cnt").over(Window.partitionBy("anchor_id")), "_in": F.sum("cnt").over(Window.partitionBy("entity"))})
    on_page = links.groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("_links"))
    c = spans.join(share, "anchor_id").join(on_page.hint("merge"), ["doc_id", "entity"]).where(F.col("cnt") / F.col("_sum") > least_share)
    c = c.join(names.select(F.col("idx").alias("entity"), "name"), "entity", "left").join(triggers.select("token", "n_labels", F.col("n").alias("_words")), F.lower("text") == F.col("token"), "left")
    name, low = F.lower(F.substring_index(F.coalesce("name", F.lit("")), " (", 1)), F.lower("text")
    parts = [F.substring("text", 1, 1).rlike(r"^\p{Ll}"), F.contains(name, low), T.percent_before(name, low), T.percent_after(name, low), F.log1p("_links"), F.col("cnt") / F.col("_sum"), F.col("cnt") / F.col("_in"), F.coalesce(F.col("n_labels") / F.greatest("_words", F.lit(1)), F.lit(0.0))]
    return c.select("doc_id", "pos", spans["n"], "anchor_id", "entity", F.array(*[F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts]).alias("features"))


def densify(features: DataFrame, probability: Column, least: float = 0.5) -> DataFrame:
    """The most probable candidate of each span, if over ``least``: (doc_id, pos, n, anchor_id, entity, prob)."""
    rows = features.withColumn("prob", probability)
    best = rows.groupBy("doc_id", "pos").agg(F.max_by(F.struct("n", "anchor_id", "entity", "prob"), F.struct(F.col("prob"), -F.col("entity"))).alias("b"))
    return best.select("doc_id", "pos", "b.*").where(F.col("prob") > least)


def train_densifier(rows: DataFrame, layers: tuple[int, ...] = (8, 5, 2), seed: int = 3):
    """A small perceptron on ``rows(ok boolean, features array)``; its ``transform`` adds ``probability``."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    data = rows.select(F.col("ok").cast("double").alias("label"), array_to_vector("features").alias("vector"))
    return MultilayerPerceptronClassifier(featuresCol="vector", layers=list(layers), seed=seed).fit(data)


def annotate(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marked-up ``docs(doc_id, text)`` to plain texts (doc_id, text) and tags (doc_id, start, stop, link) in characters."""
    parts = docs.select("doc_id", F.posexplode(T.spans(F.col("text"))).alias("n", "s")).select("doc_id", "n", "s.*")
    before = F.coalesce(F.sum(F.char_length("text")).over(Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("start", before)
    plain = placed.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "").alias("text"))
    tags = placed.where("link is not null").select("doc_id", "start", (F.col("start") + F.char_length("text")).alias("stop"), "link")
    return plain, tags


def merge_tags(words: DataFrame, tags: DataFrame, cell: int = 64) -> DataFrame:
    """``words(doc_id, pos, start, stop)`` with the ``tag`` of the first of ``tags(doc_id, start, stop, tag)`` that overlaps.

    Both sides are dealt into cells of characters and meet by cell: documents of any length join in pieces.
    Rows that were exploded from texts look far smaller to the optimizer than they are, hence the hints: no side is broadcast.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.greatest(F.col(b) - 1, F.col(a))) / cell)))
    w = words.withColumn("_c", cells("start", "stop"))
    t = tags.select("doc_id", F.col("start").alias("_a"), F.col("stop").alias("_b"), "tag").withColumn("_c", cells("_a", "_b"))
    hit = w.join(t.hint("merge"), ["doc_id", "_c"]).where((F.col("_a") < F.col("stop")) & (F.col("_b") > F.col("start")))
    first = hit.groupBy("doc_id", "pos").agg(F.min_by("tag", F.struct("_a", "_b", "tag")).alias("tag"))
    return words.join(first.hint("merge"), ["doc_id", "pos"], "left")


def with_places(tokens: DataFrame) -> DataFrame:
    """Token rows with ``start`` and ``stop`` in characters (the space after a token is outside)."""
    before = F.coalesce(F.sum(F.char_length("raw")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return tokens.withColumn("start", before).withColumn("stop", F.col("start") + F.char_length(F.rtrim("raw")))


def realign(words: DataFrame, spans: DataFrame, last_only: bool = False) -> DataFrame:
    """``spans(doc_id, start, stop, label)`` to token labels: (doc_id, pos, label).  A span whose ends, after trimming,
    are not those of tokens gives none.  ``last_only`` labels just the last token."""
    named = merge_tags(words, spans.select("doc_id", "start", "stop", F.struct("start", "stop", "label").alias("tag"))).where("tag is not null")
    own = Window.partitionBy("doc_id", "tag.start", "tag.stop")
    fits = (F.min("start").over(own) == F.col("tag.start")) & (F.max("stop").over(own) == F.col("tag.stop"))
    rows = named.withColumn("_fits", fits).withColumn("_last", F.max("pos").over(own)).where("_fits")
    return (rows.where(F.col("pos") == F.col("_last")) if last_only else rows).select("doc_id", "pos", F.col("tag.label").alias("label"))


def dropout(tokens: DataFrame, lower: float, drop_s: float, blank: float, seed: int = 1) -> DataFrame:
    """Tokens changed at random, repeatably: to lower case, without a final s, or blank, each with its probability."""
    digest = lambda k: F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string"), F.lit(f"{seed}:{k}")))
    u = lambda k: F.conv(F.substring(digest(k), 1, 8), 16, 10).cast("long") / float(1 << 32)
    t = F.when(u(1) < lower, F.lower("raw")).otherwise(F.col("raw"))
    t = F.when((u(2) < drop_s) & F.rtrim(t).endswith("s"), F.regexp_replace(t, r"s(\s*)$", "$1")).otherwise(t)
    return tokens.withColumn("raw", F.when(u(3) < blank, F.lit("")).otherwise(t))


def fix_destinations(links: DataFrame, fix=None) -> DataFrame:
    """A user's hook over resolved links: ``fix(DataFrame) -> DataFrame`` of the same columns and ``keep``."""
    if fix is None:
        return links
    return fix(links).where("keep").select(*links.columns)


# post-processing of decoded reports: ``spans(doc_id, pos, text, mention_id)``, ``candidates(mention_id, entity, name, prob, link_prob, predicted)``
def pick_in_parenthesis(spans: DataFrame, candidates: DataFrame, countries: DataFrame) -> DataFrame:
    """(mention_id, entity): a mention alone inside a closed parenthesis after a colon takes its most probable country,
    where the document has more than one parenthesis."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sign = lambda s: F.char_length("text") - F.char_length(F.replace("text", F.lit(s), F.lit("")))
    last = F.regexp_extract("text", r"(?s)([()])[^()]*$", 1)
    rows = spans.withColumns({"_open": F.last(F.when(last != "", last == "("), True).over(order), "_colon": F.max(F.contains("text", F.lit(":"))).over(order), "_closed": F.sum(sign(")")).over(order)})
    totals = spans.groupBy("doc_id").agg(F.sum(sign("(")).alias("_opens"), F.sum(sign(")")).alias("_closes"))
    inside = rows.where("mention_id is not null and _open and _colon").join(totals, "doc_id").where("_closes > _closed and _opens > 1")
    alone = inside.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "_closed"))).where("_n = 1").select("mention_id")
    own = candidates.join(alone, "mention_id", "left_semi").join(countries.select("entity"), "entity", "left_semi")
    return own.groupBy("mention_id").agg(F.max_by("entity", F.struct("prob", -F.col("entity"))).alias("entity"))


def pick_by_date(spans: DataFrame, candidates: DataFrame, events: DataFrame) -> DataFrame:
    """(mention_id, entity): where an event is predicted, the most probable candidate whose name's first 4-digit year, if any, stands in the document."""
    years = spans.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?<!\S)\d{4}(?!\S)"), F.lit(0))).alias("_year")).distinct()
    doc_of = spans.where("mention_id is not null").select("mention_id", "doc_id")
    wrong = candidates.where("predicted").join(events.select("entity"), "entity", "left_semi").select("mention_id")
    own = candidates.join(wrong, "mention_id", "left_semi").join(doc_of, "mention_id").withColumn("_year", F.nullif(F.regexp_extract("name", r"(?<!\S)(\d{4})(?!\S)", 1), F.lit("")))
    held = own.join(years.withColumn("_in", F.lit(True)), ["doc_id", "_year"], "left").withColumn("_ok", F.col("_year").isNull() | F.col("_in").isNotNull())
    return held.groupBy("mention_id").agg(F.max_by("entity", F.struct(F.col("_ok").cast("int"), "prob", -F.col("entity"))).alias("entity"))


def pick_nationality(spans: DataFrame, candidates: DataFrame, countries: DataFrame) -> DataFrame:
    """(mention_id, entity): a nationality word takes the country with the highest link probability."""
    own = spans.where(F.lower(F.rtrim("text")).isin(NATIONALITY_WORDS) & F.col("mention_id").isNotNull()).select("mention_id")
    rows = candidates.join(own, "mention_id", "left_semi").join(countries.select("entity"), "entity", "left_semi")
    return rows.groupBy("mention_id").agg(F.max_by("entity", F.struct("link_prob", -F.col("entity"))).alias("entity"))
