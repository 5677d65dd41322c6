"""Aggregations: class reports, vocabularies, corpus statistics, metrics of predictions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B


def class_report(members: DataFrame, edges: DataFrame, topn: int = 20) -> DataFrame:
    """(prop, dst, n, share): for a set of entities, each relation's ``topn`` most common targets."""
    size = members.select("idx").distinct().agg(F.count(F.lit(1)).alias("_size"))
    counts = edges.join(members.select(F.col("idx").alias("src")).distinct(), "src", "left_semi").groupBy("prop", "dst").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("prop").orderBy(F.desc("n"), "dst"))
    return counts.withColumn("_r", rank).where(F.col("_r") <= topn).join(F.broadcast(size)).select("prop", "dst", "n", (F.col("n") / F.col("_size")).alias("share"))


def top_members(members: DataFrame, weights: DataFrame | None, n: int) -> DataFrame:
    """The n members with most weighted links (idx, weight); without weights the first n by id."""
    if weights is None:
        return members.select("idx").orderBy("idx").limit(n)
    return members.join(weights, F.col("idx") == F.col("entity")).select("idx", F.col("n").alias("weight")).orderBy(F.desc("weight"), "idx").limit(n)


def class_cardinality(classification: DataFrame, names: DataFrame, samples: int = 20) -> DataFrame:
    """(class_id, n, sample): members of each class and the first names."""
    rows = classification.join(names, "idx", "left")
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("class_id").orderBy("idx"))).where(F.col("_r") <= samples).groupBy("class_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda x: x["name"]).alias("sample"))
    return rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).join(first, "class_id")


def earliest(attributes: DataFrame, entities: DataFrame, props: list[str]) -> DataFrame:
    """(idx, value, present): the least of the present attributes, 0 where there is none."""
    least = attributes.where(F.col("prop").isin(props)).groupBy("entity").agg(F.min("value").alias("value"))
    return entities.join(least, F.col("idx") == F.col("entity"), "left").select("idx", F.coalesce("value", F.lit(0)).alias("value"), F.col("entity").isNotNull().alias("present"))


def any_present(attributes: DataFrame, entities: DataFrame, props: list[str]) -> DataFrame:
    """(idx, found): whether the entity has any of the attributes."""
    some = attributes.where(F.col("prop").isin(props)).select("entity").distinct()
    return entities.join(some, F.col("idx") == F.col("entity"), "left").select("idx", F.col("entity").isNotNull().alias("found"))


def recode(values: DataFrame, entities: DataFrame) -> DataFrame:
    """(idx, code): dense codes of the distinct ids in ``values(idx)`` in rising order, n for the others.

    Codes are places in id order: counts of blocks of ids, summed, plus the place in the block.
    """
    ids = values.select("idx").distinct().withColumn("_b", F.floor(F.col("idx") / (1 << 16)))
    sums = ids.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    coded = ids.join(before, "_b").select("idx", (F.col("_base") + F.row_number().over(Window.partitionBy("_b").orderBy("idx")) - 1).alias("_code"))
    n = ids.agg(F.count(F.lit(1)).alias("_all"))
    return entities.join(coded, "idx", "left").join(F.broadcast(n)).select("idx", F.coalesce("_code", "_all").alias("code"))


def vocabulary(features: DataFrame, most: int, reserved: tuple[str, ...] = ()) -> DataFrame:
    """``features(feature)`` to (feature, n, code): by falling count, then feature; reserved words come first."""
    counts = features.where(~F.col("feature").isin(list(reserved))).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "feature").limit(most)  # bounded by ``most``
    coded = top.select("feature", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "feature")) - 1 + len(reserved)).alias("code"))
    fixed = features.sparkSession.createDataFrame([(w, 0, i) for i, w in enumerate(reserved)], "feature string, n long, code int")
    return fixed.unionByName(coded)


def token_counts(tokens: DataFrame) -> DataFrame:
    """``tokens(token, is_label)`` to (token, n, n_labels)."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_label").alias("n_labels"))


def ngram_counts(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """How often each phrase of one or two words (``phrases(phrase)``) stands in ``docs(words array)``, by word equality."""
    own = docs.select(F.col("words").alias("w"))
    one = own.select(F.explode("w").alias("phrase"))
    two = own.select(F.explode(F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).alias("phrase"))
    counts = one.union(two).join(phrases, "phrase", "left_semi").groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    return phrases.join(counts, "phrase", "left").select("phrase", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def dataset_tokens(tokens: DataFrame) -> DataFrame:
    """``tokens(doc_id, pos, label)`` to one row (n_tokens, n_docs, n_runs): a label run starts where the label differs from the one before and is not null."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    start = F.col("label").isNotNull() & ~F.col("label").eqNullSafe(F.lag("label").over(order))
    return tokens.withColumn("_s", start).agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("doc_id").alias("n_docs"), F.count_if("_s").alias("n_runs"))


def unique_examples(candidates: DataFrame) -> DataFrame:
    """``candidates(doc_id, mention_id, anchor_id, entity, cnt, entity_cnt)`` to distinct features with their share of the
    mention's counts and ``repeat``: how many anchors of the document offer the entity."""
    total = F.sum("cnt").over(Window.partitionBy("mention_id"))
    offers = candidates.groupBy("doc_id", "entity").agg(F.count_distinct("anchor_id").alias("repeat"))
    rows = candidates.withColumn("total", total).join(offers, ["doc_id", "entity"])
    return rows.select("entity", "cnt", "total", "entity_cnt", "repeat").distinct()


NO_DOC, NO_ENTITY, NO_WEIGHT, BITS = 1, 2, 4, 8


def _new(*columns: np.ndarray) -> np.ndarray:
    """Of sorted rows: which differ from the one before."""
    return np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)] if len(columns[0]) else np.zeros(0, bool)


def _anchor_table(anchor: np.ndarray, entity: np.ndarray, flags: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of links sorted by anchor, those without entity and entity: anchors, how many entities each has, its total and whether that is
    null; then its entities, their sums of weights, and whether these are null."""
    w = np.where(flags & BITS > 0, weight.view(np.float64), weight.astype(np.float64))
    first = np.flatnonzero(_new(anchor, flags & NO_ENTITY, entity))
    known = np.add.reduceat((flags & NO_WEIGHT == 0).astype(np.int64), first) if len(first) else first
    cnt = np.add.reduceat(np.where(flags & NO_WEIGHT > 0, 0.0, w), first).astype(np.int64) if len(first) else first
    null = (known == 0).astype(np.int64)
    begin = np.flatnonzero(_new(anchor[first]))
    there = flags[first] & NO_ENTITY == 0
    total, some, sizes = (np.add.reduceat(x, begin) if len(begin) else begin for x in (cnt, 1 - null, there.astype(np.int64)))
    return [anchor[first][begin], sizes, total, (some == 0).astype(np.int64), entity[first][there], cnt[there], null[there]]


def unique_examples_of_links(links: DataFrame) -> DataFrame:
    """``unique_examples`` where each of ``links(doc_id, anchor_id, entity, weight)`` is a mention of its anchor, and the anchor's
    candidates are the entities that any link gives it, ``cnt`` the sum of weights: (entity, cnt, total, repeat).

    A mention's candidates are never rows.  Links meet by anchor; each document gets its anchors with their entities in packed
    blocks and answers with those entities alone that several of its anchors offer.  An anchor then knows for each entity how often
    that is, and in how many of its documents it is not: there ``repeat`` is 1.
    """
    n = B.groups_of(links)
    lines, table, mentions, answers, found = "drdrr", "drrrrdrr", "drrd", "drr", "ddddd"

    def by_anchor(batches):
        for anchor, doc, entity, flags, weight in B.gathered(batches):
            whole = (np.rint(weight) == weight) & (np.abs(weight) < 2.0**53)
            flags = flags | np.where(whole, 0, BITS)
            weight = np.where(whole, np.where(whole, weight, 0).astype(np.int64), weight.view(np.int64))
            g = B.group_of(anchor, n)
            order = np.lexsort((entity, anchor, g))
            yield B.dealt(g[order], [c[order] for c in (anchor, doc, entity, flags, weight)], lines)

    def by_document(batches):
        held, many = [], 0

        def deal():
            doc, anchor, sizes, first = (np.concatenate(c) for c in zip(*((d, a, s, f + o) for (d, a, s, f, _), o in zip(held, np.r_[0, np.cumsum([len(h[4]) for h in held])[:-1]], strict=True)), strict=True))
            entity = np.concatenate([h[4] for h in held])
            g = B.group_of(doc, n)
            order = np.lexsort((doc, anchor, g))
            for i in range(0, len(order), step := max(1, B.GATHERED * len(order) // max(1, int(sizes.sum())))):
                part = order[i : i + step]
                yield B.dealt(g[part], [anchor[part], doc[part]], mentions, 0, sizes[part], entity[B.ranges(first[part], sizes[part])])

        for g, (blocks, _) in B.by_group(batches):
            anchor, doc, entity, flags, weight = B.joined(blocks, lines)
            order = np.lexsort((entity, flags & NO_ENTITY, anchor))
            anchors, sizes, total, no_total, entities, cnt, no_cnt = _anchor_table(*(c[order] for c in (anchor, entity, flags, weight)))
            on = np.flatnonzero(flags & NO_DOC == 0)
            on = on[np.lexsort((doc[on], anchor[on]))]
            on = on[_new(anchor[on], doc[on])]
            own = np.searchsorted(anchors, anchor[on])
            yield B.batch([(n + g, 0, B.encode([anchors, sizes, total, no_total, np.bincount(own, minlength=len(anchors)), entities, cnt, no_cnt], table))])
            held.append((doc[on], anchor[on], sizes[own], (np.cumsum(sizes) - sizes)[own], entities))
            many += len(on) + int(sizes[own].sum())
            if many >= B.GATHERED:
                yield from deal()
                held, many = [], 0
        if held:
            yield from deal()

    def repeated(batches):
        held, many = [], 0

        def deal():
            anchor, place, repeat = (np.concatenate(c) for c in zip(*held, strict=True))
            g = B.group_of(anchor, n) + n
            order = np.lexsort((place, anchor, g))
            return B.dealt(g[order], [anchor[order], place[order], repeat[order]], answers, 1)

        for g, (blocks, _) in B.by_group(batches):
            if g >= n:
                yield B.batch([(g, 0, b) for b in blocks])
                continue
            anchor, doc, sizes, entity = B.joined(blocks, mentions)
            of, row = np.unique(doc, return_inverse=True)[1], np.repeat(np.arange(len(doc)), sizes)
            low = int(entity.min()) if len(entity) else 0
            span = int(entity.max()) - low + 1 if len(entity) else 1
            if span * (len(doc) + 1) >= 1 << 62:
                entity = np.unique(entity, return_inverse=True)[1]
                low, span = 0, len(entity)
            slices = 1 + len(entity) // B.GATHERED  # of a large group (as one document can be), some entities at a time
            for m in range(slices):
                at = np.flatnonzero(B.group_of(entity, slices) == m) if slices > 1 else np.arange(len(entity))
                key = of[row[at]] * span + (entity[at] - low)
                order = np.argsort(key)
                first = np.flatnonzero(_new(key[order]))
                count = np.diff(np.r_[first, len(key)])
                count, at = np.repeat(count, count), at[order]
                at, count = at[count > 1], count[count > 1]
                held.append((anchor[row[at]], at - (np.cumsum(sizes) - sizes)[row[at]], count))
                many += 3 * len(at)
            if many >= B.GATHERED:
                yield deal()
                held, many = [], 0
        if many:
            yield deal()

    def examples(batches):
        held, many = [], 0

        def deal():
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            g = B.group_of(rows[0], n)
            order = np.lexsort((*rows[::-1], g))
            return B.dealt(g[order], [c[order] for c in rows], found)

        for _, (tables, blocks) in B.by_group(batches):
            for anchors, sizes, total, no_total, docs, entity, cnt, no_cnt in (B.decode(b, table) for b in tables):
                anchor, place, repeat = B.joined(blocks, answers)
                pair = (np.cumsum(sizes) - sizes)[np.searchsorted(anchors, anchor)] + place
                of = np.repeat(np.arange(len(anchors)), sizes)
                once = np.flatnonzero(np.bincount(pair, minlength=len(entity)) < docs[of])
                order = np.lexsort((repeat, pair))
                order = order[_new(pair[order], repeat[order])]
                pair, repeat = np.r_[once, pair[order]], np.r_[np.ones(len(once), np.int64), repeat[order]]
                held.append((entity[pair], total[of[pair]], cnt[pair], no_cnt[pair] + 2 * no_total[of[pair]], repeat))
                many += 5 * len(pair)
            if many >= B.GATHERED:
                yield deal()
                held, many = [], 0
        if many:
            yield deal()

    def distinct(batches):
        for _, (blocks, _) in B.by_group(batches):
            rows = B.joined(blocks, found)
            order = np.lexsort(rows[::-1])
            order = order[_new(*(c[order] for c in rows))]
            entity, total, cnt, null, repeat = (c[order] for c in rows)
            for i in range(0, len(order), B.GATHERED // 5):
                at = slice(i, i + B.GATHERED // 5)
                yield pa.RecordBatch.from_arrays([pa.array(entity[at]), pa.array(cnt[at], mask=null[at] & 1 > 0), pa.array(total[at], mask=null[at] & 2 > 0), pa.array(repeat[at])], names=["entity", "cnt", "total", "repeat"])

    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    gone = lambda c, bit: F.when(F.col(c).isNull(), F.lit(bit)).otherwise(F.lit(0))
    flags = (gone("doc_id", NO_DOC) + gone("entity", NO_ENTITY) + gone("weight", NO_WEIGHT)).cast("long")
    rows = links.where("anchor_id is not null").select(key("anchor_id").alias("anchor"), key("doc_id").alias("doc"), key("entity").alias("entity"), flags.alias("flags"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    for f in (by_anchor, by_document, repeated, examples):
        rows = B.meet(rows.mapInArrow(f, B.BLOCKS))
    return rows.mapInArrow(distinct, "entity long, cnt long, total long, repeat long")


# metrics -----------------------------------------------------------------------------------
def confusion(pairs: DataFrame) -> DataFrame:
    """``pairs(label, pred, mask)`` to (label, pred, n)."""
    return pairs.where("mask").groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def true_false(pairs: DataFrame) -> DataFrame:
    """(label, tp, fp, fn) of each class."""
    c = confusion(pairs)
    both = c.select("label", "pred", "n")
    as_label = both.select(F.col("label"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("label") != F.col("pred"), F.col("n")).otherwise(0).alias("fn"))
    as_pred = both.where("label <> pred").select(F.col("pred").alias("label"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn"))
    return as_label.union(as_pred).groupBy("label").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])


def f1(pairs: DataFrame, floor: float = 1e-6) -> DataFrame:
    """One row of support-weighted precision, recall and F1, times 100."""
    c = true_false(pairs).withColumn("support", F.col("tp") + F.col("fn"))
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(floor))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(floor))
    rows = c.withColumns({"p": p, "r": r}).withColumn("f", 2 * F.col("p") * F.col("r") / F.greatest(F.col("p") + F.col("r"), F.lit(floor)))
    mean = lambda x: (100 * F.sum(F.col(x) * F.col("support")) / F.sum("support"))
    return rows.agg(mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"))


def accuracy(tokens: DataFrame) -> DataFrame:
    """``tokens(doc_id, label, pred, mask)`` to one row (tokens, sentences): accuracy of masked tokens, and of
    sentences with at least one, which are right if all their tokens are."""
    own = tokens.where("mask").withColumn("_ok", F.col("label") == F.col("pred"))
    per = own.groupBy("doc_id").agg(F.count_if("_ok").alias("ok"), F.count(F.lit(1)).alias("n"))
    return per.agg((F.sum("ok") / F.sum("n")).alias("tokens"), F.avg((F.col("ok") == F.col("n")).cast("double")).alias("sentences"))


def chunks(tokens: DataFrame, tag: str) -> DataFrame:
    """(doc_id, start, stop, type) of the chunks of a tag column: B-, I-, E-, S-, O (IOB, IOE and IOBES boundaries)."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    t = tokens.select("doc_id", "pos", F.substring(tag, 1, 1).alias("p"), F.substring_index(tag, "-", -1).alias("k"))
    t = t.withColumns({"pp": F.lag("p", 1, "O").over(order), "pk": F.lag("k", 1, "").over(order)})
    inside = F.col("p") != "O"
    begins = inside & (F.col("p").isin("B", "S") | F.col("pp").isin("O", "E", "S") | (F.col("k") != F.col("pk")))
    rows = t.withColumn("_c", F.sum(begins.cast("int")).over(order)).where(inside)
    return rows.groupBy("doc_id", "_c").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"), F.first("k").alias("type")).drop("_c")


def conll(tokens: DataFrame) -> DataFrame:
    """``tokens(doc_id, pos, gold, guess)`` to (type, correct, guessed, gold): chunks equal in place and type."""
    gold, guess = chunks(tokens, "gold"), chunks(tokens, "guess")
    keys = ["doc_id", "start", "stop", "type"]
    right = gold.join(guess, keys, "left_semi")
    count = lambda df, name: df.groupBy("type").agg(F.count(F.lit(1)).alias(name))
    out = count(gold, "gold").join(count(guess, "guessed"), "type", "full").join(count(right, "correct"), "type", "left")
    return out.select("type", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("correct", "guessed", "gold")])


def recall_at(ranks: DataFrame, most: int = 5) -> DataFrame:
    """``ranks(mention_id, rank)`` of the true candidate (null: not there) to one row of recall at 1..most."""
    return ranks.agg(*[F.avg((F.coalesce(F.col("rank"), F.lit(1 << 30)) <= k).cast("double")).alias(f"recall_{k}") for k in range(1, most + 1)])


def mistakes(rows: DataFrame, examples: int = 10) -> DataFrame:
    """``rows(id, true_types, pred_types)`` (arrays) to (true_types, pred_types, n, examples): pairs that differ."""
    own = rows.select("id", F.array_sort("true_types").alias("true_types"), F.array_sort("pred_types").alias("pred_types")).where("true_types <> pred_types")
    nth = F.row_number().over(Window.partitionBy("true_types", "pred_types").orderBy("id"))
    few = own.withColumn("_r", nth).where(F.col("_r") <= examples).groupBy("true_types", "pred_types").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    return own.groupBy("true_types", "pred_types").agg(F.count(F.lit(1)).alias("n")).join(few, ["true_types", "pred_types"])


def merge_metrics(metrics: DataFrame) -> DataFrame:
    """``metrics(dataset, metric, value)`` with each metric's sum over datasets (dataset null)."""
    return metrics.groupingSets([["dataset", "metric"], ["metric"]], "dataset", "metric").agg(F.sum("value").alias("value"))


def class_weights(labels: DataFrame, clip: float, n_classes: int) -> DataFrame:
    """(label, weight): total / count, counts starting at 1, clipped."""
    counts = labels.groupBy("label").agg((F.count(F.lit(1)) + 1).alias("n"))
    total = labels.agg((F.count(F.lit(1)) + n_classes).alias("total"))
    return counts.join(F.broadcast(total)).select("label", F.least(F.greatest(F.col("total") / F.col("n"), F.lit(1e-6)), F.lit(clip)).alias("weight"))


def running_means(values: DataFrame) -> DataFrame:
    """``values(name, step, value)`` to (name, last, mean)."""
    return values.groupBy("name").agg(F.max_by("value", "step").alias("last"), F.avg("value").alias("mean"))


def timings(scopes: DataFrame) -> DataFrame:
    """``scopes(scope, seconds)`` to (scope, seconds), the longest first."""
    return scopes.groupBy("scope").agg(F.sum("seconds").alias("seconds")).orderBy(F.desc("seconds"), "scope")


def best(rows: DataFrame, value: str, by: Column | str, metric: str) -> DataFrame:
    """The best so far of a metric: the least of losses (loss, nll), the greatest of others."""
    lower = any(x in metric for x in ("loss", "nll"))
    return rows.agg((F.min_by if lower else F.max_by)(by, F.struct(value, by) if lower else F.struct(F.col(value), -F.col(by) if isinstance(by, str) else by)).alias("best"), (F.min if lower else F.max)(value).alias("value"))


def compare_reports(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(example, mention, right)`` of two reports to one row (fixes, breaks, both)."""
    j = a.withColumnRenamed("right", "_a").join(b.withColumnRenamed("right", "_b"), ["example", "mention"])
    return j.agg(F.count_if(~F.col("_a") & F.col("_b")).alias("fixes"), F.count_if(F.col("_a") & ~F.col("_b")).alias("breaks"), F.count(F.lit(1)).alias("both"))


def pseudonyms(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Names replaced by ``prefix`` and their place among the sorted distinct names."""
    names = rows.select(column).distinct()
    coded = names.select(F.col(column).alias("_name"), F.concat(F.lit(prefix), (F.row_number().over(Window.orderBy(column)) - 1).cast("string")).alias("_alias"))
    return rows.join(coded, F.col(column) == F.col("_name"), "left").withColumn(column, F.col("_alias")).drop("_name", "_alias")
