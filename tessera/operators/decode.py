"""Decoding of documents: greedy, beam, Viterbi, and the state that predictions leave behind.

A document's steps depend on its own predictions, so a document is decoded in one task, by
``mapInArrow`` over sorted rows (beams) or ``applyInPandas``; documents are independent, and
everything that does not depend on predictions is computed with joins beforehand.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .blocks import pack, unpack  # noqa: F401

INVALID = -50.0
#: Candidates that are rated at once, and steps that are decoded at once (and more only if one step or document has more).
PART, STEPS = 1 << 16, 1 << 14


def greedy(scores: DataFrame) -> DataFrame:
    """``scores(doc_id, step, pos, entity, score, valid)`` to (doc_id, step, entity): best valid candidate, the first of equals.
    A step's candidates may also be one array ``offers`` of (entity, pos, score, valid), which is worked on in place."""
    if "offers" in scores.columns:
        rated = F.transform("offers", lambda x: F.struct(F.when(x["valid"], x["score"]).otherwise(F.lit(INVALID)).alias("s"), (-x["pos"]).alias("p"), x["entity"].alias("entity")))
        return scores.select("doc_id", "step", F.array_max(rated)["entity"].alias("entity"))
    s = F.when(F.col("valid"), F.col("score")).otherwise(F.lit(INVALID))
    return scores.groupBy("doc_id", "step").agg(F.max_by("entity", F.struct(s, -F.col("pos"))).alias("entity"))


def _log_shares(score: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of scores in runs that begin at ``first``: each less the largest of its run, and each run's log of the sum of their exponentials."""
    low = score - np.repeat(np.maximum.reduceat(score, first), sizes)
    return low, np.log(np.add.reduceat(np.exp(low), first))


def _grow(rank: np.ndarray, first: np.ndarray, sizes: np.ndarray, entity: np.ndarray, base: np.ndarray, width: int, repeat_penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Beams of many documents at once, a step of each at a time.  ``rank``: the documents' steps, a row a document, in the order
    they are decoded, -1 after the last; steps are runs of ``entity`` and ``base``.  Entities in that order, and scores."""
    docs, longest = rank.shape
    sums, paths = np.full((docs, width), -np.inf), np.full((docs, width, longest), -1, np.int64)
    sums[:, 0] = 0.0
    for k in range(longest):
        on = np.flatnonzero(rank[:, k] >= 0)
        lo, n = first[rank[on, k]], sizes[rank[on, k]]
        at = np.arange(n.max())
        there = at < n[:, None]
        places = np.where(there, lo[:, None] + at, 0)
        own, grown = entity[places], sums[on][:, :, None] + np.where(there, base[places], -np.inf)[:, None, :]
        if repeat_penalty and k:
            seen = np.zeros(grown.shape, bool)
            for j in range(k):
                seen |= paths[on][:, :, j, None] == own[:, None, :]
            grown = np.where(seen, grown - repeat_penalty, grown)
        flat = grown.reshape(len(on), -1)
        top = np.argsort(-flat, axis=1, kind="stable")[:, :width]
        row = np.arange(len(on))[:, None]
        found, kept = flat[row, top], paths[on][row, top // len(at)]
        kept[:, :, k] = own[row, top % len(at)]
        sums[on], paths[on] = -np.inf, -1
        sums[on[:, None], np.arange(top.shape[1])], paths[on[:, None], np.arange(top.shape[1])] = found, kept
    return paths[:, 0], sums[:, 0]


def _decoded(doc: np.ndarray, step: np.ndarray, many: np.ndarray, first: np.ndarray, sizes: np.ndarray, entity: np.ndarray, base: np.ndarray, width: int, reorder: bool, repeat_penalty: float) -> pa.RecordBatch:
    """Whole documents, sorted: a row of ``doc``, ``step``, ``many`` (how many candidates it has) for each step."""
    of = np.cumsum(np.r_[False, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    order = np.lexsort((np.arange(len(doc)), -many, of)) if reorder else np.arange(len(doc))
    begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    place = np.arange(len(doc)) - begin[of]
    out, total = np.zeros(len(doc), np.int64), np.zeros(len(doc))
    length = np.bincount(of)
    # documents of about one length together: rows are padded to the longest, and by at most double
    for size in np.unique(np.ceil(np.log2(length))):
        chosen = np.flatnonzero(np.ceil(np.log2(length)) == size)
        rank = np.full((len(chosen), length[chosen].max()), -1, np.int64)
        index = np.full(len(length), -1)
        index[chosen] = np.arange(len(chosen))
        rows = np.flatnonzero(index[of] >= 0)
        rank[index[of[rows]], place[rows]] = order[rows]
        paths, sums = _grow(rank, first, sizes, entity, base, width, repeat_penalty)
        out[rows], total[rows] = paths[index[of[rows]], place[rows]], sums[index[of[rows]]]
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(step[order]), pa.array(out), pa.array(total)], names=["doc_id", "step", "entity", "score"])


DECODED = "doc_id long, step long, entity long, score double"


def beam(scores: DataFrame, width: int = 4, reorder: bool = False, repeat_penalty: float = 0.0) -> DataFrame:
    """(doc_id, step, entity, score): the best beam's entity at each step.

    A step adds log-softmax of the valid candidates' scores, and ``repeat_penalty`` for an entity the
    beam predicted before (a score after normalisation).  With ``reorder``, steps with most candidates come first.
    """

    def decode(doc: np.ndarray, step: np.ndarray, entity: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (step[1:] != step[:-1])])
        sizes = np.diff(np.r_[first, len(doc)])
        low, norm = _log_shares(score, first, sizes)
        return _decoded(doc[first], step[first], sizes, first, sizes, entity, low - np.repeat(norm, sizes), width, reorder, repeat_penalty)

    def fold(batches):
        """Sorted rows as they stream by; the last document of a batch waits for the next one."""
        held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "step", "entity", "score")]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                yield decode(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield decode(*held)

    s = F.when(F.col("valid"), F.col("score").cast("double")).otherwise(F.lit(INVALID))
    slim = scores.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("step").cast("long").alias("step"), "pos", F.col("entity").cast("long").alias("entity"), s.alias("score"))
    rows = slim.repartition("doc_id").sortWithinPartitions("doc_id", "step", "pos")
    return rows.mapInArrow(fold, DECODED)


def _best_few(score: np.ndarray, first: np.ndarray, sizes: np.ndarray, width: int, repeat_penalty: float) -> np.ndarray:
    """Which of a step's candidates a beam can take at all: those that score at least the ``width``-th best less the penalty.
    Any other comes after these in every beam, even if all of them are repeats."""
    if not len(first):
        return np.zeros(0, bool)
    at = np.arange(sizes.max())
    there = at < sizes[:, None]
    padded = np.where(there, score[np.where(there, first[:, None] + at, 0)], -np.inf)
    k = min(width, padded.shape[1])
    least = np.partition(padded, padded.shape[1] - k, axis=1)[:, -k]
    return score >= np.repeat(least, sizes) - abs(repeat_penalty) - 1e-6  # far more than sums of a document are rounded by


def _pieces(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows that hold ``most`` in all, or one row that holds more."""
    end, out, i = np.cumsum(sizes), [], 0
    while i < len(sizes):
        stop = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + most, side="right")))
        out.append((i, stop))
        i = stop
    return out


#: A block of steps: doc, step, how many candidates it had, the log of the sum over them, how many are left, and these.
TAKEN = "drrfrd"


def _dealing(groups: int, rate: Callable, width: int, reorder: bool, repeat_penalty: float) -> tuple[Callable, Callable]:
    """``deal``: of steps' (doc, step, sizes, entity), blocks by document with those candidates alone that a beam can take, and the log
    of the sum over all of them; ``fold``: documents decoded from such blocks."""
    rated = lambda entity, step: np.where((r := rate(entity, step))[1], r[0], INVALID).astype(np.float64)

    def dealt(held):
        doc, step, many, norm, left, few = (np.concatenate(c) for c in zip(*held, strict=True))
        g, first = B.group_of(doc, groups), np.cumsum(left) - left
        order = np.lexsort((step, doc, g))
        return B.dealt(g[order], [c[order] for c in (doc, step, many, norm)], TAKEN, 0, left[order], few[B.ranges(first[order], left[order])])

    def deal(parts):
        held, many = [], 0
        for doc, step, n, own in parts:
            first = np.cumsum(n) - n
            score = rated(own, np.repeat(step, n))
            kept = _best_few(score, first, n, width, repeat_penalty)
            left = np.add.reduceat(kept, first, dtype=np.int64)
            held.append((doc, step, n, _log_shares(score, first, n)[1], left, own[kept]))
            many += 4 * len(doc) + int(left.sum())
            if many >= B.GATHERED:
                yield dealt(held)
                held, many = [], 0
        if held:
            yield dealt(held)

    def fold(batches):
        for _, (blocks, _) in B.by_group(batches):
            doc, step, many, norm, sizes, entity = B.joined(blocks, TAKEN)
            order, first = np.lexsort((step, doc)), np.cumsum(sizes) - sizes
            begin = np.flatnonzero(np.r_[True, doc[order][1:] != doc[order][:-1]])
            ends = np.r_[begin[1:], len(doc)]
            for a, b in _pieces(ends - begin, STEPS):
                at = order[begin[a] : ends[b - 1]]
                n, own = sizes[at], entity[B.ranges(first[at], sizes[at])]
                here = np.cumsum(n) - n
                low, _ = _log_shares(rated(own, np.repeat(step[at], n)), here, n)
                yield _decoded(doc[at], step[at], many[at], here, n, own, low - np.repeat(norm[at], n), width, reorder, repeat_penalty)

    return deal, fold


def beam_in_place(steps: DataFrame, rate: Callable, width: int = 4, reorder: bool = False, repeat_penalty: float = 0.0) -> DataFrame:
    """``beam`` of ``steps(doc_id, step, entities array)``, candidates in order; ``rate(entity, step)``: scores and which are valid,
    of numpy arrays.  Steps are dealt by document in packed blocks, with those candidates alone that a beam can take, and the log of
    the sum over all of them.  The results are those of ``beam``."""
    deal, fold = _dealing(B.groups_of(steps), rate, width, reorder, repeat_penalty)

    def parts(batches):
        for batch in batches:
            column = batch.column("entities")
            starts = column.offsets.to_numpy().astype(np.int64)
            doc, step = (batch.column(c).to_numpy() for c in ("doc_id", "step"))
            entity, starts = column.flatten().to_numpy().astype(np.int64), starts - starts[0]
            for a, b in _pieces(np.diff(starts), PART):
                yield doc[a:b], step[a:b], np.diff(starts[a : b + 1]), entity[starts[a] : starts[b]]

    slim = steps.where(F.size("entities") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("step").cast("long").alias("step"), F.col("entities").cast("array<bigint>").alias("entities"))
    return B.meet(slim.mapInArrow(lambda batches: deal(parts(batches)), B.BLOCKS)).mapInArrow(fold, DECODED)


def beam_of_links(links: DataFrame, rate: Callable, width: int = 4, reorder: bool = False, repeat_penalty: float = 0.0) -> DataFrame:
    """``beam_in_place`` where each of ``links(doc_id, step, anchor_id, entity)`` is a step with its anchor, and the anchor's candidates
    are the entities that any link gives it, in order.  Links meet by anchor in packed blocks too, once for both."""
    n = B.groups_of(links)
    deal, fold = _dealing(n, rate, width, reorder, repeat_penalty)
    lines, no_doc = "ddrrr", -(1 << 63)

    def by_anchor(batches):
        for anchor, entity, doc, step, known in B.gathered(batches):
            g = B.group_of(anchor, n)
            order = np.lexsort((entity, anchor, g))
            yield B.dealt(g[order], [c[order] for c in (anchor, entity, doc, step, known)], lines)

    def parts(batches):
        for _, (blocks, _) in B.by_group(batches):
            anchor, entity, doc, step, known = B.joined(blocks, lines)
            order = np.lexsort((entity, anchor))
            own = order[known[order] > 0]
            a, e = anchor[own], entity[own]
            new = np.r_[True, (a[1:] != a[:-1]) | (e[1:] != e[:-1])][: len(own)]
            (anchors, sizes), e = np.unique(a[new], return_counts=True), e[new]
            on = order[np.isin(anchor[order], anchors)]
            at = np.searchsorted(anchors, anchor[on])
            many, first = sizes[at], (np.cumsum(sizes) - sizes)[at]
            for i, j in _pieces(many, PART):
                yield doc[on[i:j]], step[on[i:j]], many[i:j], e[B.ranges(first[i:j], many[i:j])]

    key = lambda c, other: F.coalesce(F.col(c).cast("long"), F.lit(other).cast("long")).alias(c)
    slim = links.where("anchor_id is not null").select(key("anchor_id", 0), key("entity", 0), key("doc_id", no_doc), F.col("step").cast("long").alias("step"), F.col("entity").isNotNull().cast("long").alias("known"))
    steps = B.meet(slim.mapInArrow(by_anchor, B.BLOCKS)).mapInArrow(lambda batches: deal(parts(batches)), B.BLOCKS)
    return B.meet(steps).mapInArrow(fold, DECODED).withColumn("doc_id", F.nullif("doc_id", F.lit(no_doc)))


def viterbi_path(unary: np.ndarray, transition: np.ndarray) -> tuple[list[int], float]:
    """Best tag path of unary (steps, tags) and transition (tags, tags) scores."""
    best, back = unary[0], []
    for row in unary[1:]:
        total = best[:, None] + transition
        back.append(total.argmax(axis=0))
        best = row + total.max(axis=0)
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(best.max())


def viterbi(unary: DataFrame, transition: list[list[float]]) -> DataFrame:
    """``unary(doc_id, step, scores array)`` to (doc_id, step, tag, score)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("step")
        path, score = viterbi_path(np.stack(frame["scores"].to_list()), np.array(transition))
        return pd.DataFrame({"doc_id": frame["doc_id"], "step": frame["step"], "tag": path, "score": score})

    return unary.groupBy("doc_id").applyInPandas(lambda frame: run(frame), "doc_id long, step long, tag int, score double")


def topk_tags(scores: DataFrame, k: int) -> DataFrame:
    """``scores(doc_id, pos, class_id, score)`` to the k best classes of each token, with ``rank``."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "pos").orderBy(F.desc("score"), "class_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


# features from past predictions: ``steps(doc_id, step, entity)`` is the (gold) history -----------
def seen_before(candidates: DataFrame, steps: DataFrame) -> DataFrame:
    """``candidates(doc_id, step, entity)`` with ``seen``: predicted at an earlier step of the document."""
    first = steps.groupBy("doc_id", "entity").agg(F.min("step").alias("_first"))
    return candidates.join(first, ["doc_id", "entity"], "left").select("doc_id", "step", "entity", F.coalesce(F.col("_first") < F.col("step"), F.lit(False)).alias("seen"))


def earlier(steps: DataFrame, entity: str) -> DataFrame:
    """``steps(doc_id, step, ...)`` with ``earlier``: the distinct ``entity`` values of the document's earlier steps."""
    before = Window.partitionBy("doc_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("earlier", F.array_distinct(F.collect_list(entity).over(before)))


def constraint_penalty(required: Column, created: Column, penalty: float = -1000.0) -> Column:
    """0 where every constraint a candidate requires was created by the last prediction, else the penalty."""
    return F.when((F.size(required) == 0) | (F.size(F.array_except(required, F.coalesce(created, F.array().cast("array<int>")))) == 0), F.lit(0.0)).otherwise(F.lit(penalty))


def last_created(steps: DataFrame) -> DataFrame:
    """``steps(doc_id, step, created array)`` with ``last``: what the step before created."""
    return steps.withColumn("last", F.lag("created").over(Window.partitionBy("doc_id").orderBy("step")))


def list_consistent(inside: Column, own: Column, last: Column) -> Column:
    """0 outside a list; inside, 1 if no target is shared with the last prediction, 2 if one is."""
    return F.when(~inside, F.lit(0)).when(F.size(F.array_intersect(own, last)) > 0, F.lit(2)).otherwise(F.lit(1))


def recurrent_state(steps: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """``steps(doc_id, step, vec)`` to (doc_id, step, state): an LSTM cell's output before each step, weights by seed.
    A document's steps are folded in order, documents in parallel."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        w, u, b = rng.normal(0, 0.3, (width, 4 * width)), rng.normal(0, 0.3, (width, 4 * width)), np.zeros(4 * width)
        frame = frame.sort_values("step")
        h, c, out = np.zeros(width), np.zeros(width), []
        sigmoid = lambda x: 1 / (1 + np.exp(-x))
        for vec in frame["vec"]:
            out.append(h.tolist())
            i, f, o, g = np.split(np.asarray(vec) @ w + h @ u + b, 4)
            c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
            h = sigmoid(o) * np.tanh(c)
        return pd.DataFrame({"doc_id": frame["doc_id"], "step": frame["step"], "state": out})

    return steps.groupBy("doc_id").applyInPandas(lambda frame: run(frame), "doc_id long, step long, state array<double>")
