"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is that of its hash plus those of its first four and six letters' hashes.  Filters
of several widths slide over the text; each filter's largest response (max pooling) is a
feature of a logistic output.  Training takes a bounded sample of labelled rows: at most
``MOST_ROWS`` of each class, those with the smallest hash of the doc_id, of at most
``MOST_WORDS`` words each.  Held-out rows (crc32 of the doc_id as text, mod 5, is 0) are
never looked at.  All labelled rows of one further fifth, texts of any length, calibrate a
threshold for each language; scores never depend on the language.

Words, hashes and lists of numbers are made by Spark functions; numpy sees flat arrays.
Texts are scored whole, in steps of bounded size, as maxima join up.

Defined results: null texts are empty; empty texts get the score of no response at all;
without labels of both classes every score is 0.5 and nothing is toxic; repeated rows
each get their row; labels of null or other than 0 and 1 are ignored, of several labels
of a document the highest counts; rows without doc_id have no label and are not held
out; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

WORD_BUCKETS, STEM_BUCKETS, STEMS = 1 << 16, 1 << 13, (4, 6)
#: A token's code: the word's bucket above those of its stems; below FIRST it is no word.
FIRST = STEM_BUCKETS ** len(STEMS)
DIMENSIONS, WIDTHS, FILTERS = 16, (1, 2, 3), 16
MOST_ROWS, MOST_WORDS, EPOCHS, BATCH, RATE, SEED = 2500, 5000, 8, 32, 0.08, 11
FOLDS, STEPS = 5, 20
STEP = 1 << 15
PAD = max(WIDTHS) - 1


def tokens(text: Column) -> Column:
    """Array of bigints, a code for each lower-cased, punctuation-free word."""
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}\s]+", "")

    def code(w: Column) -> Column:
        out = F.pmod(F.xxhash64(w), F.lit(WORD_BUCKETS - 1)) + 1
        for n in STEMS:
            out = out * STEM_BUCKETS + F.pmod(F.xxhash64(F.left(w, F.lit(n))), F.lit(STEM_BUCKETS))
        return out

    return F.transform(F.array_remove(F.split(plain, r"\s+"), ""), code)


def buckets(codes: np.ndarray) -> list[np.ndarray]:
    """The word's bucket, then each stem's place in the stem table."""
    out = [codes // FIRST]
    for i in range(len(STEMS)):
        out.append(i * STEM_BUCKETS + codes // STEM_BUCKETS ** (len(STEMS) - 1 - i) % STEM_BUCKETS)
    return out


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


@dataclass
class Network:
    word: np.ndarray
    stem: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    @classmethod
    def fresh(cls, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        word, stem = normal(0.3, WORD_BUCKETS, DIMENSIONS), normal(0.3, len(STEMS) * STEM_BUCKETS, DIMENSIONS)
        word[0] = 0
        n = FILTERS * len(WIDTHS)
        return cls(word, stem, [normal(0.3, k * DIMENSIONS, FILTERS) for k in WIDTHS], np.zeros(n, np.float32), normal(0.3, n), 0.0)

    def embed(self, codes: np.ndarray) -> np.ndarray:
        word, *stems = buckets(codes)
        x = self.word[word]
        for stem in stems:
            x += self.stem[stem]
        x[codes < FIRST] = 0
        return x

    def responses(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings, and the response of each filter at each place but the last PAD; places without a word get none."""
        x = self.embed(codes)
        n = len(codes) - PAD
        parts = [np.concatenate([x[j : j + n] for j in range(k)], axis=1) @ w for k, w in zip(WIDTHS, self.filters, strict=True)]
        y = np.concatenate(parts, axis=1) + self.bias
        y[codes[:n] < FIRST] = -1e9
        return x, y

    def score(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def padded(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists one after another with PAD zeros after each; where each then starts."""
    n = np.diff(offsets)
    starts = offsets[:-1] - offsets[0] + PAD * np.arange(len(n))
    out = np.zeros(int(n.sum()) + PAD * len(n), np.int64)
    out[np.arange(int(n.sum())) + np.repeat(PAD * np.arange(len(n)), n)] = values
    return out, starts


def pool(net: Network, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Largest responses over each list, in steps of STEP places."""
    codes, starts = padded(values, offsets)
    pooled = np.full((len(starts), FILTERS * len(WIDTHS)), -1e9, np.float32)
    codes = np.concatenate([codes, np.zeros(PAD, np.int64)])
    total = len(codes) - PAD
    for s in range(0, total, STEP):
        e = min(total, s + STEP)
        y = net.responses(codes[s : e + PAD])[1]
        lo, hi = np.searchsorted(starts, s, "right") - 1, np.searchsorted(starts, e, "left")
        part = np.maximum.reduceat(y, np.maximum(starts[lo:hi] - s, 0), axis=0)
        pooled[lo:hi] = np.maximum(pooled[lo:hi], part)
    return pooled


def fit(docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adagrad on the logistic loss; a pooled filter passes its gradient to the place of its maximum alone."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    squares = {k: np.full_like(v, 1e-3) for k, v in (("word", net.word), ("stem", net.stem), ("bias", net.bias), ("out", net.out))}
    fsq, osq = [np.full_like(w, 1e-3) for w in net.filters], 1e-3

    def rows(name: str, at: np.ndarray, grad: np.ndarray) -> None:
        hit, where = np.unique(at, return_inverse=True)
        g = np.zeros((len(hit), grad.shape[1]), np.float32)
        np.add.at(g, where, grad)
        squares[name][hit] += g * g
        getattr(net, name)[hit] -= RATE * g / np.sqrt(squares[name][hit])

    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for b in range(0, len(order), BATCH):
            chosen = [i for i in order[b : b + BATCH] if len(docs[i])]
            if not chosen:
                continue
            offsets = np.r_[0, np.cumsum([len(docs[i]) for i in chosen])]
            codes, starts = padded(np.concatenate([docs[i] for i in chosen]), offsets)
            codes = np.concatenate([codes, np.zeros(PAD, np.int64)])
            x, y = net.responses(codes)
            ends = np.r_[starts[1:], len(y)]
            top = np.stack([s + y[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)])
            pooled = np.take_along_axis(y, top, axis=0)
            active = np.maximum(pooled, 0)
            error = (net.score(pooled) - labels[chosen]).astype(np.float32) / len(chosen)
            g_out = active.T @ error
            g_pool = error[:, None] * net.out * (pooled > 0)
            squares["out"] += g_out * g_out
            net.out -= RATE * g_out / np.sqrt(squares["out"])
            osq += float(error.sum()) ** 2
            net.out_bias -= RATE * float(error.sum()) / osq**0.5
            g_bias = g_pool.sum(axis=0)
            squares["bias"] += g_bias * g_bias
            net.bias -= RATE * g_bias / np.sqrt(squares["bias"])
            places, grads = [], []
            for n, k in enumerate(WIDTHS):
                cols = slice(n * FILTERS, (n + 1) * FILTERS)
                at, g = top[:, cols], g_pool[:, cols]
                seen = np.concatenate([x[at + j] for j in range(k)], axis=2)
                g_w = np.einsum("dfi,df->if", seen, g)
                back = g[:, :, None] * net.filters[n].T[None]
                for j in range(k):
                    places.append((at + j).reshape(-1))
                    grads.append(back[:, :, j * DIMENSIONS : (j + 1) * DIMENSIONS].reshape(-1, DIMENSIONS))
                fsq[n] += g_w * g_w
                net.filters[n] -= RATE * g_w / np.sqrt(fsq[n])
            at, grad = codes[np.concatenate(places)], np.concatenate(grads)
            at, grad = at[at >= FIRST], grad[at >= FIRST]
            word, *stems = buckets(at)
            rows("word", word, grad)
            for stem in stems:
                rows("stem", stem, grad)
    return net


def labelled(docs: DataFrame, labels: DataFrame, folds: list[int], most: int) -> tuple[np.ndarray, list[str], list[np.ndarray]]:
    """Labels, languages and codes of at most ``most`` rows of each class of the given folds: the bounded sample."""
    marks = marked(labels, folds)
    # the ids are chosen before any text is read
    chosen = None
    for y in (0, 1):
        some = marks.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    # at most 2 * most rows: a proven bound for the broadcast; they are written as texts, or the filter on their words would move down to the scan of all documents
    sample = materialize(slim.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "_y", "lang", "text"), "toxicity-sample")
    rows = sample.select("doc_id", "_y", "lang", tokens(F.col("text")).alias("codes"))
    found = rows.where(F.size("codes") <= MOST_WORDS).dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    lists = found["codes"].combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    return np.array(found["_y"].to_pylist(), np.float32), found["lang"].to_pylist(), [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def marked(labels: DataFrame, folds: list[int]) -> DataFrame:
    """(_id, _y) of the given folds."""
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & fold(F.col("_id")).isin(folds))
    return marks.groupBy("_id").agg(F.max("_y").alias("_y"))


def calibrate(scored: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Each language's threshold of best F1 over all labelled rows of fold 1 among ``scored(doc_id, lang, score)``."""
    marks = marked(labels, [1])
    step = sum((F.col("score") >= k / STEPS).cast("int") for k in range(1, STEPS))
    found = scored.join(marks, F.col("doc_id") == F.col("_id")).groupBy("lang", step.alias("step"), "_y").count().collect()  # 2 * STEPS rows a language
    counts: dict[str, np.ndarray] = {}
    for r in found:
        counts.setdefault(r["lang"], np.zeros((STEPS, 2), np.int64))[r["step"], r["_y"]] = r["count"]
    thresholds = {}
    for lang, n in counts.items():
        f1 = lambda k: 2 * n[k:, 1].sum() / max(1, n[k:].sum() + n[:, 1].sum())  # noqa: E731, B023
        thresholds[lang] = max(range(1, STEPS), key=lambda k: (f1(k), -abs(k / STEPS - 0.5))) / STEPS
    return thresholds


def network(docs: DataFrame, labels: DataFrame) -> Network | None:
    """The network fitted on the bounded sample; None without labels of both classes."""
    y, _, codes = labelled(docs, labels, [2, 3, 4], MOST_ROWS)
    return fit(codes, y) if len(set(y.tolist())) == 2 else None


def train(docs: DataFrame, labels: DataFrame) -> tuple[Network | None, dict[str, float]]:
    """The network, and each language's threshold of best F1 on the calibration fold."""
    net = network(docs, labels)
    if net is None:
        return None, {}
    some = docs.join(marked(labels, [1]), F.col("doc_id").cast("long") == F.col("_id"), "left_semi")
    return net, calibrate(raw_scores(some, net), labels)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            lists = batch.column("codes")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            scores = net.score(pool(net, values, offsets - offsets[0])) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(scores.astype(np.float64))], names=["doc_id", "lang", "score"])

    return run


def raw_scores(docs: DataFrame, net: Network | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, score."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), tokens(F.col("text")).alias("codes"))
    if net is None:
        return slim.select("doc_id", "lang", F.lit(0.5).alias("score"))
    return slim.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(net)), "doc_id long, lang string, score double")


def with_verdict(scored: DataFrame, thresholds: dict[str, float], nothing: bool = False) -> DataFrame:
    """``scored`` with toxic (by the language's threshold, else 0.5)."""
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col("lang")), F.lit(0.5)) if thresholds else F.lit(0.5)
    return scored.withColumn("toxic", F.lit(False) if nothing else F.col("score") >= limit)


def score(docs: DataFrame, net: Network | None, thresholds: dict[str, float]) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, score, toxic."""
    return with_verdict(raw_scores(docs, net), thresholds, net is None)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` by a network and thresholds learnt from ``labels``.  Every text is read as words once: scores
    are written, thresholds come from those of labelled rows, and no text moves."""
    net = network(docs, labels)
    scored = materialize(raw_scores(docs, net), "toxicity-scores")
    return with_verdict(scored, calibrate(scored, labels) if net else {}, net is None)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = classify(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic")
