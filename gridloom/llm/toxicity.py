"""Toxicity by maximum-scoring segments.

A token's score is its log-odds of standing in a toxic text, under a chain of Dirichlet
priors: a word's class shares are drawn to those of its longest prefix, a prefix's to
those of the next shorter one, the shortest's to the corpus' (so an unseen form of a
known stem is scored by its stem).  Evidence is the number of different contexts
(neighbouring words) in toxic texts, so that copies of a passage count once, against
occurrences in other texts.

Each token's log-odds, negative ones included, less a drift is a step of a walk; one
linear scan finds all maximal-scoring segments.  Only rises are visited: falls between
them are differences of the walk's sums.  The segments' scores are put on the scale of the
extreme values of other texts: with ``lam`` the root of E exp(lam * step) = 1 and ``K``
fitted to the other texts' best segments, a text of n tokens has a segment of score s by
chance about ``K n exp(-lam s)`` times.  The normalised scores of a text's significant
segments are summed, and two more fitted numbers turn the sum into a probability.

The fit uses a bounded sample (``train_rows``) of labelled texts; nothing but
the text is ever used to score.  Defined results: a null or empty text has no
segments and gets the probability of a text without evidence; rows with null ids are
scored like others and never learnt from; repeated rows are scored each; of equal
scores the earlier segment comes first; a long text is scored as a whole; several labels
of an id count as toxic if one is; null labels aren't used; if there are no labels of
one kind, all scores are 0; columns ``score`` and ``passages`` are replaced; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import small_batches, tidy
from .decontaminate import BREAKS
from .textcore import BYTE_CODES, BYTE_POWERS, LOWER, U64, joined_bytes, member, mix, prefix_hash, range_hash, slices, word_bounds

TRAIN_ROWS = 20_000
#: Prefix lengths in bytes, from short to long; 0 stands for the word itself.
LEVELS = (4, 5, 6, 7, 0)
STRENGTH, DRIFT, LEAST_CONTEXTS = 20.0, 0.5, 3
SIGNIFICANT = 0.05
#: Steps are counted to this part of one, for the calibration.
BINS = 64


@dataclass
class Model:
    level: list  # for each level: (sorted feature hashes, their scores)
    lam: float
    k: float
    a: float
    b: float


def tokens(column: pa.Array) -> dict:
    """Word places of a slice and the features of every level."""
    buf, bounds = joined_bytes(column)
    buf = LOWER[buf]
    start, end, in_words = word_bounds(buf, bounds, BREAKS)
    h = prefix_hash(BYTE_CODES[buf], BYTE_POWERS)
    return {"start": start, "end": end, "bounds": in_words, "hash": h}


def features(t: dict, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(words that have a feature of this level, its hash)."""
    start, end = t["start"], t["end"]
    if not level:
        return np.arange(len(start)), mix(range_hash(t["hash"], start, end, BYTE_POWERS))
    at = np.flatnonzero(end - start > level)
    return at, mix(range_hash(t["hash"], start[at], start[at] + level, BYTE_POWERS) ^ U64(level))


def token_scores(t: dict, model: Model) -> np.ndarray:
    """Log-odds of each word by its most specific known feature; 0 without any."""
    out = np.zeros(len(t["start"]))
    for level, (known, value) in zip(LEVELS, model.level):
        if len(known):
            at, h = features(t, level)
            hit = np.flatnonzero(member(h, known))
            out[at[hit]] = value[np.searchsorted(known, h[hit])]
    return out


def maximal_segments(steps: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a walk, in order of place, in linear time (Ruzzo and Tompa).

    A candidate knows the last one before it that begins lower; so a search passes each candidate once.
    """
    total = np.concatenate([[0.0], np.cumsum(steps)])
    rises = np.flatnonzero(steps > 0)
    first, last, low, high, lower = [], [], [], [], []
    for p, l, r in zip(rises.tolist(), total[rises].tolist(), total[rises + 1].tolist()):
        begin, j = p, len(low) - 1
        while j >= 0 and low[j] >= l:
            j = lower[j]
        while j >= 0 and high[j] < r:  # joins all candidates from j on
            begin, l = first[j], low[j]
            at, j = j, lower[j]
            for x in (first, last, low, high, lower):
                del x[at:]
        first.append(begin)
        last.append(p)
        low.append(l)
        high.append(r)
        lower.append(j)
    return [(a, b, y - x) for a, b, x, y in zip(first, last, low, high)]


def text_segments(t: dict, scores: np.ndarray) -> Iterator[list[tuple[int, int, float]]]:
    steps = scores - DRIFT
    edge = t["bounds"]
    rising = np.concatenate([[0], np.cumsum(steps > 0)])[edge]
    for i in range(len(edge) - 1):
        yield maximal_segments(steps[edge[i] : edge[i + 1]]) if rising[i + 1] > rising[i] else []


def evidence(segments: list, n: int, lam: float, k: float) -> float:
    """Sum of the normalised scores of a text's significant segments; at least that of its best one."""
    if not segments:
        return 0.0
    norm = [lam * s - math.log(k * max(n, 1)) for _, _, s in segments]
    return max(max(norm), sum(x for x in norm if x > -math.log(SIGNIFICANT)), 0.0)


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of at most about ``rows`` labelled texts, chosen by a hash of the id."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = min(1.0, rows / max(n, 1))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    # bounded by ``rows``, so it can be sent to every executor
    return docs.join(F.broadcast(some), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, folder: str, train_rows: int = TRAIN_ROWS) -> Model:
    """``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); ``folder`` is new and shared."""
    spark = small_batches(docs).sparkSession
    _sample(docs, labels, train_rows).write.parquet(folder)
    train = spark.read.schema("text string, toxic int").parquet(folder)
    count = {bool(r.toxic): (r.n, r.words or 0) for r in train.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.size(F.split(F.coalesce("text", F.lit("")), " "))).alias("words")).collect()}
    if len(count) < 2:
        return Model([(np.zeros(0, U64), np.zeros(0))] * len(LEVELS), 1.0, 1.0, -60.0, 0.0)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, "text"):
                t = tokens(batch.column(0).slice(a, b - a))
                _, word = features(t, 0)
                n = len(word)
                if not n:
                    continue
                near = np.zeros(n + 2, U64)
                near[1:-1] = word
                ctx = mix(near[:-2] * U64(3) + near[2:] * U64(7) + word)
                above, of = np.full(n, -1), np.zeros(n, U64)  # each word's longest prefix so far: level, feature
                for k, level in enumerate(LEVELS):
                    at, h = features(t, level)
                    both, row = np.unique(np.stack([h, ctx[at]], 1), axis=0, return_index=True)
                    at = at[row]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(both), k), pa.int32()), pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].view(np.int64)),
                        pa.array(above[at], pa.int32()), pa.array(of[at].view(np.int64)),
                    ], ["level", "feature", "context", "above", "prefix"])
                    if level:
                        at, h = features(t, level)
                        above[at], of[at] = k, h

    seen = train.where("toxic = 1").select("text").mapInArrow(tidy(contexts), "level int, feature long, context long, above int, prefix long")
    seen = seen.groupBy("level", "feature", "context").agg(F.first("above").alias("above"), F.first("prefix").alias("prefix"))
    often = seen.groupBy("level", "feature").agg(F.count("*").alias("n"), F.first("above").alias("above"), F.first("prefix").alias("prefix")).where(F.col("n") >= LEAST_CONTEXTS).toPandas()
    level = []
    for k in range(len(LEVELS)):
        mine = often[often.level == k]
        h = mine.feature.to_numpy(np.int64).view(U64)
        order = np.argsort(h)
        level.append((h[order], mine.n.to_numpy(np.float64)[order], mine.above.to_numpy(np.int64)[order], mine.prefix.to_numpy(np.int64).view(U64)[order]))
    shared = spark.sparkContext.broadcast([x[0] for x in level])

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(h), np.int64) for h in shared.value]
        for batch in batches:
            for a, b in slices(batch, "text"):
                t = tokens(batch.column(0).slice(a, b - a))
                for k, known in enumerate(shared.value):
                    _, h = features(t, LEVELS[k])
                    h = h[member(h, known)]
                    total[k] += np.bincount(np.searchsorted(known, h), minlength=len(known))
        for k, n in enumerate(total):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["level", "at", "n"])

    clean = train.where("toxic = 0").select("text").mapInArrow(tidy(occurrences), "level int, at long, n long").groupBy("level", "at").agg(F.sum("n").alias("n")).toPandas()
    sent = spark.sparkContext.broadcast(_log_odds(level, clean, count))

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, "text"):
                part = batch.slice(a, b - a)
                t = tokens(part.column(0))
                seg = [[x for *_, x in found] for found in text_segments(t, token_scores(t, sent.value))]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(np.diff(t["bounds"]), pa.int64()), pa.array(seg, pa.list_(pa.float64()))], ["toxic", "n", "segments"])

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, "text"):
                bins, n = np.unique(np.round((token_scores(tokens(batch.column(0).slice(a, b - a)), sent.value) - DRIFT) * BINS).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n, pa.int64())], ["bin", "n"])

    rows = train.select("text", "toxic").mapInArrow(walks, "toxic int, n long, segments array<double>").collect()  # bounded by train_rows
    steps = train.where("toxic = 0").select("text").mapInArrow(histogram, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    return _calibrate(sent.value, rows, np.array([(r.bin / BINS, r.n) for r in sorted(steps)]).reshape(-1, 2))


def _log_odds(level: list, clean, count: dict) -> Model:
    base = count[True][1] / max(1, count[True][1] + count[False][1])
    base = min(max(base, 1e-6), 1 - 1e-6)
    prior = math.log(base / (1 - base))
    shares: list = []
    for k, (h, toxic, above, prefix) in enumerate(level):
        other = np.zeros(len(h))
        mine = clean[clean.level == k]
        other[mine["at"].to_numpy(np.int64)] = mine["n"].to_numpy(np.float64)
        mean = np.full(len(h), base)  # that of the level above, which was done before
        for up in range(k):
            at = np.flatnonzero(above == up)
            found = np.searchsorted(level[up][0], prefix[at])
            ok = found < len(level[up][0])
            ok[ok] = level[up][0][found[ok]] == prefix[at[ok]]
            mean[at[ok]] = shares[up][found[ok]]
        shares.append((toxic + STRENGTH * mean) / (toxic + other + STRENGTH))
    return Model([(x[0], np.log(q / (1 - q)) - prior) for x, q in zip(level, shares)], 1.0, 1.0, 0.0, 1.0)


def _calibrate(model: Model, rows: list, steps: np.ndarray) -> Model:
    """``steps``: (step, number) of the other texts' tokens."""
    other = [r for r in rows if not r.toxic]
    total = max(1.0, steps[:, 1].sum())
    # the root of E exp(lam * step) = 1
    mean = lambda lam: (steps[:, 1] * np.exp(np.minimum(lam * steps[:, 0], 500))).sum() / total
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < 1 else (lo, mid)
    lam = min(lo, 5.0)
    # K so that the expected number of segments at the other texts' scores is the number found
    found = sorted((s for r in other for s in r.segments), reverse=True)
    tail = found[: max(1, len(found) // 10)]
    k = len(tail) / (total * math.exp(-lam * tail[-1])) if tail else 1.0
    model.lam, model.k = lam, max(k, 1e-9)
    x = np.array([evidence([(0, 0, s) for s in r.segments], r.n, model.lam, model.k) for r in rows])
    y = np.array([float(bool(r.toxic)) for r in rows])
    model.a, model.b = _logistic(np.log1p(x), y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a weak prior on both."""
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        grad = design.T @ (y - p) - 0.05 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``passages`` (first and last word, score) added."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c not in ("score", "passages")]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in columns)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b in slices(batch, text):
                part = batch.slice(a, b - a)
                t = tokens(part.column(columns.index(text)))
                score, passages = [], []
                for found, n in zip(text_segments(t, token_scores(t, model)), np.diff(t["bounds"]).tolist()):
                    z = model.a + model.b * math.log1p(evidence(found, n, model.lam, model.k))
                    score.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
                    passages.append([{"first": x, "last": y, "score": s} for x, y, s in found if model.lam * s - math.log(model.k * max(n, 1)) > -math.log(SIGNIFICANT)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64()), pa.array(passages, kind)], [*columns, "score", "passages"])

    return docs.select(*[f"`{c}`" for c in columns]).mapInArrow(tidy(run), f"{fields}score double, passages array<struct<first:long,last:long,score:double>>")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
