"""Toxicity: maximum-scoring segments over token log-odds.

Learning.  Tokens are lower-cased runs of letters, digits and non-ASCII
characters.  Each has a chain of ever more special names: its first 4, 5 and 6
bytes, then the whole token.  Along the chain a Dirichlet (two-class) prior of
``PRIOR`` observations passes the parent's toxic share on:
``p = (toxic + PRIOR * p_parent) / (toxic + clean + PRIOR)``, from the share of
toxic tokens at the root, so an unseen ending of a known toxic stem inherits
the stem's share and a rare token stays near its prior.  A token scores the
logit of its share against the root's, bounded, less ``DRIFT``, so that clean
text scores negative on average (both values were chosen on the teaching rows alone:
counts from folds 1-2, curve from 3, errors on 4).  Counts live in ``BUCKETS`` hashed buckets: the
model has the same size however large the corpus.

Scoring.  One linear scan (Ruzzo-Tompa) gives all maximal-scoring segments of
the whole text.  For random clean text the best segment S of m tokens follows
an extreme-value law, P(S >= x) = 1 - exp(-K m exp(-lambda x)); lambda solves
sum p_i exp(lambda s_i) = 1 over clean tokens' scores and K is fitted on clean
documents.  Passages with an expected count K m exp(-lambda S) below
``EVALUE`` are reported.  A document's statistic sums lambda S - ln(K m) over
the passages where it is positive (else it is the best passage's); a logistic
curve fitted on labelled rows maps it to 0..1.

Which rows teach: labels of rows with crc32(doc_id) mod 5 in 1, 2, 3 give the
counts, those with 4 fit K and the curve, those with 0 are held out.  At most
``FIT_ROWS`` labelled rows are used (a documented bound; the rows of smallest
hash), so their ids can be broadcast; the scoring pass needs no shuffle.

Defined cases: null, empty and tokenless texts have no passage and score by
the curve's value for a single token of clean text; a null id is never a
teacher and not held out; null labels are ignored and an id labelled more than
once counts as toxic if any label does; with no clean or no toxic teacher the
score is 0; repeated rows score alike; extra columns pass through
``drop_toxic`` and are not read by ``score``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm import bytewords as bw

PREFIXES = (4, 5, 6, None)
BUCKETS = 1 << 20
PRIOR = 10.0
DRIFT = 3.0
BOUND = 8.0
EVALUE = 0.01
FIT_ROWS = 200_000
PASSAGE = "array<struct<first:long,last:long,score:double,expected:double>>"


@dataclass
class Model:
    toxic: np.ndarray
    clean: np.ndarray
    root: float
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    usable: bool = True


def _bucket(w: bw.Words, level: int) -> np.ndarray:
    h = bw.mix(w.hashes(PREFIXES[level]) + np.uint64(level + 1))
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def fold(id_col: str):
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5))


def teachers(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``id, y, fold`` of the labelled rows used for learning: at most FIT_ROWS."""
    rows = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
            .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
            .withColumn("fold", fold("id")).where("fold <> 0"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)


def _counts(batches):
    """Tokens per bucket and class of one task's teachers."""
    y = bw.Tally(BUCKETS), bw.Tally(BUCKETS)
    total = np.zeros(2, np.int64)
    for b in batches:
        label = b.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, data, off in bw.runs(b.column(0)):
            w = bw.Words(data, off, bw.ALNUM)
            cls = np.repeat(label[lo:hi], w.counts) > 0
            total += (np.count_nonzero(~cls), np.count_nonzero(cls))
            for level in range(len(PREFIXES)):
                at = _bucket(w, level)
                y[1].add(at[cls])
                y[0].add(at[~cls])
    clean, toxic = y[0].counts(), y[1].counts()
    at = np.flatnonzero(clean + toxic)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1)), pa.array(np.append(toxic[at].astype(np.int64), total[1])),
         pa.array(np.append(clean[at].astype(np.int64), total[0]))],
        names=["bucket", "toxic", "clean"])


def token_scores(w: bw.Words, m: Model) -> np.ndarray:
    p = np.full(len(w.starts), m.root, np.float64)
    for level in range(len(PREFIXES)):
        at = _bucket(w, level)
        t, c = m.toxic[at], m.clean[at]
        p = (t + PRIOR * p) / (t + c + PRIOR)
    s = np.log(p) - np.log1p(-p) - np.log(m.root / (1 - m.root))
    return np.clip(s, -BOUND, BOUND) - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) in one linear scan.

    Only positive positions can begin or end one, so the scan visits these
    and takes the stretches between from cumulative sums.
    """
    cum = np.concatenate(([0.0], np.cumsum(scores)))
    at = np.flatnonzero(scores > 0)
    left, right = cum[at].tolist(), cum[at + 1].tolist()
    first: list[int] = []      # candidate segments, in order: first, end, sums before and after
    end: list[int] = []
    lo: list[float] = []
    hi: list[float] = []
    back: list[int] = []       # nearest earlier candidate whose left sum is smaller
    for i, a, b in zip(at.tolist(), left, right):
        start = i
        while True:
            j = len(lo) - 1
            while j >= 0 and lo[j] >= a:
                j = back[j]
            if j < 0 or hi[j] >= b:
                first.append(start)
                end.append(i + 1)
                lo.append(a)
                hi.append(b)
                back.append(j)
                break
            start, a = first[j], lo[j]
            del first[j:], end[j:], lo[j:], hi[j:], back[j:]
    return [(f, e, h - low) for f, e, low, h in zip(first, end, lo, hi)]


def _statistics(column: pa.Array, m: Model, passages: bool):
    """Per text: token count, best segment, statistic, and the significant passages."""
    tokens, best, stat, found = [], [], [], []
    for lo, hi, data, off in bw.runs(column):
        w = bw.Words(data, off, bw.ALNUM)
        s = token_scores(w, m)
        for k in range(hi - lo):
            a, b = int(w.first[k]), int(w.first[k + 1])
            n = max(1, b - a)
            segs = segments(s[a:b])
            norm = m.log_k + np.log(n)
            value = [m.lam * x[2] - norm for x in segs]
            top = max(value, default=-norm)
            tokens.append(n)
            best.append(max((x[2] for x in segs), default=0.0))
            stat.append(float(sum(v for v in value if v > 0)) if top > 0 else float(top))
            if passages:
                found.append([{"first": f, "last": e - 1, "score": x, "expected": float(np.exp(-v))}
                              for (f, e, x), v in zip(segs, value) if v > -np.log(EVALUE)])
    return tokens, best, stat, found


def _solve_lambda(share: np.ndarray, score: np.ndarray) -> float:
    """The positive root of sum share * exp(x * score) = 1 (scores negative on average)."""
    lo, hi = 1e-6, 1.0

    def f(x):
        return float(np.sum(share * np.exp(x * score))) - 1
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve through (statistic, label) with smoothed targets, by Newton steps."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.array([0.1, np.log((pos + 1) / (neg + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (p - t) + 1e-3 * beta * [1, 0]
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    """Learn counts, extreme-value parameters and the curve from labelled rows."""
    spark = docs.sparkSession
    rows = teachers(labels, id_col, label_col)
    taught = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "id")
    got = (taught.where("fold < 4").select("text", "y").mapInArrow(_counts, "bucket long, toxic long, clean long")
           .groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow())
    at, t, c = (got[x].to_numpy() for x in ("bucket", "toxic", "clean"))
    totals = at < 0
    n1, n0 = float(t[totals].sum()), float(c[totals].sum())
    toxic, clean = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    toxic[at[~totals]], clean[at[~totals]] = t[~totals], c[~totals]
    if not n1 or not n0:
        return Model(toxic, clean, 0.5, usable=False)
    m = Model(toxic, clean, n1 / (n1 + n0))
    shared = spark.sparkContext.broadcast(m)

    def scored(batches):
        m = shared.value
        edges = np.linspace(-BOUND - DRIFT, BOUND - DRIFT, 257)
        hist = np.zeros((2, 256), np.int64)
        value = np.zeros((2, 256))
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in bw.runs(b.column(0)):
                w = bw.Words(data, off, bw.ALNUM)
                s = token_scores(w, m)[np.repeat(label[lo:hi], w.counts) == 0]
                hist[0] += np.histogram(s, edges)[0]
                value[0] += np.histogram(s, edges, weights=s)[0]
        at = np.flatnonzero(hist[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(hist[0][at]), pa.array(value[0][at])], names=["bin", "n", "total"])
    check = taught.where("fold = 4").select("text", "y")
    bins = (check.mapInArrow(scored, "bin long, n long, total double").groupBy("bin")
            .agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow())
    n = bins["n"].to_numpy().astype(float)
    if not len(n):
        return m
    m.lam = _solve_lambda(n / n.sum(), bins["total"].to_numpy() / n)

    def stats(m):
        shared = spark.sparkContext.broadcast(m)

        def run(batches):
            m = shared.value
            for b in batches:
                tokens, best, stat, _ = _statistics(b.column(0), m, False)
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(best, pa.float64()),
                                                  pa.array(stat, pa.float64()), b.column(1)], names=["m", "best", "stat", "y"])
        return check.mapInArrow(run, "m long, best double, stat double, y int")
    clean_rows = stats(m).where("y = 0 and best > 0")
    mean = clean_rows.agg(F.avg(F.lit(m.lam) * F.col("best") - F.log(F.col("m").cast("double")))).first()[0]
    m.log_k = float(mean - np.euler_gamma) if mean is not None else 0.0
    got = stats(m).select("stat", "y").toArrow()
    x, y = got["stat"].to_numpy(), got["y"].to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        m.slope, m.offset = _logistic(x, y)
    return m


def with_scores(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """All columns of ``docs`` plus score and passages; returns (table, score name, passages name)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = bw.fresh(docs, "toxicity"), bw.fresh(docs, "passages")
    kind = T._parse_datatype_string(PASSAGE)
    arrow = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def make():
        m = shared.value

        def run(column):
            if not m.usable:
                return [pa.array([0.0] * len(column)), pa.array([[]] * len(column), arrow)]
            _, _, stat, found = _statistics(column, m, True)
            z = np.clip(m.slope * np.array(stat) + m.offset, -500, 500)
            return [pa.array(1 / (1 + np.exp(-z))), pa.array(found, arrow)]
        return run
    return bw.append_columns(docs, text_col, [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], kind)], make), *names


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id, score, predicted, passages`` (token numbers, score, expected count)."""
    df, value, passages = with_scores(docs.select(id_col, text_col), model, text_col)
    return df.select(F.col(id_col), F.col(value).alias("score"), (F.col(value) >= 0.5).cast("int").alias("predicted"),
                     F.col(passages).alias("passages"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Documents that are not predicted toxic, with all their columns."""
    df, value, _ = with_scores(docs, model, text_col)
    return df.where(F.col(value) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
