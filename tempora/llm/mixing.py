"""Mixing sources to target weights: temperature mixing with budgeted blocks.

Weights.  A source's weight is its token share to the power ``tau``,
normalised.  ``tau`` = 1 keeps the natural shares and 0 makes all sources
equal.  The largest exponent whose entropy reaches ``entropy`` times the
logarithm of the number of sources is bisected (each pass over the source
table takes four halvings at once); if the most repeated source would then be
seen more than ``max_repeats`` times, the exponent is raised until it is not.
The default budget is the smallest that shows every document at least once,
so the least repeated source gets exactly one pass and nothing is dropped.

Realisation.  A source's documents are dealt to blocks of about
``BLOCK_TOKENS`` tokens by a hash of their id and text.  Each epoch permutes the blocks
(by a hash of seed, epoch and block); whole epochs take all blocks, the last
one takes blocks in that order until the source's budget is met, and only the
block in which it ends is cut, by the documents' own permutation, to the
nearest document.  ``position`` in [0, 1) spreads every source evenly over the
mixture: ordering by it gives the target weights in every stretch.

Scale: cumulative sums run over blocks, not documents; only a cut block is
ranked by document, so a source with a third of all rows is spread over its
blocks.  Nothing but a few sums per bisection pass reaches the driver.

Defined cases: null and empty texts have no tokens and travel with their
block; a null source is a source of its own; sources without any token have
weight 0 and are not emitted; ties in a permutation are broken by id and
fingerprint; repeated rows are each a document; a null id is dealt like any
other value; an empty table gives an empty mixture; extra columns pass
through, new ones take fresh names if theirs are taken.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm import bytewords as bw

ENTROPY = 0.9
MAX_REPEATS = 4.0
BLOCK_TOKENS = 1 << 20
SEED = 17
PASSES = 7


def with_tokens(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """All columns and the number of white-space separated words of the whole text."""
    name = bw.fresh(docs, "n_tokens")

    def make():
        def run(column):
            out = [bw.Words(data, off, bw.NOT_SPACE, lower=False).counts for _, _, data, off in bw.runs(column)]
            return [pa.array(np.concatenate(out) if out else [], pa.int64())]
        return run
    return bw.append_columns(docs, text_col, [T.StructField(name, T.LongType())], make), name


def _search(sources: DataFrame, meets) -> float:
    """Largest tau in [0, 1] with ``meets``, which holds below some exponent; 0 if none."""
    lo, hi = 0.0, 1.0
    if meets(sources, [1.0])[0]:
        return 1.0
    for _ in range(PASSES):
        points = [lo + (hi - lo) * i / 16 for i in range(1, 16)]
        ok = meets(sources, points)
        k = sum(1 for x in ok if x)
        lo, hi = ([lo] + points)[k], (points + [hi])[k]
    return lo


def _entropies(sources: DataFrame, taus: list[float]) -> list[float]:
    power = [F.pow("share", F.lit(t)) for t in taus]
    row = sources.agg(*[F.sum(p).alias(f"z{i}") for i, p in enumerate(power)],
                      *[F.sum(p * F.log("share")).alias(f"l{i}") for i, p in enumerate(power)]).first()
    return [math.log(row[f"z{i}"]) - t * row[f"l{i}"] / row[f"z{i}"] for i, t in enumerate(taus)]


def _repeats(sources: DataFrame, taus: list[float], budget: float | None) -> list[float]:
    """Passes over the most repeated source at each exponent."""
    rate = [F.pow("share", F.lit(t - 1)) for t in taus]
    row = sources.agg(*[F.max(r).alias(f"m{i}") for i, r in enumerate(rate)], *[F.min(r).alias(f"n{i}") for i, r in enumerate(rate)],
                      *[F.sum(F.pow("share", F.lit(t))).alias(f"z{i}") for i, t in enumerate(taus)], F.sum("tokens").alias("all")).first()
    return [row[f"m{i}"] / (row[f"n{i}"] if budget is None else row[f"z{i}"] * row["all"] / budget) for i in range(len(taus))]


def weights(tokens: DataFrame, source_col: str, token_col: str, entropy: float = ENTROPY,
            max_repeats: float = MAX_REPEATS, budget: float | None = None) -> DataFrame:
    """Per source: ``source, tokens, share, tau, weight, quota`` (tokens to emit)."""
    totals = (tokens.groupBy(F.col(source_col).alias("source")).agg(F.sum(token_col).alias("tokens"))
              .where("tokens > 0").checkpoint())
    row = totals.agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("k")).first()
    if not row.k:
        return totals.select("source", "tokens", *[F.lit(0.0).alias(c) for c in ("share", "tau", "weight", "quota")])
    shares = totals.withColumn("share", F.col("tokens") / F.lit(float(row.n)))
    target = entropy * math.log(row.k) if row.k > 1 else 0.0
    tau = _search(shares, lambda s, ts: [h >= target for h in _entropies(s, ts)])
    # repetition falls as the exponent rises: search from the other end
    if _repeats(shares, [tau], budget)[0] > max_repeats:
        up = _search(shares, lambda s, ts: [r > max_repeats for r in _repeats(s, ts, budget)])
        tau = min(1.0, max(tau, up + 16.0 ** -PASSES))
    got = shares.agg(F.sum(F.pow("share", F.lit(tau))).alias("z"), F.min(F.pow("share", F.lit(tau - 1))).alias("low")).first()
    total = float(budget) if budget is not None else row.n * got.z / got.low
    weight = F.pow("share", F.lit(tau)) / F.lit(got.z)
    return shares.select("source", "tokens", "share", F.lit(tau).alias("tau"), weight.alias("weight"), (weight * total).alias("quota"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, budget: float | None = None, seed: int = SEED,
        columns: list[str] | None = None) -> DataFrame:
    """The mixture: a row per emitted document, with all its columns (or those
    named in ``columns``) and ``n_tokens, epoch, block, position``."""
    taken = list(docs.columns) if columns is None else columns
    names = {}
    for c in ("n_tokens", "epoch", "block", "position"):       # fresh among the columns that come out
        names[c] = c
        while names[c].lower() in {t.lower() for t in taken}:
            names[c] = "_" + names[c]
    df, tok = with_tokens(docs, text_col)
    # the caller's columns travel as one struct, so none of their names meets one used here
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in taken]).alias("row"), F.col(f"`{id_col}`").alias("id"),
                   F.xxhash64(F.col(f"`{text_col}`")).alias("t"), F.col(f"`{source_col}`").alias("source"), F.col(tok).alias("n"))
    plan = weights(df.select("source", "n"), "source", "n", entropy, max_repeats, budget)
    passes = F.col("quota") / F.col("tokens")
    plan = (plan.withColumn("whole", F.floor(passes + 1e-9).cast("int"))
            .withColumn("rest", F.greatest(F.col("quota") - F.col("whole") * F.col("tokens"), F.lit(0.0)))
            .withColumn("rest", F.when(F.col("rest") > 1e-6 * F.col("tokens"), F.col("rest")).otherwise(0.0))
            .withColumn("blocks", F.ceil(F.col("tokens") / F.lit(BLOCK_TOKENS)).cast("long"))
            .select(F.col("source").alias("src"), "tokens", "quota", "whole", "rest", "blocks").checkpoint())
    dealt = (df.join(plan.select("src", "blocks"), F.col("source").eqNullSafe(F.col("src")))
             .select("row", "id", "t", "src", "n", F.pmod(F.xxhash64(F.lit(seed), "id", "t"), "blocks").alias("block"),
                     F.xxhash64(F.lit(seed + 1), "id", "t").alias("rank")))
    sizes = dealt.groupBy(F.col("src").alias("s"), F.col("block").alias("b")).agg(F.sum("n").alias("size"))
    epochs = F.sequence(F.lit(0), F.col("whole") - F.when(F.col("rest") > 0, 0).otherwise(1))
    order = Window.partitionBy("s", "e").orderBy(F.xxhash64(F.lit(seed), "e", "b"), "b").rowsBetween(Window.unboundedPreceding, -1)
    turns = (sizes.join(plan, F.col("s").eqNullSafe(F.col("src")))
             .withColumn("e", F.explode(epochs))
             .withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
             .withColumn("room", F.when(F.col("e") < F.col("whole"), F.col("size").cast("double"))
                         .otherwise(F.col("rest") - F.col("before")))
             .where((F.col("room") > 0) | ((F.col("size") == 0) & (F.col("e") < F.col("whole"))))
             .select("s", "b", "e", "before", "size", "room", "quota", "tokens"))
    rows = dealt.join(turns, F.col("src").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    cut = F.col("room") < F.col("size")
    inside = (Window.partitionBy("s", "b", "e").orderBy(F.xxhash64("rank", "e"), "id", "t")
              .rowsBetween(Window.unboundedPreceding, -1))
    partly = (rows.where(cut).withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0)))
              .where(F.col("ahead") + F.col("n") / 2 <= F.col("room")))
    fully = rows.where(~cut).withColumn("ahead", F.pmod(F.xxhash64("rank", "e"), F.greatest(F.col("size"), F.lit(1))))
    position = (F.col("e") * F.col("tokens") + F.col("before") + F.col("ahead")) / F.col("quota")
    return partly.unionByName(fully).select(
        *[F.col("row").getField(c).alias(c) for c in taken], F.col("n").alias(names["n_tokens"]),
        F.col("e").alias(names["epoch"]), F.col("block").alias(names["block"]), position.alias(names["position"]))
