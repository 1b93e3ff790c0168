"""Near-duplicate documents: bottom-k sketches of one hash function.

A text's set is its distinct five-word shingles (a shorter text: all its words
as one shingle).  Two documents are linked when 100 * |A and B| >= 85 *
|A or B|; the components of these links are the groups.

1. Documents with equal sets (hash, size and checksum of the sorted set) form
   a class; from here on a class is one item, however many copies it has.
2. A class retains the K smallest of its shingle hashes.  Inverted lists of
   the retained values generate the overlaps.  Of the K values only the
   rarest are needed: linked sets share at least ``NEED`` of their K values
   (all but with probability 1e-9, the lower tail of the binomial of K draws
   at 0.85; certain for sets of at most K shingles), so each class enters the
   lists of its K - NEED + 1 rarest values and common passages drop out of
   the lists of texts that have anything else.
3. A list of up to ``SMALL`` classes yields pairs.  The union sketch (K
   smallest of both) estimates their similarity and filters; the full sets
   then decide each link exactly.
4. A longer list is cut into blocks by size; each pair of blocks is one
   bounded unit of work that compares the full sets of all its classes and
   returns a spanning forest of the links it finds.  No list is capped, and
   no group's pairs are written out.
5. ``connected_components`` joins the links.

Defined cases: null, empty and blank texts have an empty set, link with
nothing and are kept; repeated rows and equal texts are one class; a row with
a null id is grouped and links like any other but never names its group (its group's
smallest id does; a group of null ids only has a null component and ``groups`` marks each of its rows
kept); ``drop_copies`` keeps exactly one row of every group, told apart by id and text, not by id
alone: the smallest id's (null last; the smallest text hash of it, one of equal rows); ties go to the smallest id; an empty table gives no rows; extra
columns are not read by ``groups`` and pass through ``drop_copies``.
Links are decided on 64-bit hashes of all shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm import bytewords as bw
from tempora.llm.components import connected_components

WORDS = 5
K = 32
MISS = 1e-9
SMALL = 96
BLOCK_ROWS = 512
BLOCK_HASHES = 1 << 18
PERCENT = 85


def need(percent: int, k: int = K) -> int:
    """Values of k that sets of this similarity share, all but with probability ``MISS``."""
    p, total = percent / 100, 0.0
    for m in range(k + 1):
        total += math.comb(k, m) * p ** m * (1 - p) ** (k - m)
        if total >= MISS:
            return m
    return k


def _sets(column: pa.Array):
    """Sorted distinct shingle hashes of every text of a batch."""
    for lo, hi, data, off in bw.runs(column):
        w = bw.Words(data, off, bw.NOT_SPACE)
        words = w.hashes()
        c = bw.prefix_hash(words, bw.WORD_BASE)
        for k in range(hi - lo):
            a, b = int(w.first[k]), int(w.first[k + 1])
            if a == b:
                yield np.zeros(0, np.uint64)
                continue
            size = min(WORDS, b - a)
            at = np.arange(a, b - size + 1)
            h = bw.range_hash(c, at, at + size, bw.WORD_BASE)
            yield np.unique(bw.mix(h + bw.salt(size, bw.WINDOW_SALT)))


def _key(s: np.ndarray) -> int:
    """Class key: a 64-bit hash of the whole sorted set."""
    order = np.arange(1, len(s) + 1, dtype=np.uint64)
    x = bw.mix(s + order * np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(bw.mix(np.array([x], np.uint64)).astype(np.int64)[0])


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: ``id, t`` (a hash of the text), ``n, c`` (set size, class key) and ``low``, its K smallest hashes."""
    def rows(batches):
        for b in batches:
            n, keys, low = [], [], []
            for s in _sets(b.column(1)):
                n.append(len(s))
                keys.append(_key(s) if len(s) else None)
                low.append(s[:K].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(low, pa.list_(pa.int64()))],
                names=["id", "t", "n", "c", "low"])
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
            .mapInArrow(rows, f"id {dict(docs.dtypes)[id_col]}, t long, n long, c long, low array<long>"))


def _full_sets(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """``c, hashes`` for the wanted classes, from one text of each (wanted: ``c, t``; other
    texts of the same hash have other sets, hence other keys)."""
    def rows(batches):
        for b in batches:
            keys, sets = [], []
            for c, s in zip(b.column(0).to_pylist(), _sets(b.column(1))):
                if len(s) and _key(s) == c:
                    keys.append(c)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["c", "hashes"])
    d = docs.select(F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    return d.join(wanted, "t").select("c", "text").mapInArrow(rows, "c long, hashes binary").dropDuplicates(["c"])


def _similar(common, n_a, n_b, percent):
    return 100 * common >= percent * (n_a + n_b - common)


def _estimate_ok(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Union sketch: shared values among the K smallest of both reach ``least`` of K."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    both = np.union1d(a, b)[:K]
    shared = np.intersect1d(np.intersect1d(a, b, True), both, True)
    return len(shared) * K >= least * min(K, len(both))


def _pairs(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs within short lists that pass the size and union-sketch filters: ``a, b``."""
    x = lists.select("v", F.col("c").alias("a"), F.col("n").alias("n_a"))
    y = lists.select("v", F.col("c").alias("b"), F.col("n").alias("n_b"))
    pairs = (x.join(y, "v").where("a < b").where(
        (100 * F.least("n_a", "n_b")) >= percent * F.greatest("n_a", "n_b")).select("a", "b").distinct())
    s = classes.select("c", "low")
    both = (pairs.join(s.select(F.col("c").alias("a"), F.col("low").alias("low_a")), "a")
            .join(s.select(F.col("c").alias("b"), F.col("low").alias("low_b")), "b").select("a", "b", "low_a", "low_b"))

    least = need(percent)

    def keep(batches):
        for t in batches:
            ok = [_estimate_ok(np.array(p), np.array(q), least)
                  for p, q in zip(t.column(2).to_pylist(), t.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(t.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return both.mapInArrow(keep, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = (pairs.join(sets.select(F.col("c").alias("a"), F.col("hashes").alias("set_a")), "a")
            .join(sets.select(F.col("c").alias("b"), F.col("hashes").alias("set_b")), "b").select("a", "b", "set_a", "set_b"))

    def keep(batches):
        for t in batches:
            ok = []
            for p, q in zip(t.column(2), t.column(3)):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                ok.append(_similar(len(np.intersect1d(p, q, True)), len(p), len(q), percent))
            yield pa.RecordBatch.from_arrays(t.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return both.mapInArrow(keep, "a long, b long")


def block_links(keys: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Spanning forest of the links among sets (of different sides, or of one side only)."""
    n = len(keys)
    size = np.array([len(s) for s in sets], np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    many = np.bincount(column, minlength=len(values)) > 1
    number = np.cumsum(many) - 1
    keep = many[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.float32)
    width = max(256, (1 << 22) // n)
    for lo in range(0, int(many.sum()), width):
        a, b = np.searchsorted(column, (lo, lo + width))
        x = np.zeros((n, width), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        common += x @ x.T
    linked = _similar(common.astype(np.int64), size[:, None], size[None, :], percent)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    out, new = [], np.ones(n, bool)
    for start in range(n):
        if not new[start]:
            continue
        new[start], queue = False, [start]
        while queue:
            i = queue.pop()
            found = np.flatnonzero(linked[i] & new)
            new[found] = False
            queue.extend(found.tolist())
            out.extend((int(keys[i]), int(keys[j])) for j in found)
    return out


def _block_pairs(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within long lists: ``lists`` has ``v, c, blocks``."""
    mine = F.pmod(F.xxhash64("c", F.lit(7)), F.col("blocks")).cast("int")
    spread = (lists.withColumn("mine", mine)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
              .select("v", "c", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                      (F.col("mine") > F.col("other")).alias("upper")))

    def links(t: pa.Table) -> pa.Table:
        found = block_links(t["c"].to_numpy(), t["upper"].to_numpy(zero_copy_only=False),
                            [np.frombuffer(x.as_buffer(), np.uint64) for x in t["hashes"]], percent)
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return spread.join(sets, "c").groupBy("v", "i", "j").applyInArrow(links, "a long, b long")


def links(docs: DataFrame, items: DataFrame, text_col: str, percent: int = PERCENT) -> DataFrame:
    """Links ``a, b`` between class keys; ``items`` is the checkpointed ``sketches``.

    Every link is in the result or follows from others in it.
    """
    classes = (items.where("n > 0").groupBy("c").agg(F.first("n").alias("n"), F.first("low").alias("low"), F.min("t").alias("t")))
    classes = classes.checkpoint()
    post = classes.select("c", "n", F.explode("low").alias("v"))
    lists = post.groupBy("v").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total")).where("df > 1")
    shared = post.join(lists, "v")
    # the rarest values come first: those that no other class retains, then by list length
    held = F.least(F.col("n"), F.lit(K))
    # (a set of at most K shingles is known whole; a linked one may keep up to n / 0.85 - K more unseen)
    unseen = F.greatest(F.floor(F.col("n") * 100 / percent) - K, F.lit(0))
    least = F.when(F.col("n") <= K, F.ceil(F.col("n") * percent / 100) - unseen).otherwise(F.lit(need(percent)))
    room = held - least + 1 - (held - F.size("found"))
    entries = (shared.groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v", "total"))).alias("found"))
               .withColumn("room", F.greatest(room, F.lit(0)).cast("int"))
               .where("room > 0")
               .select("c", "n", F.explode(F.slice("found", F.lit(1), F.col("room"))).alias("e"))
               .select("c", "n", "e.v", "e.df", "e.total")).checkpoint()
    blocks = F.greatest(F.ceil(F.col("df") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_HASHES)).cast("int")
    short = entries.where(F.col("df") <= SMALL)
    long = entries.where(F.col("df") > SMALL).select("v", "c", blocks.alias("blocks"))
    pairs = _pairs(short, classes, percent).checkpoint()
    wanted = (pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c")))
              .unionByName(long.select("c")).distinct().join(classes.select("c", "t"), "c"))
    sets = _full_sets(docs, text_col, wanted).checkpoint()
    return _verify(pairs, sets, percent).unionByName(_block_pairs(long, sets, percent))


def _components(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """(``sketches``; ``c, root`` of every class that has links)."""
    items = sketches(docs, id_col, text_col).checkpoint()
    found = connected_components(links(docs, items, text_col, percent), "a", "b")
    return items, found.select(F.col("node").alias("c"), "root")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per document: ``id, n_shingles, component_id, kept``."""
    items, found = _components(docs, id_col, text_col, percent)
    named = items.where("n > 0").groupBy("c").agg(F.min("id").alias("first_id"))
    least = found.join(named, "c").groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = (named.join(found.join(least, "root").select("c", "least_id"), "c", "left")
             .select("c", F.coalesce("least_id", "first_id").alias("component")))
    out = items.select("id", "n", "c").join(named, "c", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    kept = (F.when((F.col("n") == 0) | F.col("component").isNull(), F.lit(True))
            .otherwise(F.coalesce(F.col("id") == F.col("component"), F.lit(False))))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      kept.alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each group stays, with all its columns; so do all texts without words."""
    items, found = _components(docs, id_col, text_col, percent)
    # rows by id and text; a group's keeper has the smallest id, null last, then the smallest text hash
    rows = items.where("n > 0").groupBy("c", "id", "t").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.join(found, "c", "left").withColumn("root", F.coalesce("root", "c"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "t")
    first = rows.groupBy("root").agg(F.min(order).alias("first"))
    keeper = order.eqNullSafe(F.col("first"))
    verdict = rows.join(first, "root").select(F.col("id").alias("_id"), F.col("t").alias("_t"), keeper.alias("_keeper"), "copies").checkpoint()
    own = docs.withColumn("_hash", F.xxhash64(text_col))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_t"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    several = F.col("_keeper") & (F.col("copies") > 1)
    rest = own.join(verdict.where(~F.col("_keeper") | several), same, "left_anti").select(*columns)
    # equal rows of a keeper: one of them, by a hash of all columns
    one = F.row_number().over(Window.partitionBy("_id", "_t").orderBy(F.xxhash64(*columns)))
    return rest.unionByName(own.join(verdict.where(several), same).withColumn("_one", one).where(F.col("_one") == 1).select(*columns))
