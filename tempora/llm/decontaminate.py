"""Benchmark decontamination: broadcast hash set of normalised test n-grams.

Normalisation lower-cases A-Z and takes runs of digits, letters and non-ASCII
characters as words.  A benchmark item's windows are its runs of ``n``
consecutive words; an item with fewer words (but some) is one window.  Every
training text is scanned whole: each word position's window hash is looked up
in the broadcast set, each hit is verified word by word against the item's
window, and all words under a verified window are hit.

Scale: documents are scanned where they lie, with no shuffle and no join.
The windows are broadcast in parts of at most ``PART`` windows (a documented
bound on what one task holds); a larger benchmark adds scanning steps, not
memory, and every ``CUT`` steps the lineage is cut with ``checkpoint()`` so
that few parts are held at once.

Defined cases: a null or wordless text has no words and no hits; null or
wordless items give no window; a null item id is reported as the string
``null``; equal windows of several items report every item; repeated rows are
scanned as often as they appear; an empty benchmark hits nothing.  Extra
columns of any name pass through: the operator's own columns take fresh names
in the filters, and ``scan`` reads only the id and the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm import bytewords as bw

N_WORDS = 10
PART = 1_000_000
CUT = 4

_HIT = T.ArrayType(T.LongType())
_ITEMS = T.ArrayType(T.StringType())


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text",
                      n: int = N_WORDS) -> DataFrame:
    """One row per (item, distinct window): ``item string, length int, hash long, words binary``."""
    def rows(batches):
        for b in batches:
            out = []
            for lo, hi, data, off in bw.runs(b.column(1)):
                w = bw.Words(data, off, bw.ALNUM)
                h = w.hashes()
                whole = w.counts.clip(max=n)
                for k in range(hi - lo):
                    size, first = int(whole[k]), int(w.first[k])
                    if not size:
                        continue
                    at = np.arange(first, int(w.first[k + 1]) - size + 1)
                    item = b.column(0)[lo + k].as_py()
                    seen = set()
                    for i, x in zip(at.tolist(), bw.window_hash(h, at, at + size).astype(np.int64).tolist()):
                        words = joined(w, i, size)
                        if words not in seen:
                            seen.add(words)
                            out.append((item, size, x, words))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.binary()))],
                names=["item", "length", "hash", "words"])
    src = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                           F.col(text_col).alias("text"))
    return src.mapInArrow(rows, "item string, length int, hash long, words binary").distinct()


def joined(w: bw.Words, first: int, size: int) -> bytes:
    data, s, e = w.data, w.starts, w.ends
    return b" ".join(data[s[j]:e[j]].tobytes() for j in range(first, first + size))


def _parts(spark: SparkSession, windows: DataFrame) -> list:
    """Broadcast the window set in parts of about PART windows (at most, but for chance)."""
    n = windows.count()
    k = -(-n // PART)
    out = []
    for i in range(k):
        part = windows if k == 1 else windows.filter(F.pmod(F.xxhash64("words"), F.lit(k)) == i)
        table: dict[int, dict[int, dict[bytes, list[str]]]] = {}
        for r in part.toLocalIterator():
            table.setdefault(r.length, {}).setdefault(r.hash, {}).setdefault(bytes(r.words), []).append(r.item)
        out.append(spark.sparkContext.broadcast(table))
    return out


def _scan(column: pa.Array, table: dict, keys: dict, hits_before, items_before):
    """Hit words (runs as first, end pairs) and items of every text of a batch."""
    n_words, hits, items = [], [], []
    for lo, hi, data, off in bw.runs(column):
        w = bw.Words(data, off, bw.ALNUM)
        words = w.hashes()
        cover = np.zeros(len(words) + 1, np.int64)
        found: list[set] = [set() for _ in range(hi - lo)]
        for k in range(hi - lo):
            if hits_before is not None:
                found[k].update(items_before[lo + k] or ())
                h = np.array(hits_before[lo + k] or [], np.int64).reshape(-1, 2) + w.first[k]
                np.add.at(cover, h[:, 0], 1)
                np.add.at(cover, h[:, 1], -1)
        for size, known in keys.items():
            at, x = w.windows(size, words)
            j = np.searchsorted(known, x).clip(max=len(known) - 1)
            at, x = at[known[j] == x], x[known[j] == x]
            text = np.searchsorted(w.first, at, "right") - 1
            for i, key, k in zip(at.tolist(), x.astype(np.int64).tolist(), text.tolist()):
                if names := table[size][key].get(joined(w, i, size)):
                    found[k].update(names)
                    cover[i] += 1
                    cover[i + size] -= 1
        hit = np.cumsum(cover[:-1]) > 0
        for k in range(hi - lo):
            a, b = int(w.first[k]), int(w.first[k + 1])
            n_words.append(b - a)
            if found[k]:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].view(np.int8), [0]))))
                hits.append(edge.tolist())
                items.append(sorted(found[k]))
            else:
                hits.append([])
                items.append([])
    return [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int64())),
            pa.array(items, pa.list_(pa.string()))]


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
              item_text: str = "text", n: int = N_WORDS) -> tuple[DataFrame, str, str, str]:
    """All columns of ``docs`` and three more; returns (table, n_words, hits, items names).

    ``hits`` holds the hit words as flat (first, end) pairs of word numbers.
    """
    spark = docs.sparkSession
    parts = _parts(spark, benchmark_windows(benchmark, item_col, item_text, n)) or [spark.sparkContext.broadcast({})]
    names = [bw.fresh(docs, x) for x in ("n_words", "hit_words", "hit_items")]
    fields = [T.StructField(x, t) for x, t in zip(names, (T.LongType(), _HIT, _ITEMS))]
    df, base = docs, docs.columns
    for step, part in enumerate(parts):
        def make(part=part, first=step == 0):
            table = part.value
            keys = {size: np.sort(np.array(list(t), np.int64).astype(np.uint64)) for size, t in table.items()}

            def run(b: pa.RecordBatch):
                before = (None, None) if first else (b.column(len(base) + 1).to_pylist(), b.column(len(base) + 2).to_pylist())
                return _scan(b.column(at), table, keys, *before)
            return run
        at = base.index(text_col)
        schema = T.StructType(docs.schema.fields + fields)

        def scan(batches, make=make, width=len(base)):
            f = make()
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.columns[:width], *f(b)], names=schema.names)
        df = df.mapInArrow(scan, schema)
        if step % CUT == CUT - 1 and step + 1 < len(parts):
            df = df.checkpoint()
    return df, *names


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Per document: ``id, n_words, hit_words, hit_items, n_hit`` (runs of hit words, sorted item ids)."""
    df, n_words, hits, items = with_hits(docs.select(id_col, text_col), benchmark, text_col, **kw)
    return df.select(F.col(id_col), F.col(n_words).alias("n_words"), F.col(hits).alias("hit_words"),
                     F.col(items).alias("hit_items"), hit_count(hits).alias("n_hit"))


def hit_count(hits: str):
    """Number of hit words from the flat (first, end) pairs."""
    def total(odd: int):
        return F.aggregate(F.filter(hits, lambda _, i: i % 2 == odd), F.lit(0).cast("long"), lambda a, x: a + x)
    return total(1) - total(0)


def drop_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_hit: int = 1, **kw) -> DataFrame:
    """Documents with fewer than ``min_hit`` hit words, all columns as they are."""
    df, _, hits, _ = with_hits(docs, benchmark, text_col, **kw)
    return df.filter(hit_count(hits) < min_hit).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """All documents; the text from the first to the last byte of each run of hit words is cut out."""
    df, n_words, hits, _ = with_hits(docs, benchmark, text_col, **kw)
    names = docs.columns
    at, width = names.index(text_col), len(names)

    def cut(batches):
        for b in batches:
            texts, spans = b.column(at), b.column(width + 1).to_pylist()
            out = texts.to_pylist()
            for lo, hi, data, off in bw.runs(texts):
                if not any(spans[lo:hi]):
                    continue
                w = bw.Words(data, off, bw.ALNUM)
                for k in range(hi - lo):
                    if spans[lo + k]:
                        keep, last, first = [], int(off[k]), int(w.first[k])
                        for a, e in zip(spans[lo + k][::2], spans[lo + k][1::2]):
                            keep.append(data[last:w.starts[first + a]].tobytes())
                            last = int(w.ends[first + e - 1])
                        keep.append(data[last:off[k + 1]].tobytes())
                        out[lo + k] = b"".join(keep).decode()
            cols = list(b.columns[:width])
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return df.mapInArrow(cut, docs.schema)
