"""Repeated passages: suffix runs merged with known common prefixes.

Every byte covered by a string of ``LENGTH`` bytes (a window) that also starts
anywhere else is removed; texts are UTF-8 bytes, windows never cross texts and
are judged on the input.

1. Sampling.  Each window is assigned to the smallest hashed 16-gram (the
   leftmost of equals) among its first ``SPAN`` starts: its anchor, at the same
   offset wherever the window occurs.  Consecutive windows with one anchor form
   a stretch.  Windows that repeat share their anchor's following
   ``CORE`` = LENGTH - SPAN + 1 bytes.
2. Whole stretches.  Stretches equal from first to last byte repeat as a whole:
   an exchange of their hashes settles them.  It also leaves one of each
   distinct stretch, and of these only the ones whose core occurs in another
   distinct stretch can hold further repeats.  All others are done.
3. Suffix runs.  Those stretches are read from the text again.  Each task
   sorts the suffixes that begin at their anchors into runs, front-coded: a
   suffix stores the length of the prefix shared with its predecessor and the
   rest.  Runs are cut at sampled splitters and exchanged; each range is merged
   by a loser tree whose nodes carry the prefix length shared with the last
   output.  Different lengths decide a match without looking at a byte, equal
   ones compare only beyond the known prefix.  The merge gives each suffix
   the longest prefix it shares with a neighbour, hence with any other.
4. Only windows that end within that prefix can repeat.  They are exchanged by
   hash, which takes what precedes the anchor into account.
5. The removed windows' union is cut out of each text.

Scale: every exchange first collapses equal keys within a task (all their
members are settled there, one stands for them), so a passage that a third of
all texts share arrives once per task, not once per text.  Equal suffixes at a
splitter are spread over the ranges it separates.  Texts are shuffled once, into a bucketed
table of row numbers and texts in the checkpoint folder; later joins
with it move only positions.  Task memory is bounded by run and bucket sizes,
which follow the input, and by the longest single text.

Keys are 64-bit hashes.  Defined cases: null and empty texts have no bytes and
keep none; rows are told apart by row number, so null and repeated ids are
fine; texts shorter than a window stay whole; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import bytewords as bw
from tempora.session import checkpoint_dir

LENGTH = 400
SPAN = 192
CORE = LENGTH - SPAN + 1
GRAM = 16
FLUSH = 400_000
RUN_BYTES = 16 << 20
RANGE_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
SAMPLE = 4000

STRETCH = np.dtype([("k", "<u8"), ("h", "<u8"), ("rid", "<i8"), ("lo", "<i4"), ("span", "u1"), ("off", "u1"), ("multi", "u1")])
WINDOW = np.dtype([("k", "<u8"), ("rid", "<i8"), ("lo", "<i4"), ("multi", "u1")])
BLOBS = "bucket long, blob binary"


def _min_within(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if width > have else x


def stretches(data: np.ndarray, off: np.ndarray, rids: np.ndarray) -> np.ndarray:
    """The stretches of a run of texts as STRETCH records."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, STRETCH)
    c = bw.prefix_hash(data, bw.BYTE_BASE)
    at = np.arange(n - GRAM + 1)
    gram = bw.mix(bw.range_hash(c, at, at + GRAM, bw.BYTE_BASE))
    best = _min_within((gram >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64), SPAN)
    size = np.diff(off)
    edge = np.zeros(n + 1, np.int64)
    long = size >= LENGTH
    np.add.at(edge, off[:-1][long], 1)
    np.add.at(edge, (off[1:] - LENGTH + 1)[long], -1)
    start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    if not len(start):
        return np.zeros(0, STRETCH)
    anchor = (best[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))
    first = np.flatnonzero(new)
    lo, hi, a = start[first], start[np.concatenate((first[1:], [len(start)])) - 1], anchor[first]
    text = np.searchsorted(off, lo, "right") - 1
    out = np.zeros(len(lo), STRETCH)
    key = bw.range_hash(c, lo, hi + LENGTH, bw.BYTE_BASE) + ((hi - lo) * 256 + a - lo).astype(np.uint64) * np.uint64(bw.WORD_SALT)
    out["k"], out["h"] = bw.mix(key), bw.mix(bw.range_hash(c, a, a + CORE, bw.BYTE_BASE))
    out["rid"], out["lo"], out["span"], out["off"] = rids[text], lo - off[text], hi - lo, a - lo
    return out


def _ranks(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _collapse(rec: np.ndarray, field: str):
    """(repeated members not yet settled, one record per key with its ``multi`` mark), sorted by key."""
    rec = rec[np.argsort(rec[field], kind="stable")]
    key = rec[field]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [len(rec)])))
    many = (size > 1) | np.logical_or.reduceat(rec["multi"] > 0, first) if len(rec) else np.zeros(0, bool)
    settled = rec[np.repeat(many, size) & (rec["multi"] == 0)] if len(rec) else rec
    one = rec[first].copy()
    one["multi"] = many
    return settled, one


def _split(rec: np.ndarray, field: str, buckets: int, base: int = 0):
    """Records sorted by key as (bucket, bytes) rows."""
    cuts = np.searchsorted(_ranks(rec[field], buckets), np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield base + b, rec[cuts[b]:cuts[b + 1]].tobytes()


def _rows(rows: list) -> pa.RecordBatch:
    keys, blobs = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _joined(t: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t["blob"]]) if len(t) else np.zeros(0, kind)


class _Emitter:
    """Collects records and flushes them, collapsed, as rows for the exchange.

    Buckets below ``buckets`` are keys to compare; those from ``buckets`` on
    carry records that are already known to repeat.
    """

    def __init__(self, kind: np.dtype, buckets: int):
        self.kind, self.buckets, self.parts, self.n, self.turn = kind, buckets, [], 0, 0

    def add(self, rec: np.ndarray) -> list:
        self.parts.append(rec)
        self.n += len(rec)
        return self.flush() if self.n >= FLUSH else []

    def flush(self) -> list:
        if not self.n:
            return []
        settled, one = _collapse(np.concatenate(self.parts), "k")
        rows = list(_split(one, "k", self.buckets))
        if len(settled):
            self.turn = (self.turn * 31 + int(settled["rid"][0]) + 1) % self.buckets
            rows.append((self.buckets + self.turn, settled.tobytes()))
        self.parts, self.n = [], 0
        return rows


def _text_table(docs: DataFrame, id_col: str, text_col: str) -> tuple[str, int]:
    """Row numbers, ids and texts, written once, bucketed by row number."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"texts_{uuid.uuid4().hex}"
    (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
     .withColumn("rid", F.monotonically_increasing_id()).repartition(buckets, "rid")
     .write.bucketBy(buckets, "rid").sortBy("rid").option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name))
    return name, buckets


def _whole_stretches(texts: DataFrame, buckets: int) -> DataFrame:
    """Step 2: rows ``bucket, blob``: blobs of settled stretches (bucket >= buckets, < 2 * buckets)
    and of stretches whose core occurs in another (from 2 * buckets)."""
    def scan(batches):
        out = _Emitter(STRETCH, buckets)
        for b in batches:
            rids = b.column(0).to_numpy()
            for lo, hi, data, off in bw.runs(b.column(1)):
                if rows := out.add(stretches(data, off, rids[lo:hi])):
                    yield _rows(rows)
        if rows := out.flush():
            yield _rows(rows)

    def by_stretch(key, t):
        bucket = key[0].as_py()
        if bucket >= buckets:
            return pa.table({"bucket": t["bucket"], "blob": t["blob"]})
        settled, one = _collapse(_joined(t, STRETCH), "k")
        rows = [(buckets + bucket, settled.tobytes())] if len(settled) else []
        one["multi"] = 0
        further, one = _collapse(one, "h")
        if len(further):
            rows.append((2 * buckets + bucket, further.tobytes()))
        return pa.Table.from_batches([_rows(rows + list(_split(one, "h", buckets)))])

    def by_core(key, t):
        bucket = key[0].as_py()
        if bucket >= buckets:
            return pa.table({"bucket": t["bucket"], "blob": t["blob"]})
        further, _ = _collapse(_joined(t, STRETCH), "h")
        return pa.Table.from_batches([_rows([(2 * buckets + bucket, further.tobytes())] if len(further) else [])])
    return (texts.select("rid", "text").mapInArrow(scan, BLOBS).groupBy("bucket").applyInArrow(by_stretch, BLOBS)
            .groupBy("bucket").applyInArrow(by_core, BLOBS))


def _unpack(blobs: DataFrame, kind: np.dtype, intervals: bool) -> DataFrame:
    """Blobs as rows: removed intervals (``rid, start, end``) or stretches (``rid, lo, span, off``)."""
    def run(batches):
        for b in batches:
            for x in b.column(0):
                rec = np.sort(np.frombuffer(x.as_buffer(), kind), order=["rid", "lo"])
                if not intervals:
                    yield pa.RecordBatch.from_arrays([pa.array(rec["rid"]), pa.array(rec["lo"]), pa.array(rec["span"].astype(np.int32)),
                                                      pa.array(rec["off"].astype(np.int32))], names=["rid", "lo", "span", "off"])
                    continue
                start = rec["lo"].astype(np.int64)
                end = start + LENGTH + (rec["span"] if "span" in kind.names else 0)
                new = np.concatenate(([True], (rec["rid"][1:] != rec["rid"][:-1]) | (start[1:] > end[:-1])))
                first = np.flatnonzero(new)
                if len(first):
                    yield pa.RecordBatch.from_arrays([pa.array(rec["rid"][first]), pa.array(start[first]),
                                                      pa.array(np.maximum.reduceat(end, first))], names=["rid", "start", "end"])
    return blobs.select("blob").mapInArrow(run, "rid long, start long, end long" if intervals else "rid long, lo int, span int, off int")


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = np.frombuffer(a, np.uint8, n - known, known) != np.frombuffer(b, np.uint8, n - known, known)
    return known + int(x.argmax())


def _wanted(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """``rid, text, want``: the texts of the candidate stretches, with these as a list."""
    want = candidates.groupBy("rid").agg(F.collect_list(F.struct("lo", "span", "off")).alias("want"))
    return texts.select("rid", "text").join(want, "rid")


def _payloads(b: pa.RecordBatch):
    """(suffix from the anchor, what precedes it, rid, lo) of every wanted stretch."""
    for rid, text, want in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
        data = text.as_py().encode()
        for w in want:
            lo, a = w["lo"], w["lo"] + w["off"]
            yield data[a:lo + w["span"] + LENGTH], data[lo:a], rid, lo


def front_code(entries: list) -> bytes:
    """A sorted run as bytes: counts, shared lengths, rests, and what belongs to each suffix."""
    shared, prev = [], b""
    for e in entries:
        shared.append(shared_prefix(prev, e[0]))
        prev = e[0]
    head = np.array([len(entries)], "<i4").tobytes()
    cols = [np.array(shared, "<u2"), np.array([len(e[0]) - s for e, s in zip(entries, shared)], "<u2"),
            np.array([len(e[1]) for e in entries], "<u2"), np.array([e[2] for e in entries], "<i8"), np.array([e[3] for e in entries], "<i4")]
    return b"".join([head, *(c.tobytes() for c in cols), *(e[0][s:] for e, s in zip(entries, shared)), *(e[1] for e in entries)])


def read_run(blob: bytes):
    """Iterate a front-coded run: (suffix, prefix shared with the one before, left, rid, lo)."""
    n, at = int(np.frombuffer(blob, "<i4", 1)[0]), 4
    cols = []
    for kind in ("<u2", "<u2", "<u2", "<i8", "<i4"):
        a = np.frombuffer(blob, kind, n, at)
        cols.append(a.tolist())
        at += a.nbytes
    left_at, prev = at + sum(cols[1]), b""
    for shared, rest, left, rid, lo in zip(*cols):
        prev = prev[:shared] + blob[at:at + rest]
        at += rest
        yield prev, shared, blob[left_at:left_at + left], rid, lo
        left_at += left


def merge_runs(runs: list):
    """Merge sorted runs by a loser tree; yields (entry, prefix shared with the output before).

    ``shared[i]`` is what stream i's head shares with the last output; at a
    node, the head that shares more is smaller and the loser shares with the
    winner what it shared with the output; only equal lengths compare bytes,
    beyond them.  A new head's length comes from its run's front code.
    """
    k = 1
    while k < len(runs):
        k *= 2
    streams = [iter(r) for r in runs] + [iter(())] * (k - len(runs))
    head, shared = [None] * k, [0] * k

    def advance(i):
        e = next(streams[i], None)
        head[i] = e
        shared[i] = -1 if e is None else e[1]

    def beats(i, j) -> bool:
        """Whether stream i's head goes first; sets the loser's shared length."""
        if head[j] is None:
            return True
        if head[i] is None:
            return False
        if shared[i] != shared[j]:
            return shared[i] > shared[j]
        a, b = head[i][0], head[j][0]
        n = shared_prefix(a, b, shared[i])
        first = a[n:n + 1] < b[n:n + 1] or (n == len(a) and n == len(b) and i < j)
        shared[j if first else i] = n
        return first
    for i in range(k):
        advance(i)
    loser = [0] * k

    def build(node):
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        if beats(a, b):
            loser[node] = b
            return a
        loser[node] = a
        return b
    winner = build(1) if k > 1 else 0
    while head[winner] is not None:
        yield head[winner], shared[winner]
        advance(winner)
        node = (winner + k) // 2
        while node:
            if beats(loser[node], winner):
                loser[node], winner = winner, loser[node]
            node //= 2


def _window_keys(entry, reach: int) -> np.ndarray:
    """WINDOW records of the entry's windows that end within ``reach`` bytes of its suffix."""
    suffix, _, left, rid, lo = entry
    last = min(len(suffix) - LENGTH, reach - LENGTH)     # latest start, relative to the anchor
    n = len(left) + last + 1
    if n <= 0:
        return np.zeros(0, WINDOW)
    c = bw.prefix_hash(np.frombuffer(left + suffix, np.uint8), bw.BYTE_BASE)
    at = np.arange(n)
    out = np.zeros(n, WINDOW)
    out["k"] = bw.mix(bw.range_hash(c, at, at + LENGTH, bw.BYTE_BASE))
    out["rid"], out["lo"] = rid, lo + at
    return out


def _merged_windows(wanted: DataFrame, n: int, buckets: int) -> DataFrame:
    """Steps 3 and 4: blobs of repeated windows."""
    ranges = max(1, -(-n * (LENGTH + SPAN) // RANGE_BYTES))
    share = min(1.0, SAMPLE / max(1, n))

    def sample(batches):
        for b in batches:
            got = [e[0] for e in _payloads(b) if int(bw.mix(np.array([bw.salt(e[2] * 1_000_003 + e[3], 1)]))[0]) < share * 2.0 ** 64]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], names=["suffix"])
    splitters: list[bytes] = []
    if ranges > 1:
        # about SAMPLE suffixes of at most LENGTH + SPAN bytes
        found = sorted(bytes(r.suffix) for r in wanted.mapInArrow(sample, "suffix binary").collect())
        splitters = [found[i * len(found) // ranges] for i in range(1, ranges)] if found else []

    def sort(batches):
        pending, size = [], 0

        def runs():
            pending.sort()
            parts: dict[int, list] = {}
            for e in pending:
                a, b = bisect_left(splitters, e[0]), bisect_right(splitters, e[0])
                parts.setdefault(a + (e[2] * 31 + e[3]) % (b - a + 1), []).append(e)
            return _rows([(p, front_code(x)) for p, x in parts.items()])
        for b in batches:
            for e in _payloads(b):
                pending.append(e)
                size += len(e[0]) + len(e[1])
                if size >= RUN_BYTES:
                    yield runs()
                    pending, size = [], 0
        if pending:
            yield runs()

    def merge(t: pa.Table) -> pa.Table:
        out, rows, before, reach = _Emitter(WINDOW, buckets), [], None, 0
        for e, shared in merge_runs([read_run(x.as_py()) for x in t["blob"]]):
            if before is not None:
                rows += out.add(_window_keys(before, max(reach, shared)))
                reach = shared
            else:
                reach = len(e[0])        # the neighbour across the range's edge is not seen
            before = e
        if before is not None:
            rows += out.add(_window_keys(before, len(before[0])))
        return pa.Table.from_batches([_rows(rows + out.flush())])

    def compare(key, t):
        bucket = key[0].as_py()
        if bucket >= buckets:
            return pa.table({"bucket": t["bucket"], "blob": t["blob"]})
        settled, _ = _collapse(_joined(t, WINDOW), "k")
        return pa.Table.from_batches([_rows([(buckets + bucket, settled.tobytes())] if len(settled) else [])])
    return (wanted.mapInArrow(sort, BLOBS).groupBy("bucket").applyInArrow(merge, BLOBS)
            .groupBy("bucket").applyInArrow(compare, BLOBS))


def repeated_intervals(texts: DataFrame) -> DataFrame:
    """``rid, start, end``: byte intervals whose union is what repeats."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total * STRETCH.itemsize // (SPAN // 2) // BUCKET_BYTES))
    found = _whole_stretches(texts, buckets).checkpoint()
    whole = _unpack(found.where(F.col("bucket") < 2 * buckets), STRETCH, True)
    candidates = _unpack(found.where(F.col("bucket") >= 2 * buckets), STRETCH, False).checkpoint()
    n = candidates.count()
    if not n:
        return whole
    buckets = max(1, -(-n * SPAN // 2 * WINDOW.itemsize // BUCKET_BYTES))
    windows = _merged_windows(_wanted(texts, candidates), n, buckets).checkpoint()
    return whole.unionByName(_unpack(windows, WINDOW, True))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id, n_bytes, removed`` (flat start, end pairs of maximal runs), ``kept`` (the bytes left)."""
    spark = docs.sparkSession
    name, _ = _text_table(docs, id_col, text_col)
    texts = spark.table(name)
    cuts = repeated_intervals(texts).groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    kind = dict(texts.dtypes)["id"]

    def cut(batches):
        for b in batches:
            size, removed, kept = [], [], []
            for text, cuts in zip(b.column(1), b.column(2).to_pylist()):
                data = (text.as_py() or "").encode()
                runs: list[int] = []
                for s, e in sorted((c["start"], c["end"]) for c in cuts or ()):
                    if runs and s <= runs[-1]:
                        runs[-1] = max(runs[-1], e)
                    else:
                        runs += [s, e]
                size.append(len(data))
                removed.append(runs)
                edges = [0, *runs, len(data)]
                kept.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2])) if runs else data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.list_(pa.int64())),
                                              pa.array(kept, pa.binary())], names=["id", "n_bytes", "removed", "kept"])
    out = texts.join(cuts, "rid", "left").select("id", "text", "cuts").mapInArrow(
        cut, f"id {kind}, n_bytes long, removed array<long>, kept binary")
    return out.withColumnRenamed("id", id_col)
