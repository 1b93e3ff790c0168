"""Approximate nearest neighbours: NN-descent graph and greedy graph search.

Nearness is the largest inner product.  For the graph each vector is divided by
the largest norm and given one more coordinate that brings it to length 1, so
inner products with a query keep their order and "near" is symmetric.  The
graph ranks by the squared distances of these, computed in double precision
from the original vectors and without cancellation, so close copies and much
longer vectors do not blur them.  Equal vectors are one node; a node keeps its ``TOP`` + 1 smallest ids, all that any
answer can name.

Buckets.  Nodes live in buckets of about ``BUCKET`` nodes: cells of random hyperplanes, a
fuller cell cut into blocks by a hash.  A node's number names its bucket and its
place there, so ids alone travel and every step is one exchange by bucket; a
bucket is one row of arrays, handled by NumPy.

Build.  Cells of other hyperplanes (``TREES`` times) give first neighbours.  An NN-descent round
is three exchanges: nodes tell a sample of their neighbours that they chose them; each node sends
its vector, once per bucket, to the buckets of the nodes that it chose or that chose it; there
the neighbours of each node, forward and reverse, are compared with
each other, and nearer ones than a node's worst neighbour are proposed to it.
Rounds end when fewer than ``DONE`` of all entries change; lists only improve, so they end.

Search.  A query starts at its own node and repeatedly
expands the ``EXPAND`` nearest nodes of its pool of ``POOL`` that have not been
expanded, until none is left: three exchanges a round (to the expanded nodes' buckets, to
their neighbours' buckets, back with scores).  The pool, like the answer, is ranked by
double-precision products of the original vectors, added up in the order of the dimensions; the
answer's ties go to the smaller id.  Vectors travel in single precision where that is exact, else in
double.

Scale: a node's vector goes to a bucket once a round, however many of its nodes ask; cells
of like nodes keep that to few buckets.  The reverse
neighbours that take part in a round are a sample of ``JOINED``, as the
method has it, and each sending bucket names at most that many for a node, so a hub costs little more than another node; the graph and the
search index every vector.  Nothing but counts and one norm reaches the driver.

Defined cases: vectors that are null, empty, zero, of another length than most or
with null or non-finite components take no part, nor do null ids; a repeated
id with equal vectors is one candidate, with different vectors it is a candidate
with each; fewer candidates than ``k`` are all returned; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import gc
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 20
NEIGHBOURS = 32
REVERSE = 24
JOINED = 20
TREES = 4
CELL = 256
BLOCK = 512
BUCKET = 4096
PLACES = 22             # bits of a node's place in its bucket
DONE = 0.02
POOL = 128
EXPAND = 48
SEED = 11
ROWS = "bucket long, kind int, blob binary, n long"
STATE, MESSAGE = 0, 1


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vec`` (doubles) of the rows that take part."""
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
            .where(F.col("id").isNotNull() & F.col("vec").isNotNull()))
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
                      & F.exists("vec", lambda x: x != 0))
    size = (rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)).first()
    return rows.where(F.size("vec") == (size.n if size else 0))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@dataclass
class Space:
    """How points are stored (a numpy type that holds them exactly) and their largest norm."""
    kind: str
    norm: float

    def points(self, column) -> np.ndarray:
        return np.frombuffer(b"".join(x.as_buffer() for x in column), self.kind).reshape(len(column), -1).astype(np.float64)

    def nearness(self, x: np.ndarray) -> np.ndarray:
        """Minus the squared distances of all pairs with the additional coordinate; -inf to itself."""
        x = x / self.norm
        square = (x * x).sum(1)
        high = np.sqrt(np.clip(1 - square, 0, None))
        lift = (square[:, None] - square) / np.maximum(high[:, None] + high, 1e-300)
        x = x - x.mean(0)
        square = (x * x).sum(1)
        s = -(np.clip(square[:, None] + square - 2 * (x @ x.T), 0, None) + lift * lift)
        np.fill_diagonal(s, -np.inf)
        return s.astype(np.float32)


def _cells(x: np.ndarray, tree: int, bits: int) -> np.ndarray:
    """Cell of each vector among random hyperplanes through the origin."""
    planes = np.random.default_rng(SEED + tree).standard_normal((x.shape[1], bits))
    return ((x @ planes) > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), np.int64)


def _bits(n: int, cell: int) -> int:
    return min(20, max(0, int(np.ceil(np.log2(max(1, n) / cell)))))


def nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame, Space]:
    """(``node, vec, point``; ``node, id`` of the smallest ids; the points' space)."""
    found = rows.groupBy("vec").agg(F.min("id").alias("least"))
    single = F.forall("vec", lambda x: x == x.cast("float").cast("double"))
    seen = found.agg(F.max(dot("vec", "vec")).alias("top"), F.bool_and(single).alias("single"), F.count(F.lit(1)).alias("n")).first()
    space = Space("f4" if seen.single else "f8", float(np.sqrt(seen.top)) if seen.top else 1.0)
    bits = _bits(seen.n, BUCKET // 2)

    def pack(batches):
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in x.astype(space.kind)], pa.binary()),
                                              pa.array(_cells(x, TREES, bits) if len(x) else [], pa.int64())], names=["vec", "point", "cell"])
    dealt = found.select("vec").mapInArrow(pack, "vec array<double>, point binary, cell long")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("blocks"))
    dealt = dealt.join(sizes, "cell").withColumn("bucket", F.shiftleft("cell", 20) + F.pmod(F.xxhash64("vec"), F.col("blocks")))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("point")) - 1
    table = dealt.select((F.shiftleft("bucket", PLACES) + place).alias("node"), "vec", "point").checkpoint()
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    ids = rows.distinct().withColumn("rank", rank).where(F.col("rank") <= TOP + 1).join(table.select("vec", "node"), "vec").select("node", "id")
    return table, ids, space


# --- rows of buckets --------------------------------------------------------

def _bucket(nodes_: np.ndarray) -> np.ndarray:
    return nodes_ >> PLACES


def _place(nodes_: np.ndarray) -> np.ndarray:
    return nodes_ & ((1 << PLACES) - 1)


def _table(rows: list) -> pa.Table:
    """``bucket, kind, blob, n`` rows from (bucket, kind, arrays, n)."""
    b, k, x, n = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"bucket": pa.array(b, pa.int64()), "kind": pa.array(k, pa.int32()),
                     "blob": pa.array([pickle.dumps(v, 5) for v in x], pa.binary()), "n": pa.array(n, pa.int64())})


def _read(t: pa.Table):
    """(the bucket, its state or None, its messages)."""
    state, messages = None, []
    for kind, blob in zip(t["kind"].to_pylist(), t["blob"]):
        got = pickle.loads(blob.as_buffer())
        if kind == STATE:
            state = got
        else:
            messages.append(got)
    return t["bucket"][0].as_py(), state, messages


def _join(messages: list) -> list[np.ndarray]:
    """The messages' arrays, one after another."""
    return [np.concatenate(x) for x in zip(*messages)]


def _dealt(target: np.ndarray, *columns) -> list:
    """Messages of the entries of each target bucket."""
    order = np.argsort(target, kind="stable")
    target = target[order]
    first = np.flatnonzero(np.diff(target, prepend=-1))
    return [(int(target[a]), MESSAGE, tuple(c[order[a:b]] for c in columns), 0) for a, b in zip(first, [*first[1:], len(target)])]


def _first_few(key: np.ndarray, turn: int, k: int) -> np.ndarray:
    """Positions of at most k entries of each key, another draw for each turn."""
    draw = np.random.default_rng(turn).random(len(key))
    order = np.lexsort((draw, key))
    head = np.flatnonzero(np.diff(key[order], prepend=-1))
    rank = np.arange(len(key)) - np.repeat(head, np.diff(head, append=len(key)))
    return order[rank < k]


def _merged(ids: np.ndarray, sims: np.ndarray, at: np.ndarray, near: np.ndarray, s: np.ndarray, k: int):
    """Lists (rows of ids and sims, -1 and -inf where empty) with entries (row, id, sim) merged in: the k nearest distinct."""
    have = ids >= 0
    row = np.concatenate((np.repeat(np.arange(len(ids)), have.sum(1)), at))
    node, sim = np.concatenate((ids[have], near)), np.concatenate((sims[have], s))
    order = np.lexsort((-sim, node, row))
    row, node, sim = row[order], node[order], sim[order]
    one = np.concatenate((np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (node[1:] != node[:-1])))
    row, node, sim = row[one], node[one], sim[one]
    order = np.lexsort((node, -sim, row))
    row, node, sim = row[order], node[order], sim[order]
    head = np.flatnonzero(np.diff(row, prepend=-1))
    rank = np.arange(len(row)) - np.repeat(head, np.diff(head, append=len(row)))
    keep = rank < k
    out_ids, out_sims = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), -np.inf, sims.dtype)
    out_ids[row[keep], rank[keep]], out_sims[row[keep], rank[keep]] = node[keep], sim[keep]
    return out_ids, out_sims


def _grouped(rows: DataFrame, step) -> DataFrame:
    return rows.groupBy("bucket").applyInArrow(step, ROWS)


# --- graph ------------------------------------------------------------------

def first_neighbours(table: DataFrame, space: Space, n: int) -> DataFrame:
    """Proposals from random hyperplane cells, as messages to the nodes' buckets."""
    bits = _bits(n, CELL)

    def cells(batches):
        for b in batches:
            x = space.points(b.column(1))
            for t in range(TREES if len(x) else 0):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(_cells(x, t, bits).astype(np.int64)),
                                                  b.column(0), b.column(1)], names=["tree", "cell", "node", "point"])
    dealt = table.select("node", "point").mapInArrow(cells, "tree int, cell long, node long, point binary")
    sizes = dealt.groupBy("tree", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = dealt.join(sizes, ["tree", "cell"]).withColumn("block", F.pmod(F.xxhash64("node", "tree"), "blocks"))

    def near(t: pa.Table) -> pa.Table:
        s, ids = space.nearness(space.points(t["point"])), t["node"].to_numpy()
        k = min(NEIGHBOURS, len(ids) - 1)
        if k < 1:
            return _table([])
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        row = np.repeat(np.arange(len(ids)), k)
        return _table(_dealt(_bucket(ids[row]), ids[row], ids[at.ravel()], s[row, at.ravel()]))
    return dealt.groupBy("tree", "cell", "block").applyInArrow(near, ROWS)


def _homes(table: DataFrame, space: Space) -> DataFrame:
    """The state row of every bucket: points and empty lists."""
    def home(t: pa.Table) -> pa.Table:
        order = np.argsort(t["node"].to_numpy())
        x = space.points(t["point"])[order].astype(space.kind)
        state = (x, np.full((len(x), NEIGHBOURS), -1, np.int64), np.full((len(x), NEIGHBOURS), -np.inf, np.float32))
        return _table([(int(_bucket(t["node"].to_numpy()[:1])[0]), STATE, state, 0)])
    return table.select(F.shiftright("node", PLACES).alias("bucket"), "node", "point").groupBy("bucket").applyInArrow(home, ROWS)


def _improve(t: pa.Table) -> pa.Table:
    """Merge proposals; ``n`` counts the new entries."""
    bucket, (x, ids, sims), messages = _read(t)
    fresh = 0
    if messages:
        at, near, s = _join(messages)
        new, sims = _merged(ids, sims, _place(at), near, s, NEIGHBOURS)
        fresh = sum(len(set(a.tolist()) - set(b.tolist()) - {-1}) for a, b in zip(new, ids))
        ids = new
    return _table([(bucket, STATE, (x, ids, sims), fresh)])


def _choose(turn: int):
    """Tell a sample of each node's neighbours that it chose them."""
    def step(t: pa.Table) -> pa.Table:
        bucket, (x, ids, sims), _ = _read(t)
        v, column = np.nonzero(ids >= 0)
        mine = _first_few(v, turn, JOINED)
        v, u = (bucket << PLACES) + v[mine], ids[v[mine], column[mine]]
        some = _first_few(u, turn + 1, JOINED)
        return _table([(bucket, STATE, (x, ids, sims, v, u), 0), *_dealt(_bucket(u[some]), v[some], u[some])])
    return step


def _send(turn: int):
    """Send vectors to the buckets of the nodes chosen and choosing."""
    def step(t: pa.Table) -> pa.Table:
        bucket, (x, ids, sims, v, u), messages = _read(t)
        by, chosen = _join(messages) if messages else (np.zeros(0, np.int64),) * 2
        some = _first_few(chosen, turn + 2, JOINED)
        members = np.concatenate((v, chosen[some])), np.concatenate((u, by[some]))      # (node of this bucket, member of its round)
        pairs = np.unique(np.stack((np.concatenate((_bucket(u), _bucket(by))), np.concatenate((v, chosen))), 1), axis=0)
        pairs = pairs[pairs[:, 0] != bucket]
        at = _place(pairs[:, 1])
        return _table([(bucket, STATE, (x, ids, sims, *members), 0), *_dealt(pairs[:, 0], pairs[:, 1], x[at], sims[at, -1])])
    return step


def _compare(space: Space):
    """Compare the members of each node's round with each other and propose what is nearer."""
    def step(t: pa.Table) -> pa.Table:
        bucket, (x, ids, sims, v, u), messages = _read(t)
        own = (bucket << PLACES) + np.arange(len(x))
        parts = [(own, x, sims[:, -1]), *messages]
        known, points, worst = _join(parts)
        order = np.argsort(known, kind="stable")
        known, points, worst = known[order], points[order], worst[order]
        at = np.minimum(np.searchsorted(known, u), len(known) - 1)
        here = known[at] == u               # a member whose vector did not come sits this round out
        v, at = v[here], at[here]
        order = np.lexsort((at, v))
        v, at = v[order], at[order]
        out = []
        for a, b in _runs(v):
            m = np.unique(at[a:b])
            if len(m) < 2:
                continue
            s = space.nearness(points[m].astype(np.float64))
            i, j = np.nonzero(s > worst[m][:, None])
            out.append((known[m[i]], known[m[j]], s[i, j]))
        rows = [(bucket, STATE, (x, ids, sims), 0)]
        if out:
            one, other, s = _join(out)
            # of many proposals to a node the nearest distinct ones are enough
            names, at = np.unique(one, return_inverse=True)
            best, near = _merged(np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0), np.float32), at, other, s, NEIGHBOURS)
            row, column = np.nonzero(best >= 0)
            rows += _dealt(_bucket(names[row]), names[row], best[row, column], near[row, column])
        return _table(rows)
    return step


def _runs(v: np.ndarray):
    first = np.flatnonzero(np.diff(v, prepend=-1)).tolist()
    return zip(first, [*first[1:], len(v)])


def _release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of rounds whose result is checkpointed."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def build(table: DataFrame, space: Space) -> DataFrame:
    """The neighbour graph: one state row (points, ids, sims) a bucket."""
    n = table.count()
    graph = _grouped(_homes(table, space).unionByName(first_neighbours(table, space, n)), _improve).checkpoint()
    entries, turn = n * min(NEIGHBOURS, max(0, n - 1)), 0
    while n > 2:
        turn += 3
        met = _grouped(_grouped(_grouped(graph, _choose(turn)), _send(turn)), _compare(space))
        graph = _grouped(met, _improve).checkpoint()
        moved = graph.agg(F.sum("n")).first()[0] or 0
        _release(graph)
        if moved <= DONE * entries:
            break
    return graph


# --- search -----------------------------------------------------------------

def _links(graph: DataFrame) -> DataFrame:
    """State rows (points, offsets, neighbours) with forward and some reverse neighbours."""
    def tell(t: pa.Table) -> pa.Table:
        bucket, (x, ids, sims), _ = _read(t)
        v, column = np.nonzero(ids >= 0)
        u, v = ids[v, column], (bucket << PLACES) + v
        some = _first_few(u, 7, REVERSE)
        return _table([(bucket, STATE, (x, v, u), 0), *_dealt(_bucket(u[some]), u[some], v[some])])

    def hear(t: pa.Table) -> pa.Table:
        bucket, (x, v, u), messages = _read(t)
        if messages:
            to, by = _join(messages)
            some = _first_few(to, 8, REVERSE)
            v, u = np.concatenate((v, to[some])), np.concatenate((u, by[some]))
        pairs = np.unique(np.stack((_place(v), u), 1), axis=0)
        return _table([(bucket, STATE, (x, np.searchsorted(pairs[:, 0], np.arange(len(x) + 1)), pairs[:, 1]), 0)])
    return _grouped(_grouped(graph, tell), hear).checkpoint()


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, added up in the order of the dimensions."""
    out = np.zeros(len(x))
    for lo in range(0, len(x), 8192):
        out[lo:lo + 8192] = np.add.accumulate(x[lo:lo + 8192].astype(np.float64) * y[lo:lo + 8192].astype(np.float64), axis=1)[:, -1]
    return out


def _begin(t: pa.Table) -> pa.Table:
    """Search states of a bucket's queries: each starts at its own node."""
    bucket, (x, _, _), messages = _read(t)
    if not messages:
        return _table([])
    q, = _join(messages)
    q = np.unique(q)
    x = x[_place(q)]
    ids, sims, closed = np.full((len(q), POOL), -1, np.int64), np.full((len(q), POOL), -np.inf), np.zeros((len(q), POOL), bool)
    ids[:, 0], sims[:, 0] = q, products(x, x)
    return _table([(bucket, STATE, (q, x, ids, sims, closed), 0)])


def _expand(t: pa.Table) -> pa.Table:
    """Merge scores into the pools and ask the buckets of the nearest nodes not yet expanded."""
    bucket, state, messages = _read(t)
    if state is None:
        return _table([])
    q, x, ids, sims, closed = state
    if messages:
        name, near, s = _join(messages)
        done = ids[closed]
        owner = np.repeat(np.arange(len(q)), closed.sum(1))
        ids, sims = _merged(ids, sims, np.searchsorted(q, name), near, s, POOL)
        # what was expanded stays so where it is still in the pool
        closed = _marked(ids, owner, done)
    row, column = np.nonzero((ids >= 0) & ~closed)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    rank = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))
    row, column = row[rank < EXPAND], column[rank < EXPAND]
    closed = closed.copy()
    closed[row, column] = True
    rows = [(bucket, STATE, (q, x, ids, sims, closed), len(row))]
    return _table(rows + _with_vectors(_bucket(ids[row, column]), q[row], ids[row, column], q, x))


def _marked(ids: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Where the lists hold one of the (row, node) pairs."""
    out = np.zeros(ids.shape, bool)
    first = np.searchsorted(row, np.arange(len(ids) + 1))
    for i in range(len(ids)):
        out[i] = np.isin(ids[i], node[first[i]:first[i + 1]])
    return out


def _with_vectors(target: np.ndarray, q: np.ndarray, u: np.ndarray, names: np.ndarray, x: np.ndarray) -> list:
    """Messages of (query, node) pairs to target buckets, with each query's vector once a bucket; names are sorted."""
    out = []
    for b, kind, (mine, node), n in _dealt(target, q, u):
        some = np.unique(mine)
        out.append((b, kind, (mine, node, some, x[np.searchsorted(names, some)]), n))
    return out


def _queries(messages: list):
    """(query, node) pairs, and the sorted queries with their vectors."""
    q, u = np.concatenate([m[0] for m in messages]), np.concatenate([m[1] for m in messages])
    names, first = np.unique(np.concatenate([m[2] for m in messages]), return_index=True)
    return q, u, names, np.concatenate([m[3] for m in messages])[first]


def _neighbours(t: pa.Table) -> pa.Table:
    """Ask the buckets of the expanded nodes' neighbours for scores."""
    bucket, state, messages = _read(t)
    if not messages:
        return _table([])
    _, first, near = state
    q, v, names, x = _queries(messages)
    at = _place(v)
    size = first[at + 1] - first[at]
    where = np.arange(int(size.sum())) + np.repeat(first[at] - np.cumsum(size) + size, size)
    pairs = np.unique(np.stack((np.repeat(q, size), near[where]), 1), axis=0)
    return _table(_with_vectors(_bucket(pairs[:, 1]), pairs[:, 0], pairs[:, 1], names, x))


def _score(t: pa.Table) -> pa.Table:
    """Scores of the asked (query, node) pairs, back to the queries' buckets."""
    bucket, state, messages = _read(t)
    if not messages:
        return _table([])
    q, u, names, x = _queries(messages)
    pairs = np.unique(np.stack((q, u), 1), axis=0)
    at = np.searchsorted(names, pairs[:, 0])
    s = products(x[at], state[0][_place(pairs[:, 1])])
    best, sims = _merged(np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0)), at, pairs[:, 1], s, POOL)
    row, column = np.nonzero(best >= 0)
    return _table(_dealt(_bucket(names[row]), names[row], best[row, column], sims[row, column]))


def search(graph: DataFrame, queries: DataFrame) -> DataFrame:
    """Greedy search from the own nodes of ``queries`` (column ``node``): ``node, near, score`` of the pools."""
    links = _links(graph)

    def starts(t: pa.Table) -> pa.Table:
        return _table([(t["bucket"][0].as_py(), MESSAGE, (t["node"].to_numpy(),), 0)])
    asked = queries.select(F.shiftright("node", PLACES).alias("bucket"), "node").groupBy("bucket").applyInArrow(starts, ROWS)
    state = _grouped(_grouped(graph.unionByName(asked), _begin), _expand).checkpoint()
    while state.where("n > 0").count():
        own, messages = state.where(F.col("kind") == STATE), state.where(F.col("kind") == MESSAGE)
        found = _grouped(links.unionByName(_grouped(links.unionByName(messages), _neighbours)), _score)
        state = _grouped(own.unionByName(found), _expand).checkpoint()
        _release(state)

    def pools(batches):
        for b in batches:
            for blob in b.column(0):
                q, _, ids, sims, _ = pickle.loads(blob.as_buffer())
                row, column = np.nonzero(ids >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(ids[row, column]), pa.array(sims[row, column])],
                                                 names=["node", "near", "score"])
    return state.where(F.col("kind") == STATE).select("blob").mapInArrow(pools, "node long, near long, score double")


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP) -> DataFrame:
    """``query_id, rank, id, score`` of each query row's k nearest other rows (k at most ``TOP``)."""
    rows = usable(vectors, id_col, vec_col).checkpoint()
    table, ids, space = nodes(rows)
    ids = ids.checkpoint()
    queries = (rows.where(is_query(F.col("id"))).select(F.col("id").alias("query_id"), "vec").distinct()
               .join(table.select("node", "vec"), "vec").select("query_id", "node").checkpoint())
    found = search(build(table, space), queries)
    rank = F.rank().over(Window.partitionBy("node").orderBy(F.desc("score")))
    best = found.withColumn("r", rank).where(F.col("r") <= k + 1).drop("r")
    named = (best.join(ids.select(F.col("node").alias("near"), F.col("id")), "near").join(queries, "node")
             .where("id <> query_id"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return (named.select("query_id", "id", "score").distinct().withColumn("rank", order).where(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score"))
