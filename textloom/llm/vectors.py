"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Vectors of one label and dimension are dealt by hash to shards of at most about CAPACITY; each shard gets a graph of its own. A vector that lies so close to
a node that any two such vectors link for certain (half the limit's angle) is a member of the node's ball and no node: crowds of near copies are a few nodes, and
the graph stays one piece. Every shard is queried with its own nodes and with those of each later shard, so every pair of vectors meets once. A
query descends the layers and walks the ground layer with a beam; a beam that holds nothing but nodes in reach has not seen the end, and doubles. Nodes in reach
of each other (by the limit's angle and the radii of both balls) are verified in double precision: balls that link as a whole by the triangle inequality are
counted by their weights, all others member by member, in blocks.

Audits: when a graph is built, probes at the limit's angle from a sample of its nodes must be found by the walk, so that recall is measured where the data have no
links too; the beam doubles until it is AUDIT. When shards meet, a sample of each block's queries is compared with all nodes and the
beam doubles again until recall is AUDIT, on the sampled queries alone; then all queries are searched once. A beam as wide as the graph is an exact comparison in blocks.
`audits()` gives the figures.

Exact copies are one vector with a weight. Of each block of queries, sums of links a vector and a spanning forest of the balls are kept, never the links.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label, link with nothing; so do vectors of different dimension. Repeated rows
are vectors of their own, and link as copies do. A null vec_id never names a component. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, components, cut, salt_of, table, with_key_min

COSINE = 0.93
#: Vectors of a shard; neighbours in the ground layer and above; beam when building; first beam when searching; expanded at once.
CAPACITY, GROUND, UPPER, BUILD, BEAM, AT_ONCE = 16384, 24, 12, 40, 16, 4
#: Nodes that are added to a graph at once, queries that are searched at once, and blocks of a shard's nodes that are queried by tasks of their own.
BATCH, CHUNK, SPLIT = 128, 256, 4
#: Recall that audits ask for, and the nodes or queries of one audit.
AUDIT, AUDITED = 0.995, 128
#: A ball's radius as a share of half the limit's angle: below 1, so that rounding never makes two members miss the limit.
TIGHT = 0.98
#: Rounding of an angle; rounding of a cosine in single precision.
ROUNDING, SINGLE = 1e-7, 1e-5
#: Cosines that are held at once when members are compared.
CELLS = 1 << 22


class Graph:
    """vectors: unit rows, float32. layers[l]: neighbours of each node in layer l, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, layers: list[np.ndarray], entry: int, beam: int = BEAM):
        self.vectors, self.levels, self.layers, self.entry, self.beam = vectors, levels, layers, entry, beam

    def beams(self, queries: np.ndarray, starts: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes (q, beam) that a walk over a layer finds from starts (q, s), and their cosines; -1 where there is none."""
        x, nbr, q = self.vectors, self.layers[layer], len(queries)
        seen = np.zeros((q, len(x) + 1), dtype=bool)  # the last column is for -1
        seen[:, -1] = True
        rows = np.arange(q)[:, None]
        width = max(beam, starts.shape[1])
        ids = np.full((q, width), -1, dtype=np.int32)
        ids[:, : starts.shape[1]] = starts
        seen[rows, starts] = True
        sims = np.full((q, width), -np.inf, dtype=np.float32)
        sims[:, : starts.shape[1]] = np.where(starts >= 0, np.einsum("qsd,qd->qs", x[starts], queries), -np.inf)
        todo = sims > -np.inf
        while True:
            open_sims = np.where(todo, sims, -np.inf)
            at = np.argpartition(-open_sims, min(AT_ONCE, width) - 1, axis=1)[:, :AT_ONCE]
            good = np.take_along_axis(open_sims, at, 1) > -np.inf
            live = np.nonzero(good.any(axis=1))[0]
            if not len(live):
                break
            at, good = at[live], good[live]
            lr = live[:, None]
            todo[lr, at] = False
            nodes = np.where(good, ids[lr, at], -1)
            new = []
            for k in range(nodes.shape[1]):
                near = np.where(nodes[:, k : k + 1] >= 0, nbr[nodes[:, k]], -1)
                near = np.where(seen[lr, near], -1, near)
                seen[lr, near] = True
                new.append(near)
            near = np.concatenate(new, axis=1)
            got = np.where(near >= 0, np.einsum("qsd,qd->qs", x[near], queries[live]), -np.inf).astype(np.float32)
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_sims = np.concatenate([sims[live], got], axis=1)
            all_todo = np.concatenate([todo[live], near >= 0], axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[live], sims[live], todo[live] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_sims, all_todo))
        return ids, sims

    def descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        """Where (q, 1) to enter layer `to`."""
        starts = np.full((len(queries), 1), self.entry, dtype=np.int32)
        for layer in range(len(self.layers) - 1, to, -1):
            ids, sims = self.beams(queries, starts, 4, layer)
            starts = np.take_along_axis(ids, np.argmax(sims, axis=1)[:, None], 1)
        return starts

    def within(self, queries: np.ndarray, least: np.ndarray, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) whose cosine is at least the query's `least` by single precision, for some queries at a time. The beams of queries that see no end double."""
        for c in range(0, len(queries), CHUNK):
            some, width = np.arange(c, min(c + CHUNK, len(queries))), beam
            while len(some):
                part, low = queries[some], least[some, None]
                if width >= len(self.vectors):  # exact
                    q, k = np.nonzero(part @ self.vectors.T >= low)
                    yield some[q], k
                    break
                ids, sims = self.beams(part, self.descend(part, 0), width, 0)
                hit = sims >= low
                full = hit.all(axis=1)
                q, k = np.nonzero(hit & ~full[:, None])
                yield some[q], ids[q, k]
                some, width = some[full], width * 2

    def audit(self, queries: np.ndarray, least: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[int, int, int]:
        """(beam, true, hit): the first beam, doubled, at which a search by these queries finds AUDIT of all nodes in reach, nodes `own` of theirs left out."""
        n = len(self.vectors)
        truth = queries @ self.vectors.T >= least[:, None]
        if own is not None:
            truth[np.arange(len(queries)), own] = False
        true = int(truth.sum())
        while beam < n:
            hit = sum(int(truth[q, k].sum()) for q, k in self.within(queries, least, beam))
            if hit >= AUDIT * true:
                return beam, true, hit
            beam *= 2
        return beam, true, true


def _choose(x: np.ndarray, base: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Of candidates ids (b, c) for nodes base (b): near ones that no chosen one is nearer to, then the nearest others; (b, most), -1 where there is none."""
    sims = np.where(ids >= 0, np.einsum("bcd,bd->bc", x[ids], x[base]), -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    own = x[ids]
    between = np.matmul(own, own.transpose(0, 2, 1))
    taken = np.zeros(ids.shape, dtype=bool)
    for j in range(ids.shape[1]):
        hidden = (np.where(taken, between[:, j, :], -np.inf) > sims[:, j : j + 1]).any(axis=1)
        taken[:, j] = ~hidden & (ids[:, j] >= 0) & (taken.sum(axis=1) < most)
    rank = np.where(taken, 0, np.where(ids >= 0, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(np.where(ids >= 0, ids, -1), order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


def _lead(own: np.ndarray, tight: float) -> np.ndarray:
    """For each of a batch of unit rows, the row whose ball it joins: an earlier row that leads, or itself."""
    inner = own @ own.T
    lead = np.arange(len(own))
    if (np.triu(inner, 1) >= tight).any():
        heads = [0]
        for i in range(1, len(own)):
            near = inner[i, heads]
            k = int(near.argmax())
            if near[k] >= tight:
                lead[i] = heads[k]
            else:
                heads.append(i)
    return lead


def build(vectors: np.ndarray, levels: np.ndarray, cosine: float = COSINE) -> tuple[Graph, np.ndarray, np.ndarray]:
    """(graph, pivots, owner) of unit rows (single precision) whose levels are given, the highest first in order: which rows are nodes, and the node of whose ball each row is."""
    n = len(vectors)
    tight = math.cos(TIGHT * math.acos(cosine) / 2)
    order = np.argsort(-levels, kind="stable")
    top = int(levels.max())
    g = Graph(vectors, levels, [np.full((n, UPPER if k else GROUND), -1, dtype=np.int32) for k in range(top + 1)], int(order[0]))
    owner = np.arange(n)
    at = 1
    while at < n:
        # Nodes of one batch share a level, so that a layer's nodes are all in before the next begins; early batches are small.
        batch = order[at : at + min(BATCH, at)]
        batch = batch[levels[batch] == levels[batch[0]]]
        at += len(batch)
        level = int(levels[batch[0]])
        ground, sims = g.beams(vectors[batch], g.descend(vectors[batch], 0), BUILD, 0)
        best = np.argmax(sims, axis=1)[:, None]
        inside = np.take_along_axis(sims, best, 1)[:, 0] >= tight
        owner[batch[inside]] = np.take_along_axis(ground, best, 1)[inside, 0]
        batch, ground, sims = batch[~inside], ground[~inside], sims[~inside]
        lead = _lead(vectors[batch], tight)
        owner[batch] = batch[lead]
        heads = lead == np.arange(len(batch))
        batch, ground, sims = batch[heads], ground[heads], sims[heads]
        if not len(batch):
            continue
        own = vectors[batch]
        starts = g.descend(own, level) if level else None
        inner = own @ own.T
        np.fill_diagonal(inner, -np.inf)
        k = min(len(batch) - 1, BUILD // 2)
        siblings = batch[np.argpartition(-inner, k - 1, axis=1)[:, :k]] if k > 0 else np.zeros((len(batch), 0), dtype=np.int64)
        for layer in range(level, -1, -1):
            most = UPPER if layer else GROUND
            if layer:
                ids, sims = g.beams(own, starts, BUILD, layer)
                starts = np.take_along_axis(ids, np.argsort(-sims, axis=1)[:, :4], 1)
            else:
                ids = ground
            nbr = g.layers[layer]
            chosen = _choose(vectors, batch, np.concatenate([ids, siblings.astype(np.int32)], axis=1), most)
            nbr[batch] = chosen
            # Links back: what is new to each neighbour is gathered, and it chooses anew.
            b, c = np.nonzero(chosen >= 0)
            target, source = chosen[b, c], batch[b]
            by = np.argsort(target, kind="stable")
            target, source = target[by], source[by]
            nodes, first, count = np.unique(target, return_index=True, return_counts=True)
            for i in range(0, len(nodes), 1024):
                some, f, m = nodes[i : i + 1024], first[i : i + 1024], count[i : i + 1024]
                wide = np.full((len(some), int(m.max())), -1, dtype=np.int32)
                r = np.repeat(np.arange(len(some)), m)
                col = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                wide[r, col] = source[np.repeat(f, m) + col]
                wide = np.where((wide[:, :, None] == nbr[some][:, None, :]).any(axis=2), -1, wide)
                nbr[some] = _choose(vectors, some, np.concatenate([nbr[some], wide], axis=1), most)
    pivots = np.nonzero(owner == np.arange(n))[0]
    number = np.full(n + 1, -1, dtype=np.int32)
    number[pivots] = np.arange(len(pivots))
    own = Graph(vectors[pivots], levels[pivots], [number[x[pivots]] for x in g.layers], int(number[g.entry]))
    return own, pivots, number[owner]


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b (unit, double precision) one by one."""
    return np.einsum("nd,nd->n", a, b)


class Balls:
    """Vectors (unit rows, double precision) with weights, and the balls that they form: owner is the ball of each, pivots the row in each ball's middle."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray, pivots: np.ndarray, owner: np.ndarray):
        self.ids, self.weights, self.raw, self.pivots, self.owner = ids, weights, raw, pivots, owner
        self.vectors = unit(raw)
        self.middles = self.vectors[pivots]
        self.sizes = np.bincount(owner, minlength=len(pivots))
        self.sums = np.bincount(owner, weights, minlength=len(pivots)).astype(np.int64)
        self.radius = np.zeros(len(pivots))
        np.maximum.at(self.radius, owner, np.arccos(np.clip(_cosines(self.vectors, self.middles[owner]), -1, 1)))
        self.radius[self.sizes == 1] = 0.0
        self.by_ball = np.argsort(owner, kind="stable")
        self.first = np.cumsum(self.sizes) - self.sizes

    def members(self, balls: np.ndarray) -> np.ndarray:
        """The rows of some balls, ball by ball."""
        m = self.sizes[balls]
        return self.by_ball[np.repeat(self.first[balls] - np.cumsum(m) + m, m) + np.arange(m.sum())]

    def some(self, low: int, high: int) -> Balls:
        """Balls low to high (less one) by themselves."""
        rows = np.nonzero((self.owner >= low) & (self.owner < high))[0]
        return Balls(self.ids[rows], self.weights[rows], self.raw[rows], np.searchsorted(rows, self.pivots[low:high]), self.owner[rows] - low)


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a and b, pair by pair; root holds the smallest number of each one's class."""
    a, b = root[a], root[b]
    while True:
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        if not apart.any():
            return
        low, high = low[apart], high[apart]
        np.minimum.at(root, high, low)
        while not np.array_equal(new := root[root], root):
            root[:] = new
        a, b = root[low], root[high]


def meet(g: Graph, nodes: Balls, asked: Balls, at: int | None, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int, int]]:
    """Links between the balls of a graph and those asked; `at` is the number of the first of these where they belong to the graph, else None.

    Returns the links of each vector asked, those of each of the graph's (none where `at` is given: these get theirs when they are asked), the smallest
    ball connected to each ball (the graph's, then the others'), and the audit's beam, true links and hits.
    """
    theta = math.acos(cosine)
    single = asked.middles.astype(np.float32)
    reach = np.minimum(theta + asked.radius + nodes.radius.max(), math.pi)
    least = (np.cos(reach) - SINGLE).astype(np.float32)
    sample = np.unique(np.linspace(0, len(single) - 1, min(AUDITED, len(single))).astype(np.int64))
    audit = g.audit(single[sample], least[sample], g.beam, None if at is None else sample + at)
    m = len(nodes.pivots)
    root = np.arange(m + (0 if at is not None else len(asked.pivots)))
    q_ball, k_ball = np.zeros(len(asked.pivots), dtype=np.int64), np.zeros(m, dtype=np.int64)
    q_links, k_links = np.zeros(len(asked.ids), dtype=np.int64), np.zeros(len(nodes.ids), dtype=np.int64)
    name = (lambda q: q + at) if at is not None else (lambda q: q + m)
    if at is not None:
        q_links += asked.sums[asked.owner] - asked.weights  # members of one ball
    for q, k in g.within(single, least, audit[0]):
        if at is not None:
            other = q + at != k
            q, k = q[other], k[other]
        cos = np.concatenate([_cosines(asked.middles[q[i : i + 65536]], nodes.middles[k[i : i + 65536]]) for i in range(0, len(q), 65536)]) if len(q) else np.zeros(0)
        angle, wide = np.arccos(np.clip(cos, -1, 1)), asked.radius[q] + nodes.radius[k]
        alone = wide == 0
        sure = np.where(alone, cos >= cosine, angle + wide <= theta - ROUNDING)
        np.add.at(q_ball, q[sure], nodes.sums[k[sure]])
        np.add.at(k_ball, k[sure], asked.sums[q[sure]])
        unite(root, name(q[sure]), k[sure])
        open_ = ~sure & ~alone & (angle <= theta + wide + ROUNDING)
        q, k = q[open_], k[open_]
        by = np.argsort(q, kind="stable")
        q, k = q[by], k[by]
        balls, first = np.unique(q, return_index=True)
        for ball, near in zip(balls, np.split(k, first[1:]), strict=True) if len(balls) else ():
            rows, others = asked.members(np.array([ball])), nodes.members(near)
            linked = np.zeros(len(others), dtype=bool)
            step = max(1, CELLS // len(others))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                hit = asked.vectors[part] @ nodes.vectors[others].T >= cosine
                q_links[part] += hit @ nodes.weights[others]
                k_links[others] += asked.weights[part] @ hit
                linked |= hit.any(axis=0)
            found = np.unique(nodes.owner[others[linked]])
            unite(root, np.full(len(found), name(ball)), found)
    q_links += q_ball[asked.owner]
    k_links += k_ball[nodes.owner]
    return q_links, k_links, root, audit


def links_between(x: np.ndarray, ids: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Links of each of some unit rows with the others, and the smallest row connected to each, through one graph."""
    g, pivots, owner = build(x.astype(np.float32), _levels(ids), cosine)
    balls = Balls(ids, np.ones(len(ids), dtype=np.int64), x, pivots, owner)
    links, _, root, _ = meet(g, balls, balls, 0, cosine)
    least = np.full(len(pivots), len(x))
    np.minimum.at(least, root[owner], np.arange(len(x)))
    return links, least[root[owner]]


def _levels(ids: np.ndarray) -> np.ndarray:
    """Levels by hash of id: one in UPPER nodes goes up."""
    h = pd.util.hash_array(ids.astype(np.int64)).astype(np.float64) / 2.0**64
    return np.minimum(5, np.floor(-np.log(np.maximum(h, 1e-18)) / np.log(UPPER))).astype(np.int8)


def _probes(x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """A sample of nodes, and for each a unit vector whose cosine with it is the limit, in a direction of chance (always the same)."""
    sample = np.unique(np.linspace(0, len(x) - 1, min(AUDITED, len(x))).astype(np.int64))
    base = x[sample].astype(np.float64)
    away = np.random.default_rng(len(x)).normal(size=base.shape)
    away -= (away * base).sum(axis=1, keepdims=True) * base
    length = np.sqrt((away * away).sum(axis=1, keepdims=True))
    away = np.where(length > 1e-9, away / np.maximum(length, 1e-9), 0.0)  # in one dimension there is no other direction
    return sample, (cosine * base + math.sqrt(max(0.0, 1 - cosine * cosine)) * away).astype(np.float32)


_BALLS = "ids binary, weights binary, raw binary, pivots binary, owner binary"
_MET = ("node", "links", "root", "part", "shard", "q_shard", "beam", "truth", "hits")
_TYPES = {"ids": np.int64, "weights": np.int64, "pivots": np.int64, "owner": np.int64}


def _pack(b: Balls) -> dict[str, bytes]:
    return {"raw": b.raw.tobytes()} | {k: getattr(b, k).astype(t).tobytes() for k, t in _TYPES.items()}


def _unpack(r, mark: str, kind: str) -> Balls:
    got = {k: np.frombuffer(getattr(r, mark + k), dtype=t) for k, t in _TYPES.items()}
    return Balls(raw=np.frombuffer(getattr(r, mark + "raw"), dtype=kind).reshape(len(got["ids"]), -1), **got)


def _build_shard(cosine: float, kind: str):
    """A shard's graph (block -1), and its balls in SPLIT blocks of about equal numbers."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        ids, raw = rows["rep"].to_numpy(np.int64), np.stack(rows["embedding"].to_numpy()).astype(kind)
        g, pivots, owner = build(unit(raw).astype(np.float32), _levels(ids), cosine)
        sample, probes = _probes(g.vectors, cosine)
        beam, true, hit = g.audit(probes, np.full(len(probes), cosine - SINGLE, dtype=np.float32), BEAM)
        whole = Balls(ids, rows["n"].to_numpy(np.int64), raw, pivots, owner)
        same = {"part": rows["part"].iloc[0], "shard": rows["shard"].iloc[0], "shards": rows["shards"].iloc[0], "beam": min(beam, len(pivots)), "truth": true, "hits": hit}
        out = [same | _pack(whole) | {"block": -1, "at": 0, "levels": g.levels.tobytes(), "layers": b"".join(x.tobytes() for x in g.layers), "entry": g.entry}]
        edges = np.linspace(0, len(pivots), SPLIT + 1).astype(int)
        for k in range(SPLIT):
            if edges[k] < edges[k + 1]:
                out.append(same | _pack(whole.some(edges[k], edges[k + 1])) | {"block": k, "at": edges[k], "levels": None, "layers": None, "entry": None})
        return pd.DataFrame(out)

    return run


def _restore(b: Balls, levels: bytes, layers: bytes, entry: int, beam: int) -> Graph:
    n, lv = len(b.pivots), np.frombuffer(levels, dtype=np.int8)
    flat, out, at = np.frombuffer(layers, dtype=np.int32), [], 0
    for k in range(len(flat) and 1 + (len(flat) // n - GROUND) // UPPER):
        w = UPPER if k else GROUND
        out.append(flat[at : at + n * w].reshape(n, w))
        at += n * w
    return Graph(b.middles.astype(np.float32), lv, out, entry, beam)


def _rows(**columns) -> pd.DataFrame:
    """Rows with the columns of _MET, nulls where none are given (whole numbers stay whole numbers)."""
    n = len(next(iter(columns.values())))
    return pd.DataFrame({c: pd.array(columns.get(c, [None] * n), dtype="string" if c == "part" else "Int64") for c in _MET})


def _meet(cosine: float, kind: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                nodes, asked = _unpack(r, "", kind), _unpack(r, "q_", kind)
                same = r.shard == r.q_shard
                q_links, k_links, root, (beam, true, hit) = meet(_restore(nodes, r.levels, r.layers, r.entry, r.beam), nodes, asked, r.at if same else None, cosine)
                m = len(nodes.pivots)
                ids = np.concatenate([nodes.ids[nodes.pivots], asked.ids[asked.pivots]])  # of balls
                for b, links, balls in ((asked, q_links, np.arange(len(asked.pivots)) + (r.at if same else m)), (nodes, k_links * (not same), np.arange(m))):
                    bound = root[balls]
                    own = links > 0
                    own[b.pivots] |= bound != balls
                    own = np.nonzero(own)[0]
                    yield _rows(node=b.ids[own], links=links[own], root=ids[bound[b.owner[own]]])
                yield _rows(part=[r.part], shard=[r.shard], q_shard=[r.q_shard], beam=[beam], truth=[true], hits=[hit])

    return run


def _prepared(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes of copies by key and salt, classes by key)."""
    e = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"), F.concat_ws(":", F.col("label").cast("string"), F.size(e).cast("string")).alias("part"), F.coalesce(sound, F.lit(False)).alias("sound"))
    key = F.when(F.col("sound"), F.sha2(F.concat_ws("|", "part", F.col("embedding").cast("string")).cast("binary"), 256))
    v = v.withColumn("key", key).withColumn("_salt", salt_of(F.col("vec_id")))
    # A class of copies has a number of its own (by hash), as its smallest vec_id may be null.
    part = cut(v.where("sound").groupBy("key", "_salt").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min(F.struct("part", "embedding")).alias("of")))
    reps = cut(part.groupBy("key").agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.min("of").alias("of")).select("key", F.xxhash64("key").alias("rep"), "least", "n", "of.part", "of.embedding"))
    return v, part, reps


def _kind(vectors: DataFrame) -> str:
    """How vectors travel: as the numbers they came as, so that nothing is lost."""
    t = vectors.schema["embedding"].dataType
    return "<f4" if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.FloatType) else "<f8"


def _graphs(reps: DataFrame, cosine: float, capacity: int, kind: str) -> DataFrame:
    sizes = cut(reps.groupBy("part").count().select("part", F.ceil(F.col("count") / capacity).cast("int").alias("shards")))
    few = sizes.count() <= 10_000
    dealt = reps.join(F.broadcast(sizes) if few else sizes, "part").withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("shards")).cast("int"))
    schema = f"part string, shard int, shards int, beam long, truth long, hits long, {_BALLS}, block int, at long, levels binary, layers binary, entry long"
    with arrow_batches(reps.sparkSession, 10_000):
        return cut(dealt.select("part", "shard", "shards", "rep", "n", "embedding").groupBy("part", "shard").applyInPandas(_build_shard(cosine, kind), schema))


def _met(built: DataFrame, cosine: float, kind: str) -> DataFrame:
    """Links and roots of vectors (node not null) and audits (node null) of each block of queries and each shard it meets."""
    graphs = built.where("block < 0").drop("block", "at", "truth", "hits").withColumn("q_shard", F.explode(F.sequence(F.col("shard"), F.col("shards") - 1))).withColumn("block", F.explode(F.array(*map(F.lit, range(SPLIT)))))
    balls = [c.split()[0] for c in _BALLS.split(", ")]
    asked = built.where("block >= 0").select("part", "block", "at", F.col("shard").alias("q_shard"), F.explode(F.sequence(F.lit(0), F.col("shard"))).alias("shard"), *[F.col(c).alias(f"q_{c}") for c in balls])
    schema = ", ".join(f"{c} {'string' if c == 'part' else 'long'}" for c in _MET)
    with arrow_batches(built.sparkSession, 1):
        return cut(graphs.join(asked, ["part", "shard", "q_shard", "block"]).mapInPandas(_meet(cosine, kind), schema))


def audits(vectors: DataFrame, cosine: float = COSINE, capacity: int = CAPACITY) -> DataFrame:
    """(part, shard, q_shard, beam, truth, hits): of each graph (q_shard null: by probes) and of each block of queries and shard, the beam that the audit ended with, the links
    of the audited queries by comparison with all nodes, and those found."""
    _, _, reps = _prepared(vectors)
    built = _graphs(reps, cosine, capacity, _kind(vectors))
    names = ["part", "shard", "q_shard", "beam", "truth", "hits"]
    own = built.where("block < 0").withColumn("q_shard", F.lit(None).cast("long")).withColumn("shard", F.col("shard").cast("long")).select(names)
    return own.union(_met(built, cosine, _kind(vectors)).where("node is null").select(names))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, capacity: int = CAPACITY) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label); cosine above 0."""
    v, part, reps = _prepared(vectors)
    met = _met(_graphs(reps, cosine, capacity, _kind(vectors)), cosine, _kind(vectors)).where("node is not null")
    counted = met.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = reps.select("key", "rep", "least", "n").join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(counted.withColumnRenamed("node", "rep"), "rep", "left")
    named = cut(named.select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    named = with_key_min(named, "component", "least", "component_id").select("key", "n_links", "component_id")
    known = part.select("key", "_salt").join(named, "key")
    linked = v.where("sound").select("vec_id", "key", "_salt").join(known, ["key", "_salt"]).select("vec_id", "n_links", "component_id")
    alone = v.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
