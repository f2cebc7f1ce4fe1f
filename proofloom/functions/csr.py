"""Graphs held whole by one task: neighbours as arrays, and the loops and searches over them.

A node is known by its place among the sorted ids. Tables come as Parquet files of a folder that the tasks share, so nothing of a graph goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq

PIECE = 16
APART = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]  # the bits of a byte as bytes of a number
CELLS = 1 << 21  # numbers in one matrix of a search from many roots
_kept: dict[tuple, Graph] = {}


def rows_and_nulls(files: tuple[str, ...]) -> tuple[int, dict[str, int | None]]:
    """The rows of Parquet files and the nulls of every column, None where the footers don't tell."""
    rows, nulls = 0, {}
    for f in files:
        meta = pq.read_metadata(f)
        rows += meta.num_rows
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                found, before = column.statistics.null_count if column.statistics is not None and column.statistics.has_null_count else None, nulls.get(column.path_in_schema, 0)
                nulls[column.path_in_schema] = None if found is None or before is None else before + found
    return rows, nulls


def _read(files: tuple[str, ...]) -> pa.Table | None:
    return pa.concat_tables([pq.ParquetFile(f).read() for f in files]).combine_chunks() if files else None


def csr(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each node's entries begin, the order of the entries) for entries sorted by ``key``, otherwise as they are."""
    start = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(key, minlength=n), out=start[1:])
    return start, np.argsort(key, kind="stable")


def spread(start: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the entries of the nodes ``of``, the place in ``of`` that each belongs to), in order."""
    many = start[of + 1] - start[of]
    begin = np.cumsum(many) - many
    return np.repeat(start[of] - begin, many) + np.arange(many.sum()), np.repeat(np.arange(len(of)), many)


class Graph:
    """``nodes``: files with id and what else there is of nodes; ``links``: files with src, dst and perhaps weight. Ends of links that ``nodes`` lacks are nodes too, without names."""

    def __init__(self, nodes: tuple[str, ...], links: tuple[str, ...]):
        self.rows, table = _read(nodes), _read(links)
        src, dst = (table[c].to_numpy() if table is not None else np.zeros(0, np.int64) for c in ("src", "dst"))
        own = self.rows["id"].to_numpy() if self.rows is not None else np.zeros(0, np.int64)
        self.ids = np.unique(np.concatenate([own, src, dst]))
        self.n = len(self.ids)
        self.src, self.dst = np.searchsorted(self.ids, src).astype(np.int32), np.searchsorted(self.ids, dst).astype(np.int32)
        self.weight = table["weight"].to_numpy() if table is not None and "weight" in table.column_names else None
        self.row_of = np.full(self.n, -1, np.int64)
        self.row_of[np.searchsorted(self.ids, own)] = np.arange(len(own))
        self._steps: dict[bool, tuple] = {}

    def column(self, name: str) -> pa.Array:
        """A column of the nodes' table by node; null where there is no row."""
        column = self.rows[name]
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.take(pa.array(self.row_of, mask=self.row_of < 0))

    def places(self, ids: np.ndarray) -> np.ndarray:
        """The nodes of those ``ids`` that are nodes."""
        at = np.searchsorted(self.ids, ids)
        ids, at = ids[at < self.n], at[at < self.n]
        return at[self.ids[at] == ids]

    def steps(self, reverse: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(start, next nodes, weights) along links, against them with ``reverse``; next nodes in the order of names where there are names, else of ids."""
        if reverse not in self._steps:
            a, b = (self.dst, self.src) if reverse else (self.src, self.dst)
            first = np.argsort(self.name_rank[b] if self.rows is not None and "name" in self.rows.column_names else b, kind="stable")
            start, order = csr(a[first], self.n)
            order = first[order]
            self._steps[reverse] = start, b[order], self.weight[order] if self.weight is not None else None
        return self._steps[reverse]

    @property
    def name_rank(self) -> np.ndarray:
        """Equal names have equal ranks; names are ordered by their bytes, as Spark orders them."""
        if not hasattr(self, "_rank"):
            names = self.column("name").cast(pa.binary())
            order = pc.array_sort_indices(names).to_numpy()
            inside = names.take(pa.array(order))
            new = np.ones(self.n, bool)
            if self.n > 1:
                new[1:] = pc.fill_null(pc.not_equal(inside[1:], inside[:-1]), True).to_numpy(zero_copy_only=False)
            self._rank = np.empty(self.n, np.int64)
            self._rank[order] = np.cumsum(new)
            self.names_differ = bool(new.all())
        return self._rank


def load(nodes: tuple[str, ...], links: tuple[str, ...]) -> Graph:
    """The graph of these files, kept for the next task of this process."""
    if (nodes, links) not in _kept:
        _kept.clear()
        _kept[nodes, links] = Graph(nodes, links)
    return _kept[nodes, links]


def pagerank(g: Graph, weighted: bool, damping: float, rounds: int) -> np.ndarray:
    n = g.n
    share = g.weight.astype(float) if weighted else np.ones(len(g.src))
    share /= np.bincount(g.src, share, n)[g.src]
    last = np.bincount(g.src, minlength=n) == 0
    rank = np.full(n, 1.0 / n)
    for _ in range(rounds):
        got = np.bincount(g.dst, rank[g.src] * share, n)
        rank = (1 - damping) / n + damping * (got + rank[last].sum() / n)
    return rank


def label_propagation(g: Graph, rounds: int) -> np.ndarray:
    """The label of every node, as a node. Only nodes with a neighbour that changed count their votes again."""
    n = g.n
    apart = g.src != g.dst
    a, b = g.src[apart].astype(np.int64), g.dst[apart].astype(np.int64)
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    node, near = pairs // max(n, 1), pairs % max(n, 1)
    label = np.arange(n)
    changed = np.ones(n, bool)
    for _ in range(rounds):
        again = np.zeros(n, bool)
        again[node[changed[near]]] = True
        use = again[node]
        votes = np.sort(node[use] * n + label[near[use]])
        if not len(votes):
            break
        first = np.flatnonzero(np.r_[True, votes[1:] != votes[:-1]])
        count, who, what = np.diff(np.r_[first, len(votes)]), votes[first] // n, votes[first] % n
        begin = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        best = np.maximum.reduceat(count * n + (n - 1 - what), begin)
        now = label.copy()
        now[who[begin]] = n - 1 - best % n
        changed = now != label
        label = now
        if not changed.any():
            break
    return label


def levels(g: Graph, root: int, max_depth: int, reverse: bool) -> tuple[list[np.ndarray], bool]:
    """(the nodes of every level from the ``root``'s own, whether more would follow)."""
    start, near, _ = g.steps(reverse)
    seen = np.zeros(g.n, bool)
    seen[root] = True
    out = [np.array([root])]
    while True:
        further = near[spread(start, out[-1])[0]]
        fresh = np.zeros(g.n, bool)
        fresh[further] = True
        fresh &= ~seen
        level = np.flatnonzero(fresh)
        if not len(level) or len(out) > max_depth:
            return out, bool(len(level))
        seen |= fresh
        out.append(level)


def ways(g: Graph, root: int, max_depth: int, reverse: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, place of each one's predecessor in the level before, weight along the way) of every level: of equally short ways the first by the names along it, then by weight.

    Nodes of a level are kept in the order of their ways, and next nodes in that of names. So the first time that a node turns up is its best way, and the new ones are in order again; only where
    names are alike, ways can be too, and are put in order.
    """
    start, near, weight = g.steps(reverse)
    rank = g.name_rank
    seen = np.zeros(g.n, bool)
    seen[root] = True
    first = np.empty(g.n, np.int64)
    nodes, along, order = np.array([root]), np.zeros(1, np.int64), np.zeros(1, np.int64)
    yield nodes, np.zeros(1, np.int64), along
    for _ in range(max_depth):
        at, before = spread(start, nodes)
        there = near[at]
        fresh = np.flatnonzero(~seen[there])
        at, before, there = at[fresh], before[fresh], there[fresh]
        sums = along[before] + weight[at]
        if not g.names_differ:
            s = np.lexsort((sums, rank[there], order[before]))
            before, there, sums = before[s], there[s], sums[s]
        turn = np.arange(len(there))
        first[there[::-1]] = turn[::-1]
        new = first[there] == turn
        if not new.any():
            return
        before, nodes, along = before[new], there[new], sums[new]
        if g.names_differ:
            order = np.arange(len(nodes))
        else:
            up, own = order[before], rank[nodes]
            order = np.cumsum(np.r_[False, (up[1:] != up[:-1]) | (own[1:] != own[:-1])])
        seen[nodes] = True
        yield nodes, before, along


class Pull:
    """Rows of a matrix put together over each node's neighbours; neighbours of one node are taken in pieces of ``PIECE``, pieces of all nodes side by side."""

    def __init__(self, key: np.ndarray, near: np.ndarray, n: int):
        start, order = csr(key, n)
        self.near = near[order]
        many = np.diff(start)
        self.node = np.repeat(np.arange(n), -(-many // PIECE))
        begin = np.cumsum(-(-many // PIECE)) - -(-many // PIECE)
        self.turn = np.arange(len(self.node)) - begin[self.node]
        self.start = start[self.node] + self.turn * PIECE
        self.size = np.minimum(many[self.node] - self.turn * PIECE, PIECE)
        o = np.argsort(-self.size, kind="stable")
        self.node, self.turn, self.start, self.size = self.node[o], self.turn[o], self.start[o], self.size[o]

    def __call__(self, op: np.ufunc, rows: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes of the mask ``want`` that have neighbours, their neighbours' ``rows`` under ``op``)."""
        sel = np.flatnonzero(want[self.node])
        start, size, turn = self.start[sel], self.size[sel], self.turn[sel]
        made = rows.take(self.near[start], axis=0)
        for j in range(1, PIECE):
            c = int(np.searchsorted(-size, -j, side="left"))  # pieces longer than j come first
            if not c:
                break
            op(made[:c], rows.take(self.near[start[:c] + j], axis=0), out=made[:c])
        has = np.zeros(len(want), bool)
        has[self.node[sel]] = True
        nodes = np.flatnonzero(has)
        place = np.cumsum(has) - 1
        out = np.empty((len(nodes), rows.shape[1]), rows.dtype)
        at = place[self.node[sel]]
        out[at[turn == 0]] = made[turn == 0]
        for k in range(1, int(turn.max(initial=0)) + 1):
            own = np.flatnonzero(turn == k)
            out[at[own]] = op(out[at[own]], made[own])
        return nodes, out


def reach_counts(g: Graph, roots: np.ndarray, max_depth: int, reverse: bool, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes reached, their groups, depth of the farthest, whether more would follow) for each of ``roots``, of the nodes with a ``group`` (-1: none). A bit a root: 64 are searched at once in every word."""
    a, b = (g.dst, g.src) if reverse else (g.src, g.dst)
    if ("pull", reverse) not in g._steps:
        g._steps["pull", reverse] = Pull(b, a, g.n)
    pull, words = g._steps["pull", reverse], -(-len(roots) // 64)
    seen = np.zeros((g.n, words), np.uint64)
    bit = np.uint64(1) << (np.arange(len(roots)) % 64).astype(np.uint64)
    np.bitwise_or.at(seen, (roots, np.arange(len(roots)) // 64), bit)
    front = seen.copy()
    apart = lambda bits: np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(len(bits), -1), axis=1, bitorder="little")[:, : len(roots)]
    farthest, more = np.zeros(len(roots), np.int64), np.zeros(len(roots), bool)
    start, near, _ = g.steps(reverse)
    for depth in range(1, max_depth + 2):
        want = np.zeros(g.n, bool)
        want[near[spread(start, np.flatnonzero(front.any(axis=1)))[0]]] = True
        nodes, new = pull(np.bitwise_or, front, want)
        new &= ~seen[nodes]
        some = new.any(axis=1)
        nodes, new = nodes[some], new[some]
        if not len(nodes):
            break
        if depth > max_depth:
            more = apart(np.bitwise_or.reduce(new, axis=0)[None])[0].astype(bool)
            break
        front[:] = 0
        front[nodes] = new
        seen[nodes] |= new
        farthest[apart(np.bitwise_or.reduce(new[group[nodes] >= 0], axis=0)[None])[0].astype(bool)] = depth
    np.bitwise_and.at(seen, (roots, np.arange(len(roots)) // 64), ~bit)
    told = np.flatnonzero(group >= 0)
    told = told[np.argsort(group[told], kind="stable")]
    if not len(told):
        return np.zeros(len(roots), np.int64), np.zeros(len(roots), np.int64), farthest, more
    kept = seen[told]
    count = lambda bits: sum(apart(bits[k : k + 255]).sum(axis=0, dtype=np.uint8).astype(np.int64) for k in range(0, len(bits), 255))
    groups = np.bitwise_or.reduceat(kept, np.flatnonzero(np.r_[True, np.diff(group[told]) != 0]), axis=0)
    return count(kept), count(groups), farthest, more


def distances(g: Graph, roots: np.ndarray) -> Iterator[np.ndarray]:
    """(nodes, 8) of numbers: how far along links each node is from eight of the ``roots`` after another, the last columns perhaps of none; 254 (a byte) or -2 where it isn't reached. A search for 64
    roots works on one word, and the depth at which a node is reached is kept bit by bit."""
    pull, start, near = g._steps["between"][:3]
    words = -(-len(roots) // 64)
    seen = np.zeros((g.n, words), np.uint64)
    np.bitwise_or.at(seen, (roots, np.arange(len(roots)) // 64), np.uint64(1) << (np.arange(len(roots)) % 64).astype(np.uint64))
    front, planes, depth = seen.copy(), [], 0
    while True:
        want = np.zeros(g.n, bool)
        want[near[spread(start, np.flatnonzero(front.any(axis=1)))[0]]] = True
        nodes, new = pull(np.bitwise_or, front, want)
        new &= ~seen[nodes]
        some = new.any(axis=1)
        nodes, new = nodes[some], new[some]
        if not len(nodes):
            break
        depth += 1
        front[:] = 0
        front[nodes] = new
        seen[nodes] |= new
        for p in range(depth.bit_length()):
            if p == len(planes):
                planes.append(np.zeros((g.n, words), np.uint64))
            if depth >> p & 1:
                planes[p][nodes] |= new
    kind = np.uint8 if depth < 250 else np.int32
    for w in range(words):
        octets = lambda x: np.ascontiguousarray(np.ascontiguousarray(x[:, w]).view(np.uint8).reshape(g.n, 8).T)
        reached, bits = octets(seen), [octets(x) for x in planes]
        for i in range(min(8, -(-(len(roots) - 64 * w) // 8))):
            inside = APART.take(reached[i])
            if kind is np.uint8:  # a number of eight bytes has the figures of eight roots
                far = (inside ^ APART[255]) * np.uint64(254)
                for p, x in enumerate(bits):
                    far |= APART.take(x[i]) << np.uint64(p)
                yield far.view(np.uint8).reshape(-1, 8)
            else:
                far = np.zeros((g.n, 8), kind)
                for p, x in enumerate(bits):
                    far |= APART.take(x[i]).view(np.uint8).reshape(-1, 8).astype(kind) << kind(p)
                far[inside.view(np.uint8).reshape(-1, 8) == 0] = -2
                yield far


def betweenness(g: Graph, roots: np.ndarray) -> np.ndarray:
    """What the nodes get as inner nodes of the shortest paths from ``roots``.

    A link lies on shortest paths from a root if it leads one level further. Such links are taken level by level: ahead they add up numbers of paths; on the way back (1 + dependency) / paths of a node is
    1 / paths plus what its next nodes have, and what was added to it, times paths, is its dependency.
    """
    n = g.n
    if "between" not in g._steps:
        apart = g.src != g.dst
        a, b = g.src[apart], g.dst[apart]
        start, order = csr(a, n)
        a, b = a[order], b[order]
        g._steps["between"] = Pull(b, a, n), start, b, a.astype(np.intp), b.astype(np.intp)
    _, start, dst, src_at, dst_at = g._steps["between"]
    total, side = np.zeros(n), 64 * max(1, CELLS // n)
    roots = roots[start[roots + 1] > start[roots]]
    for first in range(0, len(roots), side):
        own = roots[first : first + side]
        for turn, far in enumerate(distances(g, own)):
            further = np.ascontiguousarray((_rows(far, dst_at) == _rows(far + far.dtype.type(1), src_at)).T)
            far = np.ascontiguousarray(far.T)
            for k, root in enumerate(own[8 * turn : 8 * turn + 8]):
                use = np.flatnonzero(further[k])
                a, b = src_at.take(use), dst.take(use)
                level = far[k].take(a)
                order = np.argsort(level, kind="stable")
                a, b = a.take(order), b.take(order).astype(np.intp)
                end = np.cumsum(np.bincount(level))
                ranges = list(zip((end - np.diff(end, prepend=0)).tolist(), end.tolist()))
                paths = np.zeros(n)
                paths[root] = 1
                for x, y in ranges:
                    _add(paths, b[x:y], paths.take(a[x:y]))
                one = 1 / np.maximum(paths, 1)
                back = one.copy()
                for x, y in reversed(ranges[1:]):
                    _add(back, a[x:y], back.take(b[x:y]))
                back -= one
                back *= paths
                total += back
    return total


def _rows(far: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of a matrix with eight bytes a row, taken as one number each."""
    return far.view(np.uint64)[:, 0].take(at).view(np.uint8).reshape(-1, 8) if far.dtype == np.uint8 else far.take(at, axis=0)


def _add(to: np.ndarray, at: np.ndarray, what: np.ndarray) -> None:
    if 8 * len(at) < len(to):
        np.add.at(to, at, what)
    else:
        to += np.bincount(at, what, len(to))
