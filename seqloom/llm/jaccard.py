"""N-gram Jaccard join by prefix trees: all pairs of documents whose sets of word shingles have a Jaccard index of 0.75 or more, as components.

1. All documents are counted into SLOTS counters (document frequency by hash slot). Slot count, then hash, is the global
   order of shingles, rare ones first; the counters have a fixed size and are broadcast.
2. Two linked sets share 1 + n // SPARE or more of the first n - ceil(0.75 n) + 1 + n // SPARE elements of each. Those prefixes
   are grouped by element. Sets that share too few of them with sets of fitting size are peeled off: long texts share some by
   chance. Then, within an element, sets in order of size are tied into blocks wherever sizes allow a link. No pairs are made.
   Blocks over CHUNK sets are tied anew by two shared elements in place of one: the more sets there are, the more share one by chance.
3. The sets of each block go to one task (blocks over CHUNK sets are cut into chunks), which stores them in a prefix tree
   by the global order, probes it with all sets at once, counts shared elements along shared paths once, and prunes a subtree for
   the sets that can't reach the needed overlap in what remains. Sets already in one component need no further probe.
4. In a block of several chunks, first representatives of the chunks' components are joined. Then every set outside the
   block's largest component meets all chunks. Where more than OUTSIDE sets are outside, the same is done for the sets of each
   prefix element in place of the block, once those are peeled off that share too few prefix elements with any size of partner
   (equal lists of sets once), unless those lists make more pairs than the block. So no link between different components is left untested.

Equal sets are one node throughout. Sets hold 56-bit shingle hashes and have 64-bit names.

Defined cases: a null text or one without words has an empty set, links with nothing and is its own component; fewer than
SHINGLE words make one shingle; a null doc_id is never the smallest, and a component of
such rows only has a null id; rows go by id and text, so null and repeated ids are told apart; repeated rows share a component; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, lean, row_name, shuffle_partitions, with_free_name, written
from .components import connected
from .kernels import chunks, forget_powers, mix, shingles, SPACES, string_buffers, U64, Words

SHINGLE, PERCENT = 5, 75
SLOTS, BLOCK, FILTER_BITS = 1 << 20, 1 << 12, 1 << 25
#: Sets that one task joins at once; representatives of a component in a cut block; sets outside its largest component up to
#: which a cut block is joined as a whole without a look at the lists of its elements.
CHUNK, REPRESENTATIVES, OUTSIDE = 1024, 8, 8192
#: Rows of sets turned into Python objects at once.
ROWS = 256
#: Bytes of the table in which a tree's probes look elements up.
TABLE = 1 << 25
#: Sets sent in a round, in multiples of those that there are.
SENT = 4
#: Prefixes are longer by one in SPARE elements of the set than one shared element needs, so that linked sets share many.
SPARE = 16
#: Size classes grow by CLASS; sets REACH + 1 classes apart can't be linked. Rounds of peeling.
CLASS, REACH, PEELS = 1.05, 6, 2


def needed(n, m):
    """Least intersection of sets of n and m elements that are linked."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def least_shared(n: int) -> int:
    """Least number of prefix elements that a set of n elements shares with the prefix of a linked set."""
    return 1 + n // SPARE


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + least_shared(n)


def sets_of(offsets: np.ndarray, data: np.ndarray, a: int, b: int) -> list[np.ndarray]:
    """Sorted distinct 56-bit shingle hashes of rows a to b."""
    w = Words(offsets, data, a, b, SPACES, True)
    h = w.hashes()
    s = shingles(h, SHINGLE) >> U64(8)
    out = []
    first = w.first.tolist()
    for i in range(w.n):
        x, y = first[i], first[i + 1]
        if y - x >= SHINGLE:
            v = np.sort(s[x : y - SHINGLE + 1])
            keep = np.ones(len(v), bool)
            keep[1:] = v[1:] != v[:-1]
            out.append(v[keep])
        elif y > x:
            out.append(mix(shingles(h[x:y], y - x) + U64(y - x)) >> U64(8))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_name(v: np.ndarray) -> int:
    """A name of the set that needs no order: equal sets, equal names."""
    return int(np.add.reduce(mix(v + U64(0x5851F42D4C957F2D))).astype(np.int64)) if len(v) else 0


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    offsets, data = string_buffers(batch.column(1))
    for a, b in chunks(offsets):
        yield a, sets_of(offsets, data, a, b)


def _blocks(array: np.ndarray) -> pa.RecordBatch:
    """Rows of the blocks of an array that aren't all zero."""
    parts = array.reshape(-1, BLOCK)
    some = np.flatnonzero(parts.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array([None] * len(some), pa.int64()), pa.array([None] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["doc_id", "sid", "n", "block"])


def _survey(docs: DataFrame) -> DataFrame:
    """doc_id, sid and n of each row; and rows with a block of this task's counters."""

    def run(batches):
        counts = np.zeros(SLOTS, np.uint32)
        for b in batches:
            sid, n = [], []
            for _, sets in _rows(b):
                for v in sets:
                    sid.append(set_name(v))
                    n.append(len(v))
                counts += np.bincount(np.concatenate([*sets, np.zeros(0, U64)]).astype(np.int64) & (SLOTS - 1), minlength=SLOTS).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.binary())], ["doc_id", "sid", "n", "block"])
        yield _blocks(counts)

    return docs.mapInArrow(lean(run, forget_powers), "doc_id long, sid long, n long, block binary")


def _summed(rows: DataFrame, size: int, kind: type, add: Callable) -> np.ndarray:
    """The blocks of all tasks added up: each task holds its blocks' sums only, and the driver gets the fixed-size whole."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(x, kind)
                sums[i] = add(sums[i], v) if i in sums else v.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["n", "block"])

    out = np.zeros(size, kind).reshape(-1, BLOCK)
    for r in rows.select("n", "block").repartition(shuffle_partitions(rows.sparkSession), "n").mapInArrow(lean(run, forget_powers), "n long, block binary").collect():
        out[r.n] = add(out[r.n], np.frombuffer(r.block, kind))
    return out.reshape(-1)


def rarity(counts: np.ndarray) -> np.ndarray:
    """An eight-bit rank of each slot: eight steps for a doubling of its count."""
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(counts, 1).astype(np.float64)))).astype(np.uint8)


def ordered(v: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the global order: rank in the top byte, hash below."""
    return np.sort(v | (rank[(v & U64(SLOTS - 1)).astype(np.int64)].astype(U64) << U64(56)))


def _prefixes(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """tok, sid, n for each element of each set's prefix; copies within a task are sent once or twice."""
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for _, sets in _rows(b):
                toks, sids, ns = [], [], []
                for v in sets:
                    if not len(v) or (name := set_name(v)) in seen:
                        continue
                    seen.add(name)
                    p = ordered(v, shared.value)[: prefix_length(len(v))]
                    toks.append(p)
                    sids.append(np.full(len(p), name, np.int64))
                    ns.append(np.full(len(p), len(v), np.int32))
                if toks:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(toks).view(np.int64)), pa.array(np.concatenate(sids)), pa.array(np.concatenate(ns))], ["tok", "sid", "n"])

    return docs.mapInArrow(lean(run, forget_powers), "tok long, sid long, n int")


def _shared(prefixes: DataFrame) -> DataFrame:
    """tok, sid, n, once each, of the prefix elements that another set of a size that allows a link holds in its prefix too.

    In order of size, such a set stands next to it; one row is carried from batch to batch, so a hot element needs no memory.
    """

    def run(batches):
        tok, sid, n, hit = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), False  # the last row, if any
        for b in batches:
            if not b.num_rows:
                continue
            tok, sid, n = (np.append(x, b.column(i).to_numpy(zero_copy_only=False)) for i, x in enumerate((tok, sid, n)))
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1])
            tok, sid, n = tok[new], sid[new], n[new]
            near = (tok[1:] == tok[:-1]) & (PERCENT * n[1:].astype(np.int64) <= 100 * n[:-1].astype(np.int64))
            hits = np.zeros(len(tok), bool)
            hits[0] = hit
            hits[1:] |= near
            hits[:-1] |= near
            out = np.flatnonzero(hits[:-1])
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(tok[out]), pa.array(sid[out]), pa.array(n[out])], ["tok", "sid", "n"])
            tok, sid, n, hit = tok[-1:], sid[-1:], n[-1:], bool(hits[-1])
        if hit:
            yield pa.RecordBatch.from_arrays([pa.array(tok), pa.array(sid), pa.array(n)], ["tok", "sid", "n"])

    p = shuffle_partitions(prefixes.sparkSession)
    return prefixes.repartition(p, "tok").sortWithinPartitions("tok", "n", "sid").mapInArrow(lean(run, forget_powers), "tok long, sid long, n int")


def _enough(shared: DataFrame) -> DataFrame:
    """The rows of shared of sets that share as many prefix elements, with whatever sets, as a link needs."""
    able = shared.groupBy("sid").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")).where(F.col("c") >= 1 + F.floor(F.col("n") / SPARE)).select("sid")
    return shared.join(able, "sid", "left_semi")


def _ties(shared: DataFrame) -> DataFrame:
    """Edges (a, b) from the first set of each run of an element's sets, in order of size, between which sizes allow a link."""

    def run(batches):
        last = None  # tok, first sid of the run, its last size
        for b in batches:
            tok, sid, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if last is not None:
                tok, sid, n = np.append(last[0], tok), np.append(last[1], sid), np.append(last[2], n)
            if not len(tok):
                continue
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (PERCENT * n[1:].astype(np.int64) > 100 * n[:-1].astype(np.int64))
            first = np.maximum.accumulate(np.where(new, np.arange(len(tok)), 0))
            e = np.flatnonzero(~new & (sid != sid[first]))
            last = (tok[-1:], sid[first[-1:]], n[-1:])
            pairs = np.unique(np.stack([sid[first[e]], sid[e]], axis=1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    n = shuffle_partitions(shared.sparkSession)
    return shared.select("tok", "sid", "n").repartition(n, "tok").sortWithinPartitions("tok", "n", "sid").mapInArrow(lean(run, forget_powers), "a long, b long").distinct()


def _level(n: np.ndarray) -> np.ndarray:
    """Sets of level l or more that are linked share more than 2 ** l prefix elements; -1 where it may be one only."""
    return np.floor(np.log2(np.maximum(n // SPARE, 0.5))).astype(np.int64)


def _pairs(shared: DataFrame) -> DataFrame:
    """tok, sid, n in which tok names two prefix elements of the set: linked sets have such a name in common.

    At a level l that both sets have, elements are dealt to 2 ** l classes, so that two or more shared ones meet in a class, and each two of
    a class are named. A set has its own level and that of the smallest set it may be linked with; elements of level -1 are named one by one.
    """

    def names(tok: np.ndarray, sid: np.ndarray, n: np.ndarray):
        own, least = _level(n), _level(-(-PERCENT * n.astype(np.int64) // 100))
        for level, rows in ((own, np.ones(len(n), bool)), (least, least < own)):
            t, s, m, l = tok[rows].view(U64), sid[rows], n[rows], level[rows]
            single = l < 0
            yield mix(t[single]), s[single], m[single]
            t, s, m, l = t[~single], s[~single], m[~single], l[~single]
            h = mix(t)
            place = (h >> U64(20)).astype(np.int64) & ((1 << l) - 1)
            by = np.lexsort((place, s))
            h, s, m, l, place = h[by], s[by], m[by], l[by], place[by]
            for d in range(1, len(h)):
                both = np.flatnonzero((s[d:] == s[:-d]) & (place[d:] == place[:-d]))
                if not len(both):
                    break
                yield mix(h[both] + h[both + d] + l[both].astype(U64)), s[both], m[both]

    def emit(part):
        for t, s, m in names(*part):
            if len(t):
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(s), pa.array(m)], ["tok", "sid", "n"])

    def run(batches):
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]  # the last set
        for b in batches:
            if not b.num_rows:
                continue
            got = [np.append(x, b.column(i).to_numpy(zero_copy_only=False)) for i, x in enumerate(rest)]
            last = int(np.searchsorted(got[1], got[1][-1]))
            yield from emit([x[:last] for x in got])
            rest = [x[last:] for x in got]
        yield from emit(rest)

    p = shuffle_partitions(shared.sparkSession)
    return shared.select("tok", "sid", "n").repartition(p, "sid").sortWithinPartitions("sid").mapInArrow(lean(run, forget_powers), "tok long, sid long, n int")


def _split(blocks: DataFrame, shared: DataFrame) -> DataFrame:
    """blocks (sid, block), in which those over CHUNK sets are tied anew, by two shared elements in place of one: the more sets
    there are, the more share one by chance, until most of them are a single block."""
    blocks = written(blocks, "blocks")
    large = written(blocks.groupBy("block").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > CHUNK).select("block"), "large")
    if large.isEmpty():
        return blocks
    ties = written(_ties(_pairs(shared.join(blocks.join(large, "block", "left_semi").select("sid"), "sid", "left_semi"))), "ties")
    return blocks.join(large, "block", "left_anti").select("sid", "block").unionByName(connected(ties).select(F.col("node").alias("sid"), F.col("root").alias("block")))


def _bits(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U64)) & U64(FILTER_BITS - 1)).astype(np.int64)


def _filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which every id's bit is set."""

    def run(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            at = _bits(b.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        packed = _blocks(bits)
        yield pa.RecordBatch.from_arrays([packed.column(2), packed.column(3)], ["n", "block"])

    return _summed(ids.mapInArrow(lean(run, forget_powers), "n long, block binary"), FILTER_BITS // 8, np.uint8, np.bitwise_or)


def _members(docs: DataFrame, rank: np.ndarray, wanted: DataFrame) -> DataFrame:
    """sid and ordered set of the wanted rows (doc_id, sid, block): the text of others is skipped by a bitmap of the ids, the rest by the join."""
    shared = docs.sparkSession.sparkContext.broadcast((rank, _filter(wanted.select("doc_id"))))

    def run(batches):
        rank, bits = shared.value
        seen: set[int] = set()
        for b in batches:
            at = _bits(b.column(0).to_numpy(zero_copy_only=False))
            b = b.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            for _, sets in _rows(b):
                rows = [(s, v) for v in sets if len(v) and (s := set_name(v)) not in seen and not seen.add(s)]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([ordered(v, rank).tobytes() for _, v in rows], pa.binary())], ["sid", "elements"])

    return docs.mapInArrow(lean(run, forget_powers), "sid long, elements binary")


class Node:
    __slots__ = ("children", "edge", "leaf", "low", "high")

    def __init__(self, edge: np.ndarray, leaf: int | None, size: int):
        self.edge, self.leaf, self.children, self.low, self.high = edge, leaf, {}, size, size


class Tree:
    """Sets in the global order, elements by their numbers in it; common beginnings are stored once, each edge is an array of elements."""

    STEP = 48

    def __init__(self):
        self.root = Node(np.zeros(0, np.int64), None, 0)
        self.root.low = 1 << 62

    def add(self, v: np.ndarray, leaf: int) -> None:
        node, at, size = self.root, 0, len(v)
        while True:
            node.low, node.high = min(node.low, size), max(node.high, size)
            if at == size:
                node.leaf = leaf  # equal sets never meet here: a set is one leaf
                return
            child = node.children.get(int(v[at]))
            if child is None:
                node.children[int(v[at])] = Node(v[at:], leaf, size)
                return
            e, rest = child.edge, v[at : at + len(child.edge)]
            differ = np.flatnonzero(e[: len(rest)] != rest)
            same = int(differ[0]) if len(differ) else len(rest)
            if same < len(e):
                middle = Node(e[:same], None, child.low)
                middle.high = child.high
                child.edge = e[same:]
                middle.children[int(child.edge[0])] = child
                node.children[int(v[at])] = child = middle
            node, at = child, at + same

    def probe(self, probes: Probes, roots: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links (probing set, leaf) from larger sets to the leaves of other roots; a node is met by all sets at once that may still reach its leaves.

        roots may change while this runs, so that what a link joined is no longer probed.
        """
        stack = [(c, 0, probes.sets, np.zeros(len(probes.sets), np.int64)) for c in self.root.children.values()]
        while stack:
            node, depth, who, shared = stack.pop()
            n = probes.size[who]
            keep = (n >= node.low) & (PERCENT * n <= 100 * node.high)
            if not node.children:
                keep &= roots[who] != roots[node.leaf]
            who, shared, n = who[keep], shared[keep], n[keep]
            least = needed(n, node.low)
            edge, done = node.edge, 0
            while done < len(edge) and len(who):
                part = edge[done : done + self.STEP]
                shared = shared + probes.held(part, who)
                done += len(part)
                keep = shared + np.minimum(node.high - depth - done, probes.behind(part[-1], who)) >= least
                if not keep.all():
                    who, shared, n, least = who[keep], shared[keep], n[keep], least[keep]
            if not len(who):
                continue
            depth += len(edge)
            if node.leaf is not None:
                for i in who[(shared >= needed(n, depth)) & (roots[who] != roots[node.leaf])].tolist():
                    if roots[i] != roots[node.leaf]:
                        yield i, node.leaf
            stack += [(c, depth, who, shared) for c in node.children.values()]


class Probes:
    """Some sets of a group as columns of a table of its elements, those of one set only left out."""

    MARKS = 64

    def __init__(self, sets: np.ndarray, flat: np.ndarray, start: np.ndarray, row: np.ndarray, rows: int):
        self.sets, self.size, self.row, self.rows = sets, np.diff(start), row, rows
        n = self.size[sets]
        self.column = np.zeros(len(self.size), np.int64)
        self.column[sets] = np.arange(len(sets))
        own = np.concatenate([flat[start[i] : start[i + 1]] for i in sets])
        self.table = np.zeros((rows + 1, len(sets)), np.uint8)
        self.table[row[own], np.repeat(np.arange(len(sets)), n)] = 1
        self.table[rows] = 0
        # how many elements of a set lie before each of some marks in the order
        self.marks = np.linspace(0, len(row), self.MARKS, endpoint=False).astype(np.int64)
        self.before = np.stack([np.searchsorted(flat[start[i] : start[i + 1]], self.marks) for i in sets], axis=1)

    def held(self, part: np.ndarray, who: np.ndarray) -> np.ndarray:
        """How many elements of part, at most 255, each set holds."""
        rows = self.row[part]
        rows, at = rows[rows < self.rows], self.column[who]
        if 4 * len(at) > len(self.sets):
            return self.table[rows].sum(axis=0, dtype=np.uint8)[at]
        return self.table[rows[:, None], at].sum(axis=0, dtype=np.uint8)

    def behind(self, element: int, who: np.ndarray) -> np.ndarray:
        """At least as many as the elements of each set behind element in the order."""
        k = int(np.searchsorted(self.marks, element, "right")) - 1
        return self.size[who] - self.before[k, self.column[who]]


def link(names: list[int], sets: list[np.ndarray], roots: list[int] | None = None, probing: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links that join the components of these sets; roots: components known before; probing: only pairs with such a set count."""
    start = np.concatenate([[0], np.cumsum([len(v) for v in sets])])
    order, flat, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count > 1
    rows = int(several.sum())
    row = np.where(several, np.cumsum(several) - 1, rows)
    known = np.unique(np.array(range(len(sets)) if roots is None else roots, np.int64), return_inverse=True)[1]
    own = np.ones(len(sets), bool) if probing is None else np.array(probing, bool)
    out = []
    for theirs, probes in ((own, np.arange(len(sets))), (~own, np.flatnonzero(own))):  # trees of those that probe, and of the others
        tree = Tree()
        for i in np.flatnonzero(theirs).tolist():
            tree.add(flat[start[i] : start[i + 1]], i)
        if not tree.root.children:
            continue
        step = max(16, TABLE // (rows + 1))
        for at in range(0, len(probes), step):
            for i, j in tree.probe(Probes(probes[at : at + step], flat, start, row, rows), known):
                out.append((names[i], names[j]))
                known[known == known[i]] = known[j]
    return out


def _join_groups(groups: DataFrame) -> DataFrame:
    """Links (a, b) within each group g of rows (g, sid, elements, root, probing); a group is bounded by how it was cut."""

    def finish(rows: dict[int, tuple]) -> pa.RecordBatch:
        names = list(rows)
        pairs = link(names, [np.frombuffer(r[0], U64) for r in rows.values()], [r[1] for r in rows.values()], [r[2] for r in rows.values()]) if len(names) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches):
        key, rows = None, {}
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            for g, s, v, r, p in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if g != key:
                    yield finish(rows)
                    key, rows = g, {}
                old = rows.get(s)
                rows[s] = (v, r, p or bool(old and old[2]))
        yield finish(rows)

    n = shuffle_partitions(groups.sparkSession)
    return groups.select("g", "sid", "elements", "root", "probing").repartition(n, "g").sortWithinPartitions("g").mapInArrow(lean(run, forget_powers), "a long, b long")


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with the root of each sid by links (its own where it has none)."""
    star = connected(links)
    return nodes.join(star.select(F.col("node").alias("sid"), F.col("root").alias("_root")), "sid", "left").withColumn("root", F.coalesce("_root", "sid")).drop("_root")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, sid, n) of every row by its name, and enough links (a, b) between sids to join all components."""
    d = with_free_name(docs, "doc_id", "text").select(row_name().alias("doc_id"), "text")  # from here on rows go by their names
    survey = written(_survey(d), "survey")
    names = survey.where("block is null").select(F.col("doc_id").alias("row"), "sid", "n")
    rank = rarity(_summed(survey.where("block is not null"), SLOTS, np.uint32, np.add))
    met = written(_enough(written(_shared(_prefixes(d, rank)), "shared")), "met")
    met = written(_peeled(met.withColumn("root", F.col("sid"))), "met")
    ties = written(_ties(met), "ties")
    blocks = _split(connected(ties).select(F.col("node").alias("sid"), F.col("root").alias("block")), met)
    first = names.where("n > 0").groupBy("sid").agg(F.min("row").alias("doc_id"))
    wanted = written(first.join(blocks, "sid"), "wanted")
    size = wanted.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    placed = wanted.join(size, "block").withColumn("cuts", F.ceil(F.col("size") / CHUNK).cast("int")).withColumn("cut", F.pmod(F.xxhash64("sid"), F.col("cuts")).cast("int"))
    members = written(_members(d, rank, wanted).join(placed.select("sid", "block", "cuts", "cut"), "sid"), "members")
    group = lambda *c: F.xxhash64("block", *c)
    found = written(_join_groups(members.select(group("cut").alias("g"), "sid", "elements", F.col("sid").alias("root"), F.lit(True).alias("probing"))), "links")
    cut = members.where("cuts > 1")
    if cut.isEmpty():
        return names, found
    rooted = _roots(cut.select("sid", "block", "cut", "cuts"), found)
    # representatives: those of least hash in each component, by several hashes
    least = [F.min(F.struct(F.xxhash64("sid", F.lit(salt)).alias("h"), "sid"))["sid"] for salt in range(REPRESENTATIVES)]
    reps = written(rooted.groupBy("block", "root").agg(F.array_distinct(F.array(*least)).alias("x")).select("block", "root", F.explode("x").alias("sid")), "reps")
    many = reps.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    reps = reps.join(many, "block").join(cut.select("sid", "elements"), "sid").select(group(F.pmod(F.xxhash64("root"), "parts")).alias("g"), "sid", "elements", "root", F.lit(True).alias("probing"))
    found = written(found.unionByName(_join_groups(reps)), "links")
    rooted = written(_roots(cut.select("sid"), found), "rooted")
    placed = cut.select("sid", "block", "cuts").join(rooted, "sid")
    main = placed.groupBy("block", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("block").agg(F.sum("k").alias("size"), F.max("k").alias("k"))
    left = written(main.select("block", (F.col("size") - F.col("k")).alias("left")).where("left > 0"), "left")
    rows = _crossing(placed.join(left.where(F.col("left") <= OUTSIDE).select("block"), "block").withColumnRenamed("block", "key"))
    found = written(found.unionByName(_rounds(written(rows, "cross"), cut)), "links")
    many = left.where(F.col("left") > OUTSIDE).select("block")
    if many.isEmpty():
        return names, found
    # in blocks of many components, only pairs that share a prefix element: the sets of such an element are a list
    cut = cut.join(many, "block", "left_semi")
    shared = written(_elements(cut.join(rooted, "sid")), "shared")
    for _ in range(PEELS):
        shared = written(_peeled(shared), "shared")
    lists = shared.groupBy("tok").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.sum(F.xxhash64(F.lit(3), "sid") % (1 << 40)).alias("y")).where("r0 <> r1")
    lists = written(lists.groupBy("k", "x", "y").agg(F.min("tok").alias("tok")), "lists")  # equal lists once
    open_ = written(shared.join(lists.select("tok", "k", F.ceil(F.col("k") / CHUNK).cast("int").alias("cuts")), "tok").withColumnRenamed("tok", "key"), "open")
    # near copies of one text share most elements: their lists, each joined, may be dearer than the block as a whole
    pairs = open_.join(placed.select("sid", "block"), "sid").groupBy("block").agg(F.sum("k").alias("pairs"))
    dear = written(pairs.join(main, "block").where(F.col("pairs") > F.col("size") * (F.col("size") - F.col("k"))).select("block"), "dear")
    rows = _crossing(placed.join(dear, "block", "left_semi").withColumnRenamed("block", "key"))
    found = written(found.unionByName(_rounds(written(rows, "cross"), cut)), "links")
    open_ = open_.join(placed.join(dear, "block", "left_semi").select("sid"), "sid", "left_anti")
    rows = open_.where("cuts = 1").select(F.xxhash64("key", F.lit(0), F.lit(0)).alias("g"), "sid", "root", F.lit(True).alias("probing"))
    rows = written(rows.unionByName(_crossing(open_.where("cuts > 1"))), "cross")
    return names, written(found.unionByName(_rounds(rows, cut)), "links")


def _crossing(rows: DataFrame) -> DataFrame:
    """Groups (g, sid, root, probing) of rows (key, cuts, sid, root): the sets of a key outside its largest component, in chunks, against all its sets, in cuts."""
    main = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max(F.struct("k", "root"))["root"].alias("main"))
    sets = rows.join(main, "key").withColumn("outside", F.col("root") != F.col("main"))
    sets = sets.join(sets.where("outside").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("outer")), "key")
    place = lambda salt, of: F.pmod(F.xxhash64("sid", F.lit(salt)), of).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    out = sets.withColumn("cut", place(5, F.col("cuts"))).select("key", "cut", each("outer").alias("o"), "sid", "root", F.lit(False).alias("probing"))
    out = out.unionByName(sets.where("outside").withColumn("o", place(7, F.col("outer"))).select("key", each("cuts").alias("cut"), "o", "sid", "root", F.lit(True).alias("probing")))
    return out.select(F.xxhash64("key", "cut", "o").alias("g"), "sid", "root", "probing")


def _rounds(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within the groups of rows (g, sid, root, probing), in rounds that each send about SENT times as many sets as there are, so that the exchange needs a bounded part of the disk."""
    found = None
    rounds = max(1, -(-rows.count() // max(1, SENT * sets.count())))
    for i in range(rounds):
        part = rows.where(F.pmod(F.col("g"), F.lit(rounds)) == i).join(sets.select("sid", "elements"), "sid")
        links = written(_join_groups(part), "links")
        found = links if found is None else found.unionByName(links)
    return found


def _peeled(shared: DataFrame) -> DataFrame:
    """The rows of shared without those of sets that can have no link outside their component.

    Linked sets of n and m elements share 3(n + m)/7 elements or more, of which at most ceil(0.75 n) - least_shared(n) lie behind
    the one's prefix, and likewise the other's. A set's lists are counted by the size classes met in them, and a class that is
    met too seldom can't hold a partner; within a class the bound is least at an end.
    """
    size = F.floor(F.ln(F.col("n").cast("double")) / math.log(CLASS)).cast("int")
    several = shared.groupBy("tok").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("tok")
    rows = shared.join(several, "tok").withColumn("own", size)
    classes = rows.groupBy("tok", F.col("own").alias("other")).agg(F.count(F.lit(1)).alias("k"))
    reach = rows.join(classes, "tok").where((F.abs(F.col("own") - F.col("other")) <= REACH) & ((F.col("own") != F.col("other")) | (F.col("k") > 1))).select("tok", "sid", "root", "n", "other")
    need = lambda m: 3 * (F.col("n") + m) / 7 - F.greatest(0.75 * F.col("n") - F.floor(F.col("n") / SPARE), 0.75 * m - m / SPARE + 1)
    low, high = F.pow(F.lit(CLASS), F.col("other")), F.pow(F.lit(CLASS), F.col("other") + 1)
    counted = reach.groupBy("sid", "n", "other").agg(F.count(F.lit(1)).alias("c"))
    able = counted.where(F.col("c") >= F.least(need(low), need(high)) - 1e-6).select("sid", "other")
    return reach.join(able, ["sid", "other"]).select("tok", "sid", "root", "n").distinct()


def _elements(members: DataFrame) -> DataFrame:
    """(tok, sid, root, n) for each prefix element of members; n is the size of the set."""

    def run(batches):
        for b in batches:
            sets = [np.frombuffer(x, U64) for x in b.column(0).to_pylist()]
            first = [v[: prefix_length(len(v))] for v in sets]
            n = np.array([len(v) for v in first], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*first, np.zeros(0, U64)]).view(np.int64)), *(pa.array(np.repeat(b.column(i).to_numpy(), n)) for i in (1, 2)), pa.array(np.repeat(np.array([len(v) for v in sets], np.int32), n))], ["tok", "sid", "root", "n"])

    return members.select("elements", "sid", "root").mapInArrow(lean(run, forget_powers), "tok long, sid long, root long, n int")


def _rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, sid, n) of every row; and (sid, root, low, first) of every set: its least doc_id, and its first row, those of null doc_id last."""
    names, found = links(docs)
    ids = with_free_name(docs, "doc_id", "text").select(row_name().alias("row"), "doc_id").distinct()
    names = written(names.join(ids, "row"), "names")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row"))
    least = names.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("low"), first.alias("first"))
    return names, _roots(least, found)


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id of the component) of every row."""
    names, rooted = _rooted(docs)
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of = rooted.select("sid", "root").join(low, "root").select("sid", "component_id")
    return names.join(of, "sid", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which each component keeps the row of least doc_id (null last), and equal rows are kept once; rows without words stay."""
    names, rooted = _rooted(docs)
    best = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_id"))
    kept = best.unionByName(names.where("n = 0").select(F.col("row").alias("_id"))).distinct()
    row, mark = free_names(docs, "_row", "_id")
    kept = kept.withColumnRenamed("_id", mark)
    same = F.col(row) == F.col(mark)
    rows = docs.withColumn(row, row_name()).join(kept, same, "left_semi")
    twice = written(names.groupBy("row").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("row").alias(mark)), "twice")
    if twice.isEmpty():
        return rows.drop(row)
    return rows.join(twice, same, "left_anti").unionByName(rows.join(twice, same, "left_semi").dropDuplicates([row])).drop(row)
