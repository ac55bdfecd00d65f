"""Jaccard self-join of sets of word n-grams by prefix trees.

1. Every text becomes a set of fingerprints of n-grams.  Equal sets are one
   node, named by a fingerprint of the set.
2. The global order of n-grams: those in one node only, then those in several,
   the rarest first (``MOST_COUNTED`` and more nodes are one class), then *heavy*
   ones (in a good part of the documents of some batch); by fingerprint within.
   Nodes are counted in hash buckets of compact blobs.  A node that can link must have at least the
   threshold's share of its n-grams in other nodes too; the others are done.
3. Of the rest, nodes that share an n-gram of their prefixes (the first so many
   in the order that two linking nodes must meet there) form blocks.
4. Each block's sets go into a trie along the global order.  A set traverses
   the trie of those before it, so overlaps of common beginnings are counted
   once; a subtree is left when its sizes, or what is still to come in it or in
   the set, cannot reach the threshold, or all of it is in the set's component.
   In blocks of ``TOGETHER`` sets and more all sets traverse one tree at once,
   with overlaps counted by bits: near copies that do not link must meet there.
5. Blocks above ``BLOCK_BYTES`` are cut into chunks: each chunk alone, then one
   set of every component of every chunk where these are at most ``BLOCK_BYTES``
   as well, then those pairs of chunks that still hold different components and
   sizes that can link.  Nothing is left out.

Only components are asked for, so links inside a component that is already
known are not tested.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import cut_lineage, documents, forget, freed, plan_bytes, shuffle_partitions, stored, trimmed
from .components import connected_components

#: Most n-grams that are held to be heavy (the most frequent); the bound of a broadcast.
MAX_HEAVY = 1 << 16
#: Bytes of sets that a task joins at once.
BLOCK_BYTES = 48 << 20
#: Sets of a block from which they traverse its tree together.
TOGETHER = 32
#: Bytes of postings that a task gathers before it writes blobs.
FLUSH_BYTES = 16 << 20

#: Numbers of nodes that the order tells apart.
MOST_COUNTED = 62

_STEPS = np.array([0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47, 0xA24BAED4963EE407, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def ngram_sets(batch: pa.RecordBatch, text_col: str, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct fingerprints of consecutive rows, bounds by row)."""
    for row, _, data, offsets in B.utf8_chunks(batch, text_col):
        hashes, bounds = B.word_hashes(data, offsets)
        count = np.diff(bounds)
        rows = len(count)
        doc = np.repeat(np.arange(rows), count)
        place = np.arange(len(hashes)) - np.repeat(bounds[:-1], count)
        if len(hashes) >= words:
            grams = sum((B.mix64(hashes[k : len(hashes) - words + 1 + k] + _STEPS[k]) * _STEPS[k] for k in range(1, words)), B.mix64(hashes[: len(hashes) - words + 1] + _STEPS[0]) * _STEPS[0])
            full = np.flatnonzero(place[: len(grams)] + words <= count[doc[: len(grams)]])
            grams, owner = B.mix64(grams[full]), doc[full]
        else:
            grams, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < words))
        if len(short):
            whole = [B.mix64(np.array([sum(int(B.mix64(hashes[bounds[d] + k : bounds[d] + k + 1] + _STEPS[k])[0]) * int(_STEPS[k]) for k in range(count[d])) + int(count[d]) & (1 << 64) - 1], np.uint64))[0] for d in short.tolist()]
            grams, owner = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([owner, short])
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        keep = np.ones(len(grams), bool)
        keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[keep], owner[keep]
        yield row, grams, np.searchsorted(owner, np.arange(rows + 1))


def _set_names(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A fingerprint of each set (0 for empty ones)."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        sums = np.add.reduceat(B.mix64(grams ^ _STEPS[5]), bounds[:-1][full])
        out[full] = B.mix64(sums + np.diff(bounds)[full].astype(np.uint64) * _STEPS[6])
    return out


def _heavy(words: int):
    """N-grams in a good part of the documents of a batch."""

    def find(batches):
        for batch in batches:
            for _, grams, bounds in ngram_sets(batch, "text", words):
                found, n = np.unique(grams, return_counts=True)
                often = n >= max(16, (len(bounds) - 1) // 50)
                yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["gram", "n"])

    return find


def _is_heavy(grams: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.zeros(len(grams), bool)
    return heavy[np.minimum(np.searchsorted(heavy, grams), len(heavy) - 1)] == grams


def _nodes(words: int, heavy):
    def describe(batches):
        for batch in batches:
            for row, grams, bounds in ngram_sets(batch, "text", words):
                many = np.concatenate([[0], np.cumsum(_is_heavy(grams, heavy.value))])
                n, names = np.diff(bounds), _set_names(grams, bounds).view(np.int64)
                ids = batch.column(0).slice(row, len(n))
                keys = batch.column(batch.schema.get_field_index("key")).slice(row, len(n))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(names, mask=n == 0), pa.array((many[bounds[1:]] - many[bounds[:-1]]).astype(np.int64)), keys], ["id", "n", "node", "n_heavy", "key"])

    return describe


def _narrow(values: np.ndarray, width: int = 6) -> bytes:
    """The lowest bytes of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(data: bytes, width: int = 6) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def _blobs(words: int, heavy, buckets: int):
    """Postings in blobs: the upper 48 bits of n-grams, and numbers into a list of nodes."""

    def write(held):
        grams = np.concatenate([g for g, _ in held])
        owner = np.concatenate([o for _, o in held])
        bucket = ((grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        grams, owner, bucket = grams[order], owner[order], bucket[order].astype(np.int64)
        used = np.unique(bucket)
        cuts = [*np.searchsorted(bucket, used).tolist(), len(bucket)]
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            nodes, index = np.unique(owner[a:b], return_inverse=True)
            small = len(nodes) < 1 << 16
            rows.append((_narrow(grams[a:b] >> np.uint64(16)), index.astype("<u2" if small else "<u4").tobytes(), nodes.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(3))], ["bucket", "grams", "owners", "nodes"])

    def gather(batches):
        held, size, seen = [], 0, set()
        for batch in batches:
            for _, grams, bounds in ngram_sets(batch, "text", words):
                names = _set_names(grams, bounds)
                new = np.zeros(len(names), bool)
                for k, name in enumerate(names.tolist()):
                    if name and name not in seen:
                        seen.add(name)
                        new[k] = True
                owner = np.repeat(names, np.diff(bounds))
                keep = np.repeat(new, np.diff(bounds)) & ~_is_heavy(grams, heavy.value)
                held.append((grams[keep], owner[keep]))
                size += 16 * len(grams)
                if size >= FLUSH_BYTES:
                    yield write(held)
                    held, size, seen = [], 0, set()
        if held:
            yield write(held)

    return gather


def _shared(parts: int):
    """N-grams that several nodes of a bucket have, packed for each range of nodes."""

    def find(table: pa.Table) -> pa.Table:
        grams, owners = [], []
        for g, o, n in zip(*(table.column(k).to_pylist() for k in ("grams", "owners", "nodes")), strict=True):
            grams.append(_wide(g))
            owners.append(np.frombuffer(n, np.uint64)[np.frombuffer(o, "<u2" if len(o) == len(g) // 3 else "<u4")])
        grams, owners = np.concatenate(grams), np.concatenate(owners)
        order = np.argsort(grams, kind="stable")
        grams, owners = grams[order], owners[order]
        same = np.zeros(len(grams) + 1, bool)
        same[1:-1] = grams[1:] == grams[:-1]
        keep = same[1:] | same[:-1]  # several postings; of one node, perhaps
        grams, owners = grams[keep], owners[keep]
        order = np.lexsort((owners, grams))
        grams, owners = grams[order], owners[order]
        first = np.ones(len(grams), bool)
        first[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
        grams, owners = grams[first], owners[first]
        same = np.zeros(len(grams) + 1, bool)
        same[1:-1] = grams[1:] == grams[:-1]
        keep = same[1:] | same[:-1]
        grams, owners = grams[keep], owners[keep]
        _, which, n = np.unique(grams, return_inverse=True, return_counts=True)
        grams = grams | np.minimum(n, MOST_COUNTED).astype(np.uint64)[which] << np.uint64(48)
        order = np.argsort(owners, kind="stable")
        packed, owners = _narrow(grams[order], 7), owners[order]
        nodes, begin = np.unique(owners, return_index=True)
        begin = np.append(begin, len(owners))
        part = ((nodes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        used, cut = np.unique(part, return_index=True)
        cuts = list(zip(cut.tolist(), [*cut[1:].tolist(), len(nodes)], strict=False))
        many = np.diff(begin).astype("<u4")
        return pa.table(
            {
                "part": pa.array(used, pa.int32()),
                "nodes": pa.array([nodes[i:j].tobytes() for i, j in cuts], pa.binary()),
                "many": pa.array([many[i:j].tobytes() for i, j in cuts], pa.binary()),
                "grams": pa.array([packed[7 * begin[i] : 7 * begin[j]] for i, j in cuts], pa.binary()),
            }
        )

    return find


def _merged(table: pa.Table) -> pa.Table:
    """(node, packed n-grams, their number) from what ``_shared`` packed for a range of nodes: upper bits, and above them the number of nodes."""
    nodes, many, grams = (np.frombuffer(b"".join(table.column(k).to_pylist()), kind) for k, kind in (("nodes", np.uint64), ("many", "<u4"), ("grams", np.uint8)))
    owners = np.repeat(nodes, many)
    packed = grams.reshape(-1, 7)[np.argsort(owners, kind="stable")].tobytes()
    names, n = np.unique(owners, return_counts=True)
    cuts = [0, *np.cumsum(n).tolist()]
    return pa.table({"node": names.view(np.int64), "shared": pa.array([packed[7 * a : 7 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), "many": n.astype(np.int64)})


def required(n: int, percent: int) -> int:
    """Least size of the other set's overlap with one of n, and so n-grams shared with anyone."""
    return -(-n * percent // 100)


def _ordered(words: int, heavy, percent: int):
    """Survivors' shared n-grams along the global order, and how many of them are in the prefix."""

    def order(batches):
        for batch in batches:
            node, n = (batch.column(batch.schema.get_field_index(k)) for k in ("node", "n"))
            known = batch.column(batch.schema.get_field_index("shared"))
            out = []
            for row, grams, bounds in ngram_sets(batch, "text", words):
                for k in range(len(bounds) - 1):
                    own = grams[bounds[k] : bounds[k + 1]]
                    often = _is_heavy(own, heavy.value)
                    rank = np.zeros(len(own), np.uint64)  # 0: in this node only
                    counted = _wide(known[row + k].as_py() or b"", 7) << np.uint64(8)
                    counted = np.sort((counted << np.uint64(8)) | (counted >> np.uint64(56)))  # upper bits first, then the number of nodes
                    if len(counted):
                        at = np.minimum(np.searchsorted(counted, own & ~np.uint64(0xFFFF)), len(counted) - 1)
                        found = counted[at] >> np.uint64(16) == own >> np.uint64(16)
                        rank[found] = counted[at[found]] & np.uint64(0xFFFF)
                    rank[often] = 64
                    line = np.sort(((rank << np.uint64(57)) | (own >> np.uint64(7)))[rank > 0])
                    prefix = len(own) - required(len(own), percent) + 1 - (len(own) - len(line))
                    out.append((line.tobytes(), line[: max(prefix, 0)].view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([node, n, pa.array([x for x, _ in out], pa.binary()), pa.array([p for _, p in out], pa.list_(pa.int64()))], ["node", "n", "line", "prefix"])

    return order


class PrefixTree:
    """Sets along one global order; finds what links to a set, component by component."""

    # a tree node: [tokens, children, sets that end here, a member, whether all below are of its component, least size, greatest size, most tokens still to come]
    def __init__(self, percent: int):
        self.percent = percent
        self.root = self._node([])
        self.parent: dict = {}

    @staticmethod
    def _node(tokens):
        return [tokens, {}, [], None, True, 1 << 60, 0, 0]

    def find(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def probe(self, name, size: int, line: list[int]) -> None:
        """Joins ``name`` with the sets in the tree that reach the threshold."""
        own, percent = set(line), self.percent
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            tokens, children, ends, member, uniform, least, most, rest = node
            if member is None or most * 100 < percent * size or least * percent > 100 * size or (uniform and self.find(member) == self.find(name)):
                continue
            overlap += sum(map(own.__contains__, tokens))
            left = len(line) - bisect_right(line, tokens[-1]) if tokens else len(line)
            # J >= p needs overlap * (100 + p) >= p * (both sizes)
            if (overlap + min(rest, left)) * (100 + percent) < percent * (size + max(least, -(-percent * size // 100))):
                continue
            for other, n in ends:
                if overlap * (100 + percent) >= percent * (size + n):
                    self.join(name, other)
            stack.extend((child, overlap) for child in children.values())

    def insert(self, name, size: int, line: list[int]) -> None:
        node, at = self.root, 0
        while True:
            if node[3] is None:
                node[3] = name
            elif node[4] and self.find(node[3]) != self.find(name):
                node[4] = False
            node[5], node[6], node[7] = min(node[5], size), max(node[6], size), max(node[7], len(line) - at)
            if at == len(line):
                node[2].append((name, size))
                return
            child = node[1].get(line[at])
            if child is None:
                child = node[1][line[at]] = self._node(line[at:])
            tokens, k = child[0], 1
            while k < len(tokens) and at + k < len(line) and tokens[k] == line[at + k]:
                k += 1
            if k < len(tokens):  # the ways part inside this child
                upper = [tokens[:k], {tokens[k]: child}, [], child[3], child[4], child[5], child[6], child[7] + len(tokens) - k]
                child[0] = tokens[k:]
                node[1][line[at]] = child = upper
            node, at = child, at + k

    def add(self, name, size: int, line: list[int]) -> None:
        self.parent[name] = name
        self.probe(name, size, line)
        self.insert(name, size, line)


class SharedTree:
    """The tree of all sets of a block, which all of them traverse at once; a pair meets where the lesser one is in the tree.

    Sets go by size, tokens by the global order.  The tree is not stored: the sets
    below a node are neighbours in the order of their lines, ``common`` the number
    of tokens that each begins with like the one before it.
    """

    def __init__(self, percent: int, sizes: np.ndarray, lines: list[np.ndarray]):
        self.percent, self.sizes = percent, sizes
        self.many = np.array([len(x) for x in lines], np.int64)
        ends = np.cumsum(self.many)
        tokens = np.unique(np.concatenate(lines), return_inverse=True)[1]
        self.lines = np.split(tokens, ends[:-1])
        self.order = np.array(sorted(range(len(lines)), key=lambda k: lines[k].astype(">u8").tobytes()), np.int64)
        self.common = np.zeros(len(lines), np.int64)
        for k in range(1, len(lines)):
            a, b = self.lines[self.order[k - 1]], self.lines[self.order[k]]
            least = min(len(a), len(b))
            other = a[:least] != b[:least]
            self.common[k] = int(other.argmax()) if other.any() else least
        # tokens of a 64th of the sets and more as bits, the most frequent first; postings of the others: neither takes more than the lines
        owner = np.repeat(np.arange(len(lines)), self.many)
        often = np.bincount(tokens)
        dense = np.flatnonzero(often * 64 >= len(lines))
        dense = dense[np.argsort(-often[dense], kind="stable")]
        self.rank = np.full(len(often), -1, np.int64)
        self.rank[dense] = np.arange(len(dense))
        rank = self.rank[tokens]
        as_bits = rank >= 0
        self.bits = np.zeros((-(-len(dense) // 64), len(lines)), np.uint64)
        np.bitwise_or.at(self.bits, (rank[as_bits] >> 6, owner[as_bits]), np.uint64(1) << (rank[as_bits] & 63).astype(np.uint64))
        few = np.flatnonzero(~as_bits)
        few = few[np.argsort(tokens[few], kind="stable")]
        self.owners = owner[few]
        self.begin = np.searchsorted(tokens[few], np.arange(len(often) + 1))

    def overlaps(self, tokens: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """How many of the tokens each of the sets has."""
        out, rank = np.zeros(len(sets), np.int64), self.rank[tokens]
        bits = rank[rank >= 0]
        masks = np.zeros(len(self.bits), np.uint64)
        np.bitwise_or.at(masks, bits >> 6, np.uint64(1) << (bits & 63).astype(np.uint64))
        rows = np.flatnonzero(masks)
        for k in range(0, len(rows), 32):
            at = rows[k : k + 32]
            out += np.bitwise_count(self.bits[at[:, None], sets] & masks[at][:, None]).sum(0, dtype=np.int64)
        few = tokens[rank < 0]
        if len(few):
            owners = np.concatenate([self.owners[self.begin[t] : self.begin[t + 1]] for t in few.tolist()])
            out += np.bincount(owners, minlength=len(self.sizes))[sets]
        return out

    def components(self) -> np.ndarray:
        """The component of each set, one of its sets."""
        percent, sizes, many = self.percent, self.sizes, self.many
        of = np.arange(len(sizes))
        stack = [(0, len(sizes), 0, of.copy(), np.zeros(len(sizes), np.int64))]
        while stack:
            a, b, depth, sets, overlap = stack.pop()
            below = self.order[a:b]
            n, least, rest = sizes[sets], int(sizes[below].min()), int(many[below].max()) - depth
            stay = (sets > below.min()) & (int(sizes[below].max()) * 100 >= percent * n)
            if (of[below] == of[below[0]]).all():
                stay &= of[sets] != of[below[0]]
            # J >= p needs overlap * (100 + p) >= p * (both sizes)
            stay &= (overlap + np.minimum(rest, many[sets] - overlap)) * (100 + percent) >= percent * (n + np.maximum(least, -(-percent * n // 100)))
            sets, overlap = sets[stay], overlap[stay]
            if not len(sets):
                continue
            stop = int(self.common[a + 1 : b].min()) if b - a > 1 else int(many[below[0]])
            if stop > depth:
                overlap = overlap + self.overlaps(self.lines[below[0]][depth:stop], sets)
            while a < b and many[self.order[a]] == stop:  # sets that end here
                one = self.order[a]
                linked = sets[(sets > one) & (overlap * (100 + percent) >= percent * (sizes[sets] + sizes[one]))]
                found = np.unique(of[np.append(linked, one)])
                if len(found) > 1:
                    of[np.isin(of, found)] = found[0]
                a += 1
            cuts = [a, *(np.flatnonzero(self.common[a + 1 : b] == stop) + a + 1).tolist(), b] if a < b else []
            stack.extend((i, j, stop, sets, overlap) for i, j in zip(cuts[:-1], cuts[1:], strict=True))
        return of


def _join_block(percent: int):
    def join(table: pa.Table) -> pa.Table:
        sizes, names = table.column("n").to_pylist(), table.column("node").to_pylist()
        lines = table.column("line").combine_chunks()
        by_size = sorted(range(len(names)), key=lambda k: (sizes[k], names[k]))
        if len(names) >= TOGETHER:
            once = list({names[k]: k for k in reversed(by_size)}.values())[::-1]
            of = SharedTree(percent, np.array([sizes[k] for k in once], np.int64), [np.frombuffer(lines[k].as_py(), np.uint64) for k in once]).components()
            own = np.array([names[k] for k in once], np.int64)
            least = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(least, of, own)
            return pa.table({"a": own, "b": least[of]})
        tree = PrefixTree(percent)
        for k in by_size:
            if names[k] not in tree.parent:
                tree.add(names[k], sizes[k], np.frombuffer(lines[k].as_py(), np.uint64).tolist())
        return pa.table({"a": pa.array(names, pa.int64()), "b": pa.array([tree.find(x) for x in names], pa.int64())})

    return join


def _large_blocks(sets: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Links (a, b) that give the components of blocks too large for one task."""
    per = Window.partitionBy("block").orderBy("least_n")
    class_of = F.floor(F.log(F.greatest("n", F.lit(1))) * 16).cast("int")
    cells = F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    # chunks: size classes, each cut by hash into cells of at most about block_bytes
    classes = sets.withColumn("class", class_of).groupBy("block", "class").agg(F.sum(F.octet_length("line") + 64).alias("bytes"), F.min("n").alias("least_n"))
    classes = classes.withColumn("cells", F.ceil(F.col("bytes") * 4 / block_bytes).cast("long")).withColumn("first", F.sum("cells").over(per) - F.col("cells"))
    chunked = cut_lineage(
        sets.withColumn("class", class_of)
        .join(classes.select("block", "class", "cells", "first"), ["block", "class"])
        .withColumn("chunk", F.col("first") + F.pmod(cells, F.col("cells")))
        .select("block", "chunk", "node", "n", "line")
    )
    inside = cut_lineage(chunked.groupBy("block", "chunk").applyInArrow(_join_block(percent), "a long, b long"))
    pivots = inside.groupBy("b").agg(F.min("a").alias("node")).select("node")
    pivots = chunked.join(pivots, "node")
    fits = pivots.groupBy("block").agg(F.sum(F.octet_length("line") + 64).alias("bytes")).where(F.col("bytes") <= block_bytes).select("block")
    across = cut_lineage(pivots.join(fits, "block").groupBy("block").applyInArrow(_join_block(percent), "a long, b long"))
    links = inside.union(across)
    now = connected_components(links)
    labelled = chunked.join(now, "node")
    chunks = labelled.groupBy("block", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    other = chunks.select("block", *[F.col(c).alias(f"{c}_2") for c in ("chunk", "low", "high", "c0", "c1")])
    pairs = chunks.join(other, "block").where("chunk < chunk_2 AND (c0 != c1 OR c0_2 != c1_2 OR c0 != c0_2)").where((F.col("high") * 100 >= F.col("low_2") * percent) & (F.col("high_2") * 100 >= F.col("low") * percent))
    pairs = cut_lineage(pairs.select("block", "chunk", "chunk_2"))
    ends = pairs.select("block", "chunk", F.struct("chunk", "chunk_2").alias("pair")).union(pairs.select("block", F.col("chunk_2").alias("chunk"), F.struct("chunk", "chunk_2").alias("pair")))
    rest = chunked.join(ends, ["block", "chunk"]).groupBy("block", "pair").applyInArrow(_join_block(percent), "a long, b long")
    return links.union(rest)


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Words are maximal runs of bytes but space and \\t to \\r, A-Z in lower case.
    Texts link when their n-gram sets have a Jaccard similarity of ``percent``
    in 100 or more.  With fewer words than ``words`` the whole sequence is the
    one n-gram.  Null, empty and blank texts have no n-grams and link with
    nothing; their component is their id.  Rows with equal sets link.  A null
    id is never the smallest, unless all are null; rows without an id link and
    bridge others like any.  Repeated rows are linked rows.  Texts of any length
    are read whole; other columns are not read.  An empty table gives no rows.
    """
    if not 1 <= words <= 8 or not 50 < percent <= 100:
        raise ValueError("1 to 8 words, and over 50 percent")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = min(max(shuffle_partitions(spark), plan_bytes(texts) // (64 << 20)), 1 << 20)  # a plan of unknown size is estimated at the most there is
    often = texts.select("text").mapInArrow(freed(_heavy(words)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(MAX_HEAVY)
    heavy = spark.sparkContext.broadcast(np.sort(often.toPandas()["gram"].to_numpy(np.int64).view(np.uint64)))

    kind = texts.schema["id"].dataType.simpleString()
    rows = stored(texts.withColumn("key", F.when(F.col("id").isNull(), F.xxhash64("text"))).mapInArrow(freed(_nodes(words, heavy)), f"id {kind}, n long, node long, n_heavy long, key long"))
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max("n_heavy").alias("n_heavy"), F.min("key").alias("key"))
    postings = texts.select("text").mapInArrow(freed(_blobs(words, heavy, 2 * parts)), "bucket int, grams binary, owners binary, nodes binary")
    packed = postings.groupBy("bucket").applyInArrow(trimmed(_shared(parts)), "part int, nodes binary, many binary, grams binary")
    shared = packed.groupBy("part").applyInArrow(_merged, "node long, shared binary, many long")
    least = F.ceil(F.col("n") * percent / 100)
    survivors = stored(nodes.join(shared, "node", "left").where(F.coalesce("many", F.lit(0)) + F.col("n_heavy") >= F.greatest(least, F.lit(1))))
    with_text = survivors.where("rep IS NOT NULL").join(texts.where("id IS NOT NULL").withColumnRenamed("id", "rep"), "rep").select("node", "n", "shared", "text")
    # sets that only rows without an id have: one text for each, found by its hash
    nameless = texts.where("id IS NULL").groupBy(F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"))
    with_text = with_text.unionByName(survivors.where("rep IS NULL").join(nameless, "key").select("node", "n", "shared", "text"))
    sets = stored(_of_node(with_text, words).mapInArrow(freed(_ordered(words, heavy, percent)), "node long, n long, line binary, prefix array<long>").dropDuplicates(["node"]))
    forget(survivors)
    meet = sets.select("node", F.explode("prefix").alias("gram"))
    stars = meet.join(meet.groupBy("gram").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("k")).where("k > 1"), "gram").where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    blocks = connected_components(stars)
    sets = sets.drop("prefix").join(blocks.select("node", F.col("component").alias("block")), "node")
    large = cut_lineage(sets.groupBy("block").agg(F.sum(F.octet_length("line") + 64).alias("bytes")).where(F.col("bytes") > block_bytes).select("block"))
    if large.isEmpty():
        links = sets.groupBy("block").applyInArrow(_join_block(percent), "a long, b long")
    else:
        sets = cut_lineage(sets)
        small = sets.join(large, "block", "left_anti").groupBy("block").applyInArrow(_join_block(percent), "a long, b long")
        links = small.union(_large_blocks(sets.join(large, "block", "left_semi"), percent, block_bytes))
    found = connected_components(links)
    by_node = nodes.select("node", "rep").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = by_node.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = by_node.join(smallest, "component").where("NOT (component_id <=> rep) OR component != node").select("node", "component_id")
    first = nodes.select("node", "rep").join(linked, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    return rows.join(first, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _of_node(with_text: DataFrame, words: int) -> DataFrame:
    """Only rows whose text has the node's set: an id may repeat with other texts."""

    def check(batches):
        for batch in batches:
            node = np.asarray(batch.column(0))
            fits = np.zeros(batch.num_rows, bool)
            for row, grams, bounds in ngram_sets(batch, "text", words):
                fits[row : row + len(bounds) - 1] = _set_names(grams, bounds).view(np.int64) == node[row : row + len(bounds) - 1]
            yield batch.filter(pa.array(fits))

    return with_text.mapInArrow(freed(check), with_text.schema)


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(g) AS n_shingles, component_id FROM s JOIN c ON c.node = s.doc_id
"""
