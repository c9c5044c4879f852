"""Near-duplicates: exact links of word shingle sets, found by chosen-path set similarity join.

Two documents are linked if the Jaccard similarity of their shingle sets reaches a
threshold; a component is what links reach.  Steps:

1. Each text becomes its set of hashed shingles, a 128-bit digest of the set and a
   signature of ``HASHES`` minwise values.  Equal sets fall into one class (combined
   before the shuffle), so groups of copies cost one row from here on.
2. Chosen paths: in each of ``TREES`` independent trees, a class extends a path by
   those of its minwise tokens that a hash of (path, token) selects, 1 / threshold of
   them on average.  Classes that share a path are a node.  Nodes of up to ``NODE``
   classes compare all their signatures (four bits of each value); larger ones go by
   pivots, and what these leave open extends its paths further (see ``families``) until
   ``DEPTH``, where it is compared in tiles.  Classes whose paths are extended get
   ``DEEP_TREES`` trees.
3. Pairs whose signatures agree well (``CUT``) join classes to *families* by connected
   components.  A family holds every link of its members; it may hold more.
4. Links are confirmed on full sets inside families, in blocks of about ``BLOCK``
   classes and ``SHINGLES`` shingles; all blocks of a large family also get the same
   ``ANCHORS`` members.  A block looks for links until it knows that no two of its
   components are linked: members outside its largest component are compared with all
   others.
5. Large families: what the anchors did not join into the family's main component is
   compared with all of the family, so no link is lost by the blocking: first by
   signatures in tiles, then on the full sets of the blocks that hold a likely partner.
6. Connected components of the confirmed links give the result.

Recall.  A linked pair is lost only if no tree brings it together or its signatures
disagree by chance.  By calculation for Jaccard .80, with the spread of the agreement of
``HASHES`` values (which all trees share) and ``CUT`` counted, a pair is missed 2.3 times
in 100,000 at length two and at most 3.5 times if all its nodes are extended to
``DEPTH``; ``tests/llm`` measures it.

Memory.  A task holds one group at a time: ``NODE`` classes, a tile of ``TILE`` by
``TILE`` signatures, or ``BLOCK`` texts and as many that ask.  Inside a group links go to
a forest, so a group writes fewer links than it has members and never its pairs.  What a
large node or family leaves open, k of n members, is sent n * k / ``TILE`` * 2 times as
signatures of 32 bytes, so the cost of a huge group of texts that are alike but not
linked grows with its square, divided by ``TILE``.  Texts are shuffled for members of
families only, by a bitmap of 32 bits for each member up to ``BITS`` in all; beyond
33 million members it also lets others pass (3 % of them at 33 million, 61 % at a
billion), which costs shuffling and changes no result.

Defined results: words are runs without space, tab or line breaks, A-Z lower-cased;
a text of fewer words than a shingle is one shingle; null text or text without words
has an empty set and is linked with nothing; rows that share an id are one document,
so different texts under one id are linked; a null id takes no part (component null,
kept); ids are whole numbers; an empty table gives an empty one; other columns do not
matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textspark.llm.common import cut, delete, map_batches
from textspark.llm.graph import connected_components

SHINGLE, PERCENT = 5, 80
HASHES, TREES, NODE, DEPTH = 64, 18, 160, 7
#: Trees of the classes in nodes whose paths are extended beyond length two.
DEEP_TREES = 80
CUT = 0.55
BLOCK, ANCHORS, SHINGLES = 400, 16, 4_000_000
#: Signatures on each side of a tile.
TILE = 4096
#: Largest bitmap of member ids (128 MB); nodes of a forest before it is written.
BITS, FOREST = 1 << 30, 500_000
WORDS = 100_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Sets of hashed shingles; keeps the hashes of words it has seen."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        known, k = self.known, self.k
        if len(known) > WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(k, len(words))
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ ids[i : len(words) - k + 1 + i]) * _MIX
            out ^= out >> np.uint64(32)
        return np.unique(out)


_RNG = np.random.default_rng(20)
_A = (_RNG.integers(1, 1 << 62, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The signature: for each hash function, the smallest value over the set, cut to 32 bits."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        part = shingles[k : k + 2048]
        for j in range(0, HASHES, 16):
            least[j : j + 16] = np.minimum(least[j : j + 16], ((part[None, :] ^ _B[j : j + 16, None]) * _A[j : j + 16, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def _blend(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACE = np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def extend(paths: np.ndarray, signatures: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Longer paths of each row: (row, path)."""
    found_rows, found = [], []
    most = np.uint64(int(share / HASHES * 2.0**64))
    for k in range(0, len(paths), 20_000):
        tokens = signatures[k : k + 20_000].astype(np.uint64) + _PLACE
        longer = _blend(tokens * _MIX ^ paths[k : k + 20_000, None])
        at, place = np.nonzero(_blend(longer) < most)
        found_rows.append(at + k)
        found.append(longer[at, place])
    return np.concatenate(found_rows) if found else np.zeros(0, int), np.concatenate(found) if found else np.zeros(0, np.uint64)


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def signed(documents: DataFrame, id: str, text: str, k: int) -> DataFrame:
    """doc_id, n_shingles, key (digest of the set), signature; the last two are null for an empty set."""

    def make():
        shingles = Shingles(k)

        def run(batch: pa.RecordBatch) -> list:
            n, key, sig = [], [], []
            for t in batch.column(batch.schema.get_field_index("_t")).to_pylist():
                s = shingles(t or "")
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(minwise(s).tobytes() if len(s) else None)
            return [n, key, sig]

        return run

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("signature", T.BinaryType())]
    return map_batches(documents.select(F.col(id).alias("doc_id"), F.col(text).alias("_t")), make, fields, keep=["doc_id"])


class Forest:
    """Union-find; remembers the links that joined something."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def top(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int, link: tuple[int, int] | None = None) -> bool:
        x, y = self.top(x), self.top(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.links.append(link or (x, y))
        return True


def joined(edges: DataFrame) -> DataFrame:
    """node, component of edges (a, b).

    Each task first reduces about ``FOREST`` edges to stars; the distributed rounds join
    the stars of all tasks, whatever their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(a, b)
            if len(forest.up) > FOREST:
                yield _links([(x, forest.top(x)) for x in list(forest.up)])
                forest = Forest()
        yield _links([(x, forest.top(x)) for x in list(forest.up)])

    tasks = max(1, -(-edges.count() // FOREST))
    stars = cut(edges.select("a", "b").coalesce(tasks).mapInArrow(run, "a bigint, b bigint"))
    return cut(connected_components(stars, "a", "b").distinct(), stars)


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return _batch(["a", "b"], pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64()))


def _first_paths(classes: DataFrame, share: float, trees: range) -> DataFrame:
    """(node, rep): paths of length two in each of the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            reps, sigs = batch.column(0).to_numpy(), _sigs(batch.column(1))
            for tree in trees:
                root = np.full(len(reps), _blend(np.array([tree + 1], np.uint64))[0], np.uint64)
                rows, paths = extend(root, sigs, share)
                again, paths = extend(paths, sigs[rows], share)
                yield _batch(["node", "rep"], paths.view(np.int64), reps[rows[again]])

    return classes.select("rep", "signature").mapInArrow(run, "node bigint, rep bigint")


def _longer_paths(rows: DataFrame, classes: DataFrame, share: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, paths = extend(batch.column(0).to_numpy().view(np.uint64), _sigs(batch.column(2)), share)
            yield _batch(["node", "rep"], paths.view(np.int64), batch.column(1).to_numpy()[at])

    return rows.join(classes.select("rep", "signature"), "rep").select("node", "rep", "signature").mapInArrow(run, "node bigint, rep bigint")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal leading columns in sorted batches, one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(values[:, a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def packed(signatures: np.ndarray) -> np.ndarray:
    """Four bits of each minwise value, two values to a byte."""
    low = signatures.astype(np.uint8) & 15
    return low[:, ::2] | low[:, 1::2] << 4


def agree(some: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Whether packed signatures agree with another in a share of at least ``CUT`` of their values."""
    x = some ^ one
    return ((x & 15 == 0).sum(axis=-1) + (x & 240 == 0).sum(axis=-1)) >= CUT * HASHES


def _shorts(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES // 2)


def _alike(rows: DataFrame) -> DataFrame:
    """Edges (a, b) between classes of one node whose signatures agree; each class to the first of its kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: set[tuple[int, int]] = set()
        for batch_group in groups(batches, 1):
            reps = batch_group.column("rep").to_numpy()
            if len(reps) < 2:
                continue
            sig = _shorts(batch_group.column("short"))
            left = np.arange(len(reps))
            while len(left) > 1:
                queue, members = [left[0]], [left[0]]
                left = left[1:]
                while queue and len(left):
                    near = agree(sig[left], sig[queue.pop()])
                    queue += left[near].tolist()
                    members += left[near].tolist()
                    left = left[~near]
                if len(members) > 1:
                    ids = reps[members]
                    low = int(ids.min())
                    edges.update((int(x), low) for x in ids if x != low)
            if len(edges) > FOREST:
                yield _links(list(edges))
                edges = set()
        if edges:
            yield _links(list(edges))

    return rows.select("node", "rep", "short").repartition("node").sortWithinPartitions("node").mapInArrow(run, "a bigint, b bigint").distinct()


def _near_pivot(rows: DataFrame) -> DataFrame:
    """Edges (a, b) from classes to the pivot of their node, where the signatures agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: set[tuple[int, int]] = set()
        for batch in batches:
            if batch.num_rows:
                near = np.flatnonzero(agree(_shorts(batch.column("short")), _shorts(batch.column("pivot_short"))))
                edges.update((a, b) for a, b in zip(batch.column("rep").to_numpy()[near].tolist(), batch.column("pivot").to_numpy()[near].tolist()) if a != b)
            if len(edges) > FOREST:
                yield _links(list(edges))
                edges = set()
        if edges:
            yield _links(list(edges))

    return rows.select("rep", "pivot", "short", "pivot_short").mapInArrow(run, "a bigint, b bigint")


def _tiles(known: DataFrame, open_: DataFrame, group: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (group, own, other, role, ...) in which each open row meets all known rows of its group.

    ``known`` holds (group, n) and ``open_`` (group, n, k): so many rows of the group are
    known and open.  Both sides are dealt to tiles of about ``TILE`` rows and sent to the
    tiles of the other side, so a tile is bounded however large the group is.
    """
    deal = lambda count: F.pmod(F.xxhash64("rep", F.lit(7)), F.ceil(F.col(count) / TILE)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(count) / TILE) - 1).cast("int")))
    columns = [group, "rep", "part", "short", *extra]
    own = known.select(*columns, deal("n").alias("own"), every("k").alias("other"), F.lit(0).alias("role"))
    ask = open_.select(*columns, deal("k").alias("other"), every("n").alias("own"), F.lit(1).alias("role"))
    return own.unionByName(ask).select(group, "own", "other", "role", "rep", "part", "short", *extra).repartition(group, "own", "other").sortWithinPartitions(group, "own", "other", "role", "rep")


def _near_open(tiles: DataFrame) -> DataFrame:
    """Edges (a, b) of open rows with known ones, where the signatures agree; only those that join parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            reps, roles, parts = (group.column(c).to_numpy() for c in ("rep", "role", "part"))
            sig, forest = _shorts(group.column("short")), Forest()
            own = np.flatnonzero(roles == 0)
            for at in np.flatnonzero(roles == 1):
                for j in own[agree(sig[own], sig[at]) & (parts[own] != parts[at])]:
                    forest.join(int(parts[at]), int(parts[j]), (int(reps[at]), int(reps[j])))
            if forest.links:
                yield _links(forest.links)

    return tiles.mapInArrow(run, "a bigint, b bigint")


def families(classes: DataFrame, share: float) -> DataFrame:
    """(rep, family): classes that may be linked are in one family; others are left out.

    A large node first compares all its classes with one pivot, which differs from node
    to node; classes that are near the same pivots are one part then.  A large node that
    lies in one part is done.  If one part holds most of it, or the paths have reached
    ``DEPTH``, what is outside the largest part is compared with all of the node, in tiles;
    else its paths are extended.  Each extension loses pairs again, so classes of extended
    nodes get more trees (``DEEP_TREES``).
    """
    shorts = cut(map_batches(classes.select("rep", "signature"), lambda: lambda batch: [[s.tobytes() for s in packed(_sigs(batch.column(batch.schema.get_field_index("signature"))))]], [T.StructField("short", T.BinaryType())], keep=["rep"]))

    def compared(paths: DataFrame, edges: DataFrame | None, depth: int) -> tuple[DataFrame, DataFrame | None]:
        """The edges with those that the nodes of these paths give; (node, rep) whose paths are to be extended, if any."""
        pick = F.min(F.struct(F.xxhash64("node", "rep").alias("h"), "rep"))["rep"]
        # written tables on both sides of a join let adaptive execution split hot nodes
        sizes = cut(paths.groupBy("node").agg(F.count("*").alias("n"), pick.alias("pivot")).where("n > 1"))
        shared = cut(paths.join(sizes, "node").join(shorts, "rep"), sizes)
        near = _alike(shared.where(F.col("n") <= NODE))
        large = shared.where(F.col("n") > NODE)
        more = bool(large.limit(1).count())
        if more:
            pivots = cut(large.where("rep = pivot").groupBy("node").agg(F.min("short").alias("pivot_short")))
            near = near.unionByName(_near_pivot(large.join(pivots, "node")))
        near = cut(near)
        edges = near if edges is None else edges.unionByName(near)
        if not more:
            delete(shared)
            return edges, None
        parts = joined(edges).select(F.col("node").alias("rep"), "component")
        known = cut(large.join(parts, "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component", "pivot"), shared, pivots)
        held = known.groupBy("node", "part").agg(F.count("*").alias("m"))
        held = cut(held.groupBy("node").agg(F.count("*").alias("k"), F.max(F.struct("m", "part")).alias("top")).where("k > 1").select("node", "top.m", F.col("top.part").alias("main")))
        mixed = cut(known.join(held, "node").withColumn("k", F.col("n") - F.col("m")), known, held)
        if not mixed.limit(1).count():
            return edges, None
        last = F.lit(depth >= DEPTH) | (F.col("k") <= F.col("m"))
        most = mixed.where(last)
        edges = edges.unionByName(cut(_near_open(_tiles(most, most.where("part <> main"), "node"))))
        deeper = cut(mixed.where(~last).select("node", "rep"), mixed)
        return edges, deeper if deeper.limit(1).count() else None

    edges, deeper = compared(_first_paths(classes, share, range(TREES)), None, 2)
    if deeper is not None:
        again = classes.join(deeper.select("rep").distinct(), "rep", "left_semi")
        edges, others = compared(_first_paths(again, share, range(TREES, DEEP_TREES)), edges, 2)
        deeper = deeper if others is None else deeper.unionByName(others)
    for depth in range(3, DEPTH + 1):
        if deeper is None:
            break
        edges, deeper = compared(_longer_paths(deeper, classes, share), edges, depth)
    return joined(edges).select(F.col("node").alias("rep"), F.col("component").alias("family"))


class Block:
    """Full sets of some classes, ready for counting common shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.values, self.inverse = np.unique(np.concatenate(sets), return_inverse=True)

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Which members are linked with the set ``s``."""
        at = np.searchsorted(self.values, s)
        at[at == len(self.values)] = 0
        mark = np.zeros(len(self.values), np.int32)
        mark[at[self.values[at] == s]] = 1
        common = np.add.reduceat(mark[self.inverse], self.starts)
        return 100 * common >= percent * (self.sizes + len(s) - common)


def inside(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join what links join: after these, no two components of the sets are linked."""
    if len(sets) < 2:
        return []
    block = Block(sets)
    part = np.arange(len(sets))
    done = np.zeros(len(sets), bool)
    links = []
    while True:
        counts = np.bincount(part, minlength=len(sets))
        todo = np.flatnonzero(~done & (part != counts.argmax()))
        if not len(todo):
            return links
        i = int(todo[0])
        done[i] = True
        for j in np.flatnonzero(block.linked(sets[i], percent)):
            if part[j] != part[i]:
                links.append((i, int(j)))
                part[part == part[j]] = part[i]


def _confirmed(placed: DataFrame, k: int, percent: int, cross: bool) -> DataFrame:
    """Links (a, b) inside (family, block, sub); with ``cross``, only between rows of role 1 and of role 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for group in groups(batches, 3):
            reps, roles = group.column("rep").to_numpy(), group.column("role").to_numpy()
            if len(reps) < 2:
                continue
            if not cross:
                sets = [shingles(t or "") for t in group.column("text").to_pylist()]
                found = [(int(reps[i]), int(reps[j])) for i, j in inside(sets, percent) if reps[i] != reps[j]]
            else:
                own = np.flatnonzero(roles == 0)
                if not len(own) or len(own) == len(reps):
                    continue
                block, parts, forest = Block([shingles(t or "") for t in group.column("text").take(own).to_pylist()]), group.column("part").to_numpy(), Forest()
                for at in np.flatnonzero(roles == 1):
                    for j in own[block.linked(shingles(group.column("text")[int(at)].as_py() or ""), percent)]:
                        forest.join(int(parts[at]), int(parts[j]), (int(reps[at]), int(reps[j])))
                found = forest.links
            if found:
                yield _links(found)

    columns = ["family", "block", "sub", "rep", "role", "part", "text"]
    return placed.select(*columns).repartition("family", "block", "sub").sortWithinPartitions("family", "block", "sub", "role", "rep").mapInArrow(run, "a bigint, b bigint")


def _asks(tiles: DataFrame) -> DataFrame:
    """(family, block, rep, part): open rows, and the blocks of other parts' members whose signatures agree with theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            family, reps, roles, parts, blocks = (group.column(c).to_numpy() for c in ("family", "rep", "role", "part", "block"))
            sig = _shorts(group.column("short"))
            own = np.flatnonzero(roles == 0)
            found = [(int(b), int(reps[at]), int(parts[at])) for at in np.flatnonzero(roles == 1) for b in np.unique(blocks[own[agree(sig[own], sig[at]) & (parts[own] != parts[at])]])]
            if found:
                b, r, p = zip(*found)
                yield _batch(["family", "block", "rep", "part"], pa.array([int(family[0])] * len(b), pa.int64()), pa.array(b, pa.int32()), pa.array(r, pa.int64()), pa.array(p, pa.int64()))

    return tiles.mapInArrow(run, "family bigint, block int, rep bigint, part bigint")


def _members_only(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose rep may be a member: a bitmap of hashed ids, at most ``BITS`` bits.

    It only saves shuffling: ids that share a bit pass too, and a full bitmap lets all
    rows pass.  The bitmap is a table of pieces of 4 KB, so what is broadcast is at most
    ``BITS`` / 8 bytes.
    """
    bits = 1 << min(BITS.bit_length() - 1, max(20, (32 * members.count()).bit_length()))
    place = F.pmod(F.xxhash64("rep"), F.lit(bits))
    pieces = F.broadcast(members.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap")))
    marked = texts.withColumn("_p", place).withColumn("piece", F.bitmap_bucket_number("_p")).join(pieces, "piece")
    at = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return marked.where(F.call_function("getbit", byte, (at % 8).cast("int")) == 1).select(*texts.columns)


def links(documents: DataFrame, members: DataFrame, id: str, text: str, k: int, percent: int) -> DataFrame:
    """Confirmed links that join all linked members (rep, family, n_shingles, short) of the families."""
    sizes = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("_s"))
    sizes = cut(sizes.select("family", "n", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("_s") / SHINGLES)).cast("int").alias("blocks")))
    placed = cut(members.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), sizes)
    large = placed.where("blocks > 1")
    texts = _members_only(documents.select(F.col(id).cast("long").alias("rep"), F.col(text).alias("text")), members)
    row = lambda block, role, part, sub=F.lit(0): ("family", block.alias("block"), sub.alias("sub"), "rep", F.lit(role).alias("role"), part.cast("long").alias("part"))
    rows = placed.select(*row(F.col("block"), 0, F.lit(0)))
    has_large = bool(large.limit(1).count())
    if has_large:
        order = Window.partitionBy("family").orderBy(F.xxhash64("rep", F.lit(1)), "rep")
        anchors = large.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ANCHORS)
        to = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block")))
        rows = rows.unionByName(anchors.select(*row(to, 1, F.lit(0))))
    first = cut(_confirmed(cut(rows).join(texts, "rep"), k, percent, cross=False))
    if not has_large:
        return first
    parts = joined(first)
    known = large.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")
    known = cut(known, parts)
    main = known.groupBy("family", "part").agg(F.count("*").alias("m")).groupBy("family").agg(F.max(F.struct("m", "part")).alias("top"), F.count("*").alias("parts"))
    main = cut(main.where("parts > 1").select("family", "top.m", F.col("top.part").alias("main")))
    known = cut(known.join(main, "family").withColumn("k", F.col("n") - F.col("m")), known, main)
    if not known.limit(1).count():
        return first
    asks = cut(_asks(_tiles(known, known.where("part <> main"), "family", ("block",))).distinct())
    subs = cut(asks.groupBy("family", "block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("subs")))
    asking = asks.join(subs, ["family", "block"]).select(*row(F.col("block"), 1, F.col("part"), F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int")))
    holding = known.join(subs, ["family", "block"]).select(*row(F.col("block"), 0, F.col("part"), F.explode(F.sequence(F.lit(0), F.col("subs") - 1))))
    second = cut(_confirmed(cut(holding.unionByName(asking)).join(texts, "rep"), k, percent, cross=True), asks, subs, known)
    return first.unionByName(second)


def components(documents: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``documents``."""
    share = 100 / percent
    rows = cut(signed(documents, id, text, shingle))
    named = rows.where("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = cut(named.groupBy("key").agg(F.min("doc_id").cast("long").alias("rep"), F.first("signature").alias("signature"), F.max("n_shingles").alias("n_shingles")))
    members = families(classes, share)
    short = map_batches(classes.select("rep", "n_shingles", "signature"), lambda: lambda batch: [[s.tobytes() for s in packed(_sigs(batch.column(batch.schema.get_field_index("signature"))))]], [T.StructField("short", T.BinaryType())], keep=["rep", "n_shingles"])
    members = cut(members.join(short.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles"), F.min("short").alias("short")), "rep"), members)
    # ids with several texts: each of their classes holds the id
    several = named.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("doc_id")
    same = named.select("doc_id", "key").join(several, "doc_id").join(classes.select("key", "rep"), "key").select(F.col("doc_id").cast("long").alias("a"), F.col("rep").alias("b"))
    found = joined(links(documents, members, id, text, shingle, percent).unionByName(cut(same)))
    named = classes.select(F.col("key").alias("_key"), "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("_key", F.coalesce("component", "rep").alias("component_id"))
    # rows without a set are spread over the partitions of the join by their id
    place = F.coalesce("key", F.col("doc_id").cast("string").cast("binary"))
    out = rows.select("doc_id", "n_shingles", "key", place.alias("_key")).join(cut(named), "_key", "left")
    component = F.coalesce(F.when(F.col("key").isNotNull(), F.col("component_id")), F.col("doc_id").cast("long"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
