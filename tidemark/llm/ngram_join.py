"""Near duplicates by an exact Jaccard join of word shingles: a grouped prefix join.

Two documents link when the Jaccard similarity of their shingle sets is ``percent`` / 100 or
more. The steps, none of which lets the rows of a key grow into pairs:

1. One pass makes the size and a 128-bit signature of each set, and counts the shingles that
   come first by hash in their sets, half as many again as a prefix has. Documents with equal
   sets form one class.
2. Shingles are ordered by (frequent, hash); the frequent ones come last, so that passages many
   documents share stay out of prefixes. Linking sets share a shingle among their first
   ``n - ceil(t n) + 1`` ones (the prefix) under any order. A shingle is frequent when it was
   counted ``FREQUENT`` times or more; if that holds for more than ``MOST_FREQUENT`` shingles,
   from the least count on that it holds for no more than so many, which is what is broadcast.
3. Classes with identical prefixes and size are collapsed into one group. Each prefix shingle
   lists its groups. A short list gives the pairs whose sizes are near enough. They pass if the
   shingles known to differ, from the places of those they share and then from the whole of
   both prefixes, leave enough in common.
4. A list longer than ``LONG`` is split by size, then by hash into blocks of ``BLOCK_GROUPS``
   groups at most, and blocks of near sizes are compared two by two: the number of shingles
   that two prefixes share bounds what the sets can share. What may link within a pair of
   blocks comes out as a forest, so many near copies give no more edges than there are groups.
5. Forests and surviving pairs make families. The members of a family's groups are expanded,
   their sets are made once more (only theirs: a bitmap of fixed size tells the scan), and
   packed sets of a family are compared exactly, in blocks of bounded size; a family larger than
   a block is split into pairs of blocks.
6. The verified links make the components.

Every filter only drops pairs that cannot link, so the result is that of comparing all pairs.
A scratch table is deleted as soon as the tables made from it are written.

Defined results: null and empty texts and texts without words have no shingles and link with
nothing; rows with a null id have a null component and link with nothing; rows that repeat an id
count as copies of each other if their texts are equal, and have a common component in any
case; an empty table gives an empty table; ids may be of any type that can be sorted; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shingles import shingle_sets
from .spread import bitmap, flagged, lookup, quoted, without
from .store import materialize, release, slices, trimmed

WIDTH = 4
PERCENT = 85
#: A shingle is frequent from this count on; there are so many frequent ones at most.
FREQUENT, MOST_FREQUENT = 64, 1 << 20
#: Groups of a list that are still paired with each other, and those of a block of a longer one.
LONG, BLOCK_GROUPS = 64, 512
#: Sets and shingles of one block of a family.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 19
#: Shingles that a task counts before it emits their counts.
HELD = 1 << 20


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _counted(n: int, percent: int) -> int:
    """Shingles of a set that are counted: the first ones by hash."""
    return min(n, 3 * prefix_size(n, percent) // 2 + 8)


def _signature(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _survey(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per document (key, tie, n, sig); per task and range of hashes, packed counts (part, tokens, counts) of shingles.

    There are as many ranges as scan tasks, so one holds about as many shingles as one task made.
    """
    schema = T.StructType([docs.schema["key"], *T.StructType.fromDDL("tie long, n long, sig binary, part int, tokens binary, counts binary").fields])
    bits = max(1, (docs.rdd.getNumPartitions() - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "tie", "n", "sig", "part", "tokens", "counts"]
        held, size, kind = [], 0, pa.int64()

        def counted() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            part = (tokens >> np.uint64(64 - bits)).astype(np.int32)
            cuts = np.flatnonzero(np.diff(part)) + 1
            pieces = list(zip(np.split(tokens, cuts), np.split(counts.astype(np.int32), cuts)))
            empty = [None] * len(pieces)
            columns = [pa.array(empty, kind), pa.array(empty, pa.int64()), pa.array(empty, pa.int64()), pa.array(empty, pa.binary())]
            columns += [pa.array([int(part[0]), *part[cuts].tolist()], pa.int32()), *(pa.array([p[i].tobytes() for p in pieces], pa.binary()) for i in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in slices(batches):
            kind = batch.schema.field(0).type
            n, sig = [], []
            for values in shingle_sets(batch.column(2), width):
                n.append(len(values))
                sig.append(_signature(values) if len(values) else None)
                held.append(values[: _counted(len(values), percent)].copy())
                size += len(held[-1])
            nothing, empty = pa.array([None] * len(n), pa.int32()), pa.array([None] * len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), nothing, empty, empty], names=names)
            if size >= HELD:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    return docs.mapInArrow(trimmed(run), schema)


def _frequent(packed: DataFrame) -> np.ndarray:
    """The frequent shingles of ``packed`` (part, tokens, counts), sorted; ``MOST_FREQUENT`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tokens, counts = None, [], []

        def close() -> pa.RecordBatch:
            names, at = np.unique(np.concatenate(tokens), return_inverse=True)
            sums = np.bincount(at, np.concatenate(counts), len(names)).astype(np.int64)
            often = sums >= FREQUENT
            return pa.RecordBatch.from_arrays([pa.array(names[often]), pa.array(sums[often])], names=["token", "count"])

        for batch in batches:
            for at, some, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if at != part and tokens:
                    yield close()
                    tokens, counts = [], []
                part = at
                tokens.append(np.frombuffer(some.as_buffer(), np.int64).copy())
                counts.append(np.frombuffer(n.as_buffer(), np.int32).copy())
        if tokens:
            yield close()

    often = materialize(packed.select("part", "tokens", "counts").repartition("part").sortWithinPartitions("part").mapInArrow(trimmed(run), "token long, count long"), "ngram-often")
    # shingles by count; different counts are few, since they add up to the number of all counted shingles at most
    held = sorted(often.groupBy("count").agg(F.count("*")).collect(), reverse=True)
    fits = np.cumsum([tokens for _, tokens in held]) <= MOST_FREQUENT
    least = min((count for (count, _), fit in zip(held, fits) if fit), default=None)
    found = often.filter(F.col("count") >= least if least is not None else F.lit(False)).select("token").toArrow()
    release(often)
    return np.sort(np.asarray(found.column(0).combine_chunks().to_numpy(zero_copy_only=False), np.int64).view(np.uint64))


def _ordered_prefix(values: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a set sorted by hash: its shingles in global order, the top bit marking frequent ones."""
    size = prefix_size(len(values), percent)

    def split(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(frequent):
            return part, part[:0]
        at = np.minimum(np.searchsorted(frequent, part), len(frequent) - 1)
        often = frequent[at] == part
        return part[~often], part[often]

    rare, often = split(values[: _counted(len(values), percent)])
    if len(rare) < size:
        rare, often = split(values)
    top = np.uint64(1 << 63)
    return np.concatenate([rare[:size] >> np.uint64(1), often[: max(0, size - len(rare))] >> np.uint64(1) | top])


def _prefixes(docs: DataFrame, width: int, percent: int, frequent) -> DataFrame:
    """(sig, n, gid, prefix, short) of the sets: their prefix, its leading 16 bits, and a hash of prefix and size; each set once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = frequent.value, set()
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        for batch in slices(batches):
            rows = []
            for values in shingle_sets(batch.column(0), width):
                sig = _signature(values)
                if not len(values) or sig in seen:
                    continue
                seen.add(sig)
                prefix = _ordered_prefix(values, table, percent)
                data = prefix.tobytes()
                gid = hashlib.blake2b(data + len(values).to_bytes(8, "little"), digest_size=8).digest()
                rows.append((sig, len(values), int.from_bytes(gid, "little", signed=True), data, (prefix >> np.uint64(48)).astype(np.uint16).tobytes()))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["sig", "n", "gid", "prefix", "short"])

    return docs.select("text").mapInArrow(trimmed(run), "sig binary, n long, gid long, prefix binary, short binary")


def _entries(groups: DataFrame, frequent: bool) -> DataFrame:
    """(token, gid, n, place) of each prefix shingle of each group, either of the frequent ones or of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            gid, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = [np.frombuffer(value.as_buffer(), np.int64) for value in batch.column(2)]
            sizes = np.array([len(p) for p in parts], np.int64)
            tokens = np.concatenate(parts) if parts else np.empty(0, np.int64)
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = (tokens < 0) == frequent
            columns = (tokens, np.repeat(gid, sizes), np.repeat(n, sizes).astype(np.int32), place.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["token", "gid", "n", "place"])

    return groups.select("gid", "n", "prefix").mapInArrow(trimmed(run), "token long, gid long, n int, place int")


def _list_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, i, j) of short lists; the entries (token, a, na) of long ones as they are."""
    sorted_ = entries.repartition("token").sortWithinPartitions("token", "n", "gid")
    names = ["token", "a", "b", "na", "nb", "i", "j"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple] = []
        token, members = None, []  # the list being read; none of a long one is held
        long = False

        def close() -> None:
            if not long:
                for y in range(1, len(members)):
                    g, n, place = members[y]
                    for x in range(y - 1, -1, -1):
                        h, m, other = members[x]
                        if 100 * m < percent * n:
                            break
                        pairs.append((None, g, h, n, m, place, other) if g > h else (None, h, g, m, n, other, place))

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*pairs)) or [[]] * 7, kinds)], names=names)

        for batch in batches:
            tokens = batch.column(0).to_numpy()
            if not len(tokens):
                continue
            # lists of one are skipped without looking at them, except at the ends of a batch
            alone = np.ones(len(tokens), bool)
            same = tokens[1:] == tokens[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
            alone[0] = alone[-1] = False
            keep = np.flatnonzero(~alone)
            columns = [batch.column(c).to_numpy()[keep].tolist() for c in range(4)]
            for t, gid, n, place in zip(*columns):
                if t != token:
                    close()
                    token, members, long = t, [], False
                members.append((gid, n, place))
                if long or len(members) > LONG:
                    long = True
                    pairs.extend((t, g, None, m, None, None, None) for g, m, _ in members)
                    members = []
                if len(pairs) >= 1 << 16:
                    yield emit()
                    pairs.clear()
            if len(pairs) >= 1 << 16:
                yield emit()
                pairs.clear()
        close()
        yield emit()

    return sorted_.mapInArrow(trimmed(run), "token long, a long, b long, na int, nb int, i int, j int")


def _differ_little(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, pa, pb) whose prefixes leave the similarity within reach.

    Up to the smaller end of both prefixes all shingles of both sets are known, so the ones
    that only one has count against the pair. Prefixes are compared by their leading 16 bits:
    values that only look equal let a pair pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            keep = []
            for na, nb, left, right in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5))):
                x, y = np.frombuffer(left, np.uint16), np.frombuffer(right, np.uint16)
                end = min(x[-1], y[-1])
                x, y = x[: np.searchsorted(x, end)].tolist(), y[: np.searchsorted(y, end)].tolist()
                xs, ys = set(x), set(y)
                apart = sum(v not in ys for v in x) + sum(v not in xs for v in y)
                keep.append(apart <= na + nb - 2 * -(-percent * (na + nb) // (100 + percent)))
            found = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(1)], names=["a", "b"])

    return pairs.mapInArrow(trimmed(run), "a long, b long")


def _spread_lists(entries: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(block, side, gid, n, short): the entries (token, gid, n) of long lists dealt out to the pairs of blocks they belong to.

    Sets that link have sizes in the same or in neighbouring classes, a class being a step of
    slightly more than the threshold allows. Side 2 is a block with itself, 0 and 1 are the two of a pair.
    """
    step = log(100 / max(percent - 1, 1))
    entries = entries.withColumn("size", F.floor(F.log("n") / step).cast("int"))
    counts = materialize(entries.groupBy("token", "size").agg(F.count("*").alias("c")).withColumn("parts", F.ceil(F.col("c") / BLOCK_GROUPS).cast("int")), "ngram-counts")
    above = counts.select("token", (F.col("size") - 1).alias("size"), F.col("parts").alias("up"))
    below = counts.select("token", (F.col("size") + 1).alias("size"), F.col("parts").alias("down"))
    plan = counts.join(above, ["token", "size"], "left").join(below, ["token", "size"], "left").filter("c > 1 OR up > 0 OR down > 0")
    dealt = lookup(entries, plan, ["token", "size"], "c", entries.count())
    dealt = dealt.join(groups.select("gid", "short"), "gid").withColumn("own", F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int"))
    many = lambda n, make: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)).otherwise(F.array().cast("array<struct<low:int,x:int,y:int,kind:int,side:int>>"))
    place = lambda low, x, y, kind, side: F.struct(low.cast("int").alias("low"), x.alias("x"), y.alias("y"), F.lit(kind).alias("kind"), side.alias("side"))
    size, own = F.col("size"), F.col("own")
    same = many("parts", lambda o: place(size, F.least(own, o), F.greatest(own, o), 0, F.when(own == o, 2).when(own < o, 0).otherwise(1)))
    blocks = F.concat(same, many("up", lambda o: place(size, own, o, 1, F.lit(0))), many("down", lambda o: place(size - 1, o, own, 1, F.lit(1))))
    spread = dealt.select("token", "gid", "n", "short", F.explode(blocks).alias("at"))
    return spread.select(F.concat_ws(":", "token", "at.low", "at.kind", "at.x", "at.y").alias("block"), "at.side", "gid", "n", "short")


def _forest(gids: list[int], n: np.ndarray, shorts: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that connect the groups of a block which may link as all such pairs would.

    Of two prefixes, the one that ends first shares all it can share within the other one, so
    sets have at most that number in common and what lies behind that prefix.
    """
    count = len(gids)
    size = np.array([len(s) for s in shorts], np.int64)
    last = np.array([s[-1] for s in shorts], np.int64)
    owner = np.repeat(np.arange(count), size)
    _, token, times = np.unique(np.concatenate(shorts), return_inverse=True, return_counts=True)
    shared = times[token] > 1
    _, token = np.unique(token[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    common = np.zeros((count, count), np.float32)  # shingles of the row's prefix that the column's has
    step = 2048
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, step):
        a, b = np.searchsorted(token, [low, low + step])
        grid = np.zeros((count, min(step, int(token[b - 1]) - low + 1)), np.float32)
        np.add.at(grid, (owner[a:b], token[a:b] - low), 1)
        common += grid @ (grid > 0).astype(np.float32).T
    most = common.astype(np.int64) + (n - size)[:, None]  # if the row's prefix ends first
    most = np.where(last[:, None] < last, most, np.where(last[:, None] > last, most.T, np.maximum(most, most.T)))
    need = -(-percent * (n[:, None] + n) // (100 + percent))
    near = (most >= need) & (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n))
    if sides[0] != 2:
        near &= sides[:, None] != sides
    edges, waiting = [], np.ones(count, bool)
    for first in range(count):
        if not waiting[first]:
            continue
        waiting[first] = False
        front = np.array([first])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & waiting)
            waiting[front] = False
            edges += [(gids[first], gids[x]) for x in front.tolist()]
    return edges


def _ties(spread: DataFrame, percent: int) -> DataFrame:
    """(a, b): the forests of all pairs of blocks."""
    dealt = spread.repartition("block").sortWithinPartitions("block", "side", "gid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, out = None, [], []

        def close() -> None:
            if len(held) > 1 and (held[0][0] == 2 or held[0][0] != held[-1][0]):
                sides, gids, n, shorts = zip(*held)
                out.extend(_forest(gids, np.array(n, np.int64), [np.frombuffer(s, np.uint16) for s in shorts], np.array(sides), percent))

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], names=["a", "b"])

        for batch in slices(batches, 4096):
            for at, *row in zip(*(column.to_pylist() for column in batch.columns)):
                if at != block:
                    close()
                    block, held = at, []
                held.append(row)
            if len(out) >= 1 << 14:
                yield made()
                out.clear()
        close()
        yield made()

    return dealt.select("block", "side", "gid", "n", "short").mapInArrow(trimmed(run), "a long, b long")


def _links(ids: list[int], sets: list[np.ndarray], copies: list[int], sides: list[int], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id of the component within the block, and linked copies, of each set.

    ``sides``: 0 or 1 for the halves of a pair of blocks, of which only links between the halves
    are counted, and 2 in a block on its own. Ties of the component are taken from all pairs.
    """
    size = np.array([len(s) for s in sets], np.int64)
    count = len(sets)
    weight, side = np.array(copies, np.int64), np.array(sides)
    links = np.zeros(count, np.int64)
    parent = list(range(count))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if count <= 12:
        for y in range(1, count):
            for x in range(y):
                if 100 * min(size[x], size[y]) < percent * max(size[x], size[y]):
                    continue
                common = size[x] + size[y] - len(np.union1d(sets[x], sets[y]))
                if 100 * common >= percent * (size[x] + size[y] - common):
                    parent[root(x)] = root(y)
                    if side[x] != side[y] or side[x] == 2:
                        links[x] += weight[y]
                        links[y] += weight[x]
    else:
        owner = np.repeat(np.arange(count), size)
        _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = often[token] > 1
        owner, token = owner[shared], token[shared]
        names, token = np.unique(token, return_inverse=True)
        common = np.zeros((count, count), np.float32)
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], token[order]
        step = 2048
        for low in range(0, len(names), step):
            a, b = np.searchsorted(token, [low, low + step])
            grid = np.zeros((count, step), np.float32)
            grid[owner[a:b], token[a:b] - low] = 1
            common += grid @ grid.T
        common = common.astype(np.int64)
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        np.fill_diagonal(linked, False)
        for x in range(count):
            for y in np.flatnonzero(linked[x, :x]).tolist():
                if root(x) != root(y):
                    parent[root(x)] = root(y)
        if side[0] != 2:
            linked &= side[:, None] != side[None, :]
        links = linked @ weight
    roots = [root(x) for x in range(count)]
    least: dict[int, int] = {}
    for r, key in zip(roots, ids):
        least[r] = min(key, least.get(r, key))
    return np.array([least[r] for r in roots], np.int64), links


def _packed_sets(docs: DataFrame, width: int) -> DataFrame:
    """(sig, packed): the set of each text with a word, as packed hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [values for values in shingle_sets(batch.column(0), width) if len(values)]
            columns = [[_signature(v) for v in sets], [v.tobytes() for v in sets]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["sig", "packed"])

    return docs.select("text").mapInArrow(trimmed(run), "sig binary, packed binary")


def _verify(members: DataFrame, percent: int) -> DataFrame:
    """(cid, least, links) of the members (block, side, cid, copies, packed) within each block."""
    dealt = members.repartition("block").sortWithinPartitions("block", "cid", "side")
    names = ["cid", "least", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sets, copies, sides = None, [], [], [], []

        def made() -> pa.RecordBatch:
            least, links = _links(ids, sets, copies, sides, percent)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(least), pa.array(links)], names=names)

        for batch in slices(batches):
            for at, side, cid, n, packed in zip(*(column.to_pylist() for column in batch.columns)):
                if at != block:
                    if ids:
                        yield made()
                    block, ids, sets, copies, sides = at, [], [], [], []
                if ids and ids[-1] == cid:
                    continue  # rows that repeat id and text give their set again
                ids.append(cid)
                sets.append(np.frombuffer(packed, np.uint64))
                copies.append(n)
                sides.append(side)
        if ids:
            yield made()

    return dealt.select("block", "side", "cid", "copies", "packed").mapInArrow(trimmed(run), "cid long, least long, links long")


def _classes(docs: DataFrame, thin: DataFrame) -> DataFrame:
    """(cid, sig, n, rep, copies): the classes of equal sets; rep is the (key, tie) of the row that stands for them."""
    rows = thin.filter("n > 0 AND key IS NOT NULL")
    found = rows.groupBy("sig", "n").agg(F.min(F.struct("key", "tie")).alias("rep"), F.count("*").alias("copies"))
    return materialize(found.withColumn("cid", F.monotonically_increasing_id()), "ngram-classes")


def _candidates(docs: DataFrame, frequent, width: int, percent: int) -> DataFrame:
    """(sig, n, family): the classes of every group that others may link with, or that has several classes."""
    prefixes = materialize(_prefixes(docs.filter("key IS NOT NULL"), width, percent, frequent), "ngram-prefixes")
    groups = materialize(prefixes.select("gid", "n", "prefix", "short").distinct(), "ngram-groups")
    members = materialize(prefixes.select("sig", "n", "gid").distinct(), "ngram-members")
    release(prefixes)

    found = materialize(_list_pairs(_entries(groups, False), percent).filter("b IS NULL OR a != b"), "ngram-lists")
    pairs = found.filter("b IS NOT NULL").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("i").alias("i"), F.max("j").alias("j"))
    # shingles that only one of the two has: behind the shared ones before their last place, and in
    # all of the prefix that ends first. Pairs that share a shingle of a long list too have more in
    # common than counted, but the blocks of that list look at them as well.
    size = lambda n: F.col(n) - F.ceil(F.col(n) * percent / 100) + 1
    apart = F.least(size("na") + F.col("j"), size("nb") + F.col("i")) + 1 - 2 * F.col("c")
    most = F.col("na") + F.col("nb") - 2 * F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    pairs = pairs.filter(apart <= most).select("a", "b", "na", "nb")
    short = groups.select("gid", "short")
    for end in "ab":
        pairs = pairs.join(short.select(F.col("gid").alias(end), F.col("short").alias(f"p{end}")), end)
    edges = materialize(_differ_little(pairs.select("a", "b", "na", "nb", "pa", "pb"), percent), "ngram-pairs")

    long = found.filter("b IS NULL").select("token", F.col("a").alias("gid"), F.col("na").alias("n"))
    long = materialize(long.unionByName(_entries(groups, True).select("token", "gid", "n")), "ngram-long")
    release(found)
    ties = materialize(_ties(_spread_lists(long, groups, percent), percent), "ngram-ties")
    release(groups, long)
    families = components(edges.unionByName(ties))

    named = members.groupBy("gid").agg(F.count("*").alias("members")).join(families.withColumnRenamed("node", "gid"), "gid", "left").filter("component IS NOT NULL OR members > 1")
    named = named.select("gid", "members", F.coalesce("component", "gid").alias("family"))
    candidates = materialize(lookup(members, named, ["gid"], "members", members.count()).select("sig", "n", "family"), "ngram-candidates")
    release(members, edges, ties)
    return candidates


def _linked(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For docs (key, tie, text): thin rows (key, tie, n, sig), classes, and the verified (cid, least, links) of linking classes."""
    spark = docs.sparkSession
    survey = materialize(_survey(docs, width, percent), "ngram-survey")
    thin = materialize(survey.filter("tokens IS NULL").select("key", "tie", "n", "sig"), "ngram-thin")
    frequent = spark.sparkContext.broadcast(_frequent(survey.filter("tokens IS NOT NULL")))
    release(survey)
    classes = _classes(docs, thin)
    candidates = _candidates(docs, frequent, width, percent)
    frequent.unpersist()

    sizes = candidates.groupBy("family").agg(F.count("*").alias("sets"), F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts")).filter("sets > 1")
    members = lookup(candidates, sizes, ["family"], "sets", candidates.count())
    members = materialize(members.join(classes.select("sig", "cid", "rep", "copies"), "sig"), "ngram-expanded")
    part = F.pmod(F.xxhash64("cid"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    spread = members.select("sig", "cid", "copies", "family", part.alias("part"), other)
    spread = spread.select(
        "sig", "cid", "copies",
        F.concat_ws(":", "family", F.least("part", "other"), F.greatest("part", "other")).alias("block"),
        F.when(F.col("part") == F.col("other"), 2).when(F.col("part") > F.col("other"), 1).otherwise(0).alias("side"),
    )
    wanted = bitmap(members, F.xxhash64("rep.key", "rep.tie"))
    sets = _packed_sets(flagged(docs, F.xxhash64("key", "tie"), wanted, "wanted").filter("wanted"), width)
    verified = materialize(_verify(spread.join(sets, "sig"), percent), "ngram-verified")
    release(members, candidates)
    return thin, classes, verified


def _documents(df: DataFrame, key: str, text: str) -> DataFrame:
    content = F.coalesce(quoted(text), F.lit(""))
    return df.select(quoted(key).alias("key"), F.xxhash64(content).alias("tie"), content.alias("text"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, n_links) of every row; links count all copies."""
    thin, classes, verified = _linked(_documents(df, key, text), width, percent)
    total = thin.count()
    worded = thin.filter("n > 0 AND key IS NOT NULL")
    placed = materialize(lookup(worded.select("key", "sig", "n"), classes.select("sig", "cid", "copies"), ["sig"], "copies", total).drop("sig"), "ngram-placed")

    # rows that repeat an id tie the classes of their texts
    several = placed.groupBy("key").agg(F.min("cid").alias("b"), F.max("cid").alias("high"), F.count("*").alias("rows")).filter("b < high")
    tied = lookup(placed.select("key", "cid"), several, ["key"], "rows", total).select(F.col("cid").alias("a"), "b")
    linked = components(verified.select(F.col("cid").alias("a"), F.col("least").alias("b")).unionByName(tied))
    counted = verified.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "copies", F.col("rep.key").alias("key")).join(linked.withColumnRenamed("node", "cid"), "cid", "left").join(counted, "cid", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "cid")), "ngram-named")
    labels = named.groupBy("component").agg(F.min("key").alias("component_id"), F.count("*").alias("classes"))
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    facts = lookup(named, labels, ["component"], "classes", total).select("cid", "copies", "component_id", links)
    rest = lookup(placed.select("key", "n", "cid"), facts, ["cid"], "copies", total).select("key", "n", "component_id", "n_links")

    bare = thin.filter("n = 0 OR key IS NULL").select("key", "n")
    ids = bare.groupBy("key").agg(F.count("*").alias("rows"))
    shared = ids.join(rest.select("key", "component_id"), "key", "left_semi").join(rest.select("key", "component_id").distinct(), "key")
    own = lookup(bare, shared, ["key"], "rows", total, "left")
    own = own.select("key", "n", F.coalesce("component_id", "key").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return own.unionByName(rest).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("n_links").cast("long"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of ``df`` of each group of near duplicates, with all its columns.

    The row with the smallest id stays; of several rows with that id, the one that comes first by its
    set, by its text and by the other columns. Rows that only share an id do not drop each other. Texts
    without words and rows with a null id stay, since they link with nothing.
    """
    thin, classes, verified = _linked(_documents(df, key, text), width, percent)
    linked = components(verified.select(F.col("cid").alias("a"), F.col("least").alias("b")))
    named = classes.select("cid", "sig", "copies").join(linked.withColumnRenamed("node", "cid"), "cid", "left").filter("component IS NOT NULL OR copies > 1")
    named = named.select("sig", "copies", F.coalesce("component", "cid").alias("component"))
    rows = lookup(thin.filter("n > 0 AND key IS NOT NULL").select("key", "tie", "sig"), named, ["sig"], "copies", thin.count())
    rows = materialize(rows.groupBy("component", "key", "sig", "tie").agg(F.count("*").alias("repeats")), "ngram-rows")
    best = rows.groupBy("component").agg(F.min(F.struct("key", "sig", "tie")).alias("best"), F.count("*").alias("n"))
    judged = lookup(rows, best, ["component"], "n", rows.count()).withColumn("stays", F.struct("key", "sig", "tie") == F.col("best"))
    found = judged.filter("NOT stays OR repeats > 1").select(F.col("key").alias("k"), F.col("tie").alias("mark"), "stays", "repeats")
    return without(df, quoted(key), F.xxhash64(F.coalesce(quoted(text), F.lit(""))), found, text)
