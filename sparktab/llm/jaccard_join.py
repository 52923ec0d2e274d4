"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and their groups.

Search is exact.  Two sets of the least similarity share a shingle among the first
``n - ceil(t n) + 1`` of each, in any one order of all shingles; the order here is by digest, with
shingles that are frequent in the corpus last (rarer ones before more frequent ones).  So the
different sets ("classes") are dealt into buckets, one for each shingle that two of them have among
their first ones; buckets of the same members count once.

1. Signature trees find the pairs.  The classes of a bucket are the leaves of a tree; a node holds the
   OR of the token bitmaps below it and their range of sizes.  A dual traversal compares pairs of
   nodes, drops those whose largest possible overlap is too small, and ends at pairs of classes.  Bitmaps
   have 4 to 8 bits for a shingle, in trees at most ``TREE_BITS``; there is one tree for each width, and
   of two widths the wider bitmaps are folded.
2. A bucket is cut into parts of at most about ``PART`` classes and ``PART_TOKENS`` shingles, and each pair of
   parts is a task's work of its own, so no bucket is gathered whole.  In a first round a part meets itself and the
   next part, and of the pairs that are left only a spanning forest of the likeliest goes on, since that is
   enough to connect a group of copies; most buckets then lie within one component.
3. The second round takes the buckets that still hold several components, every part with every other, and
   passes on every pair of different components.  Buckets between the same components meet in one task, which tells a pair
   once, as far as they hold about ``TOGETHER`` classes; more are dealt to several tasks.
4. In both rounds pairs go on to the whole bitmaps and then to the sets themselves, each of which moves once for
   a part of a bucket and not for a pair.  Verified links give the components.

Words are maximal runs of characters other than space and U+0009 to U+000D, with A-Z in lower
case.  A text with fewer words than a shingle has its whole sequence as the only shingle;
one without words, or null, has no shingle and links with nothing.  Sets are of 64-bit
digests of shingles; classes are told apart by 128-bit digests of sets and numbered by 64 bits of these, anew
where two numbers agree.  Rows that repeat an id are nodes of one name; a
null id gets a null component and connects nothing.  A very long text is a slice of its own.  Extra columns are ignored;
every input row gives one output row, none for an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_binary, broadcast_if_small, drop, durable, slices
from .graph import components, lowest_reachable
from .hashing import grams, joined_words, signed, word_numbers

#: Classes in a part of a bucket and their shingles; children of a tree node.
PART, PART_TOKENS, FAN = 512, 1 << 21, 8
#: Bits of a token bitmap: at least, for a shingle, and at most in a tree.
LEAST_BITS, BITS, TREE_BITS = 256, 4, 4096
#: Classes of buckets that meet in one task, part by part, about.
TOGETHER = 8 * PART
#: Pairs that a task remembers to have told.
TOLD = 1 << 18
#: Frequent shingles told to the workers: at most so many, with at least so many documents each.
FREQUENT, LEAST_FREQUENT = 1 << 19, 16

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def every_shingle(raw: bytes | None, width: int) -> np.ndarray:
    """The shingles of a text in its order, as 64-bit digests."""
    joined, ends = joined_words(raw.translate(_LOWER)) if raw else (b"", np.zeros(0, np.int64))
    if not len(ends):
        return np.zeros(0, np.uint64)
    return grams(word_numbers(joined, ends), min(width, len(ends))) ^ np.uint64(min(width, len(ends)))


def shingles(raw: bytes | None, width: int) -> np.ndarray:
    """The set of shingles of a text, as sorted 64-bit digests."""
    return np.unique(every_shingle(raw, width))


def digest_of(tokens: np.ndarray) -> bytes:
    """The 128-bit digest of a set."""
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def number_of(digest: bytes) -> int:
    """The 64-bit number of a class, from its digest."""
    return int.from_bytes(digest[:8], "little", signed=True)


def prefix_size(n: int, num: int, den: int) -> int:
    """How many first shingles of a set of ``n`` hold one that is shared at similarity num/den."""
    return n - -(-num * n // den) + 1


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """The token bitmap of a set, as 64-bit words; its width, a power of two, goes with the size."""
    width = max(LEAST_BITS, 1 << (BITS * len(tokens) - 1).bit_length())
    flags = np.zeros(width, np.uint8)
    flags[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (along the last axis) as those of a smaller width."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def possible(n_a: int, a: np.ndarray, n_b: int, b: np.ndarray, num: int, den: int) -> bool:
    """Whether sets of these sizes and bitmaps can be similar enough."""
    words = min(len(a), len(b))
    a, b = folded(a, words), folded(b, words)
    slack = min(n_a - int(np.bitwise_count(a).sum()), n_b - int(np.bitwise_count(b).sum()))
    most = min(int(np.bitwise_count(a & b).sum()) + slack, n_a, n_b)
    return most * (num + den) >= num * (n_a + n_b)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets are similar enough."""
    merged = np.sort(np.concatenate([a, b]), kind="stable")
    same = int((merged[1:] == merged[:-1]).sum())
    return den * same >= num * (len(a) + len(b) - same)


def _frequent(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and the magnitude of their counts.

    Every document is counted; a worker passes on what occurs at least three times in a slice.
    At most total / threshold shingles can pass, which bounds what the driver gets.  The list
    only decides the order of shingles; any list gives the same links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 32 << 20):
            found = [every_shingle(raw, width) for raw in batch.column(1).to_pylist()]
            tokens = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate([starts, [len(tokens)]]))
            some = n >= 3
            ids = pa.concat_arrays([signed(tokens[starts[some]]), pa.array([None], pa.int64())])
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([n[some], [len(tokens)]]), pa.int64())], ["token", "n"])

    counts = durable(rows.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    total = counts.filter("token is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(LEAST_FREQUENT, -(-total // FREQUENT))
    held = counts.filter(F.col("token").isNotNull() & (F.col("n") >= least)).toArrow()
    drop(counts)
    tokens = held.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.log2(held.column("n").to_numpy().astype(np.float64)[order] + 1).astype(np.int8)


def _classes(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, digest, number, n, prefix, sig, bits): digest, number and size of each set, its first shingles, its bitmap folded for
    a tree, and the whole bitmap where that is wider."""
    frequent = rows.sparkSession.sparkContext.broadcast(_frequent(rows, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, magnitude = frequent.value
        for batch in slices(batches, 1):
            digests, numbers, sizes, prefixes, sigs, wholes = [], [], [], [], [], []
            for raw in batch.column(1).to_pylist():
                tokens = shingles(raw, width)
                n = len(tokens)
                sizes.append(n)
                digests.append(digest_of(tokens) if n else None)
                numbers.append(number_of(digests[-1]) if n else None)
                # So small a set links with equal sets only.
                if not n or num * (n + 1) > den * n:
                    prefixes.append(None)
                    sigs.append(None)
                    wholes.append(None)
                    continue
                bits = bitmap(tokens)
                sig = folded(bits, TREE_BITS // 64)
                sigs.append(sig.tobytes())
                wholes.append(bits.tobytes() if len(bits) > len(sig) else None)
                if len(often):
                    at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
                    tokens = tokens[np.argsort(np.where(often[at] == tokens, magnitude[at], 0), kind="stable")]
                prefixes.append(tokens[: prefix_size(n, num, den)].view(np.int64))
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(numbers, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(wholes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "number", "n", "prefix", "sig", "bits"])

    return rows.mapInArrow(run, "doc_id long, digest binary, number long, n long, prefix array<long>, sig binary, bits binary")


class Tree:
    """A signature tree: level 0 holds the classes by size, each level above the OR of ``FAN`` nodes."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        self.rows = bits
        sizes, bits = sizes[self.order], bits[self.order]
        slack = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        #: For each level: bitmaps, least and largest size, most tokens without a bit of their own.
        self.levels = [(bits, sizes, sizes, slack)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, slack = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))


def similar_nodes(one: Tree, i: np.ndarray, two: Tree, j: np.ndarray, level: int, num: int, den: int) -> np.ndarray:
    """Whether classes below the nodes i and j can be similar enough."""
    bits_i, low_i, high_i, slack_i = (x[i] for x in one.levels[level])
    bits_j, low_j, high_j, slack_j = (x[j] for x in two.levels[level])
    most = np.bitwise_count(bits_i & bits_j).sum(axis=1, dtype=np.int64) + np.minimum(slack_i, slack_j)
    most = np.minimum(most, np.minimum(high_i, high_j))
    fits = (high_i * den >= low_j * num) & (high_j * den >= low_i * num)
    return fits & (most * (num + den) >= num * (low_i + low_j))


def traverse(one: Tree, two: Tree, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes that a dual traversal cannot rule out (for one tree with itself: i < j)."""
    own = one is two
    level = max(len(one.levels), len(two.levels)) - 1
    for tree in (one, two):
        while len(tree.levels) <= level:
            tree.levels.append(tree.levels[-1])
    i = j = np.zeros(1, np.int64)
    while True:
        keep = similar_nodes(one, i, two, j, level, num, den)
        i, j = i[keep], j[keep]
        if level == 0:
            break
        level -= 1
        below_i, below_j = np.broadcast_arrays(_children(one, i, level)[:, :, None], _children(two, j, level)[:, None, :])
        i, j = below_i.ravel(), below_j.ravel()
        good = (i >= 0) & (j >= 0)
        if own:
            good &= i <= j
        i, j = i[good], j[good]
    if own:
        i, j = i[i < j], j[i < j]
    return one.order[i], two.order[j]


def _children(tree: Tree, nodes: np.ndarray, level: int) -> np.ndarray:
    """The nodes below, one row for each node; -1 where there is none."""
    if len(tree.levels[level][0]) == len(tree.levels[level + 1][0]):
        return nodes[:, None]
    out = nodes[:, None] * FAN + np.arange(FAN)
    return np.where(out < len(tree.levels[level][0]), out, -1)


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(set, n, data) of texts (doc_id, text, digest, set): their shingles; texts of another set are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [shingles(raw, width) for raw in batch.column(1).to_pylist()]
            same = [bool(len(t)) and digest_of(t) == d for t, d in zip(found, batch.column(2).to_pylist())]
            sizes = pa.array([len(t) for t in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(3), sizes, pa.array([t.tobytes() for t in found], pa.binary())], ["set", "n", "data"]).filter(pa.array(same, pa.bool_()))

    return texts.mapInArrow(run, "set long, n long, data binary").dropDuplicates(["set"])


def _numbered(classes: DataFrame) -> DataFrame:
    """(set, digest, first, n, prefix, sig, bits) of each different set: its number, its smallest document."""
    some = classes.filter("digest is not null and doc_id is not null").groupBy("digest")
    one = durable(some.agg(F.first("number").alias("set"), F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("n", "prefix", "sig", "bits"))))
    turn = 0
    while not (clash := one.groupBy("set").agg(F.count("*").alias("times")).filter("times > 1")).isEmpty():
        turn += 1
        anew = durable(one.join(clash, "set", "left").withColumn("set", F.when(F.col("times").isNull(), F.col("set")).otherwise(F.xxhash64("digest", F.lit(turn)))).drop("times"))
        drop(one)
        one = anew
    return one


def _buckets(named: DataFrame) -> DataFrame:
    """(key, set, n, parts): the classes of each bucket, buckets of the same members once, and into how many
    parts a bucket is cut."""
    placed = named.select("set", "n", F.explode("prefix").alias("token"))
    # The key is written anew so that the joins shuffle both sides themselves and adaptive execution can split
    # a hot bucket.
    key = F.bitwise_not("token").alias("key")
    # Written first, so that its shuffle is gone before the next one.
    shared = durable(placed.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1").select(key))
    members = durable(placed.select("set", "n", key).join(shared, "key", "left_semi"))
    drop(shared)
    # Two buckets are the same if their members' digests add up to the same; sums of 32 bits cannot overflow.
    low = F.lit(0xFFFFFFFF)
    sums = [F.sum(F.col("set").bitwiseAND(low)), F.sum(F.shiftrightunsigned("set", 32)), F.sum(F.hash("set").cast("long").bitwiseAND(low))]
    sums = [x.alias(f"sum_{i}") for i, x in enumerate(sums)]
    alike = members.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"), *sums)
    parts = F.ceil(F.greatest(F.col("size") / PART, F.col("tokens") / PART_TOKENS)).cast("int").alias("parts")
    kept = alike.groupBy("size", "tokens", "sum_0", "sum_1", "sum_2").agg(F.min("key").alias("key")).select(F.bitwise_not("key").alias("again"), parts)
    buckets = durable(members.withColumn("again", F.bitwise_not("key")).join(kept, "again").select("key", "set", "n", "parts"))
    drop(members)
    return buckets


def _spread(mixed: DataFrame) -> DataFrame:
    """(again, about) of buckets (again, about, size): buckets about the same, of more than ``TOGETHER`` classes in all,
    are dealt out, so that no task grows with their number."""
    crowded = mixed.groupBy("about").agg(F.ceil(F.sum("size") / TOGETHER).alias("turns")).filter("turns > 1").select(F.bitwise_not("about").alias("of"), "turns")
    dealt = mixed.withColumn("of", F.bitwise_not("about")).join(crowded, "of", "left")
    turn = F.pmod(F.xxhash64("again"), "turns")
    return dealt.select("again", F.when(F.col("turns").isNull(), F.col("about")).otherwise(F.xxhash64("about", turn)).alias("about"))


def _dealt(buckets: DataFrame, signatures: DataFrame, every: bool) -> DataFrame:
    """(key, low, high, part, set, n, sig, component): each class in each pair of parts it meets, sorted.

    buckets: (key, set, n, parts, about); buckets with the same ``about``, and so the same pairs, meet in one
    task part by part.  every: all pairs of parts; else a part meets itself and the next one only.
    """
    part = F.pmod(F.xxhash64("set"), F.col("at.parts").cast("long")).cast("int")
    around = F.array_distinct(F.transform(F.array(F.lit(0), F.lit(1), F.lit(-1)), lambda x: F.pmod(F.col("part") + x, F.col("parts"))))
    listed = buckets.groupBy("set").agg(F.collect_list(F.struct("key", "parts", "about")).alias("places"))
    spread = signatures.join(listed, "set").withColumn("at", F.explode("places"))
    placed = spread.select("set", "n", "sig", "component", "at.key", "at.parts", "at.about", part.alias("part"))
    others = F.sequence(F.lit(0), F.col("parts") - 1) if every else around
    place = ["key", "low", "high"]
    dealt = placed.withColumn("other", F.explode(others)).select(
        "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "set", "n", "sig", "component", "about"
    )
    return dealt.repartition("about", "low", "high").sortWithinPartitions(*place).drop("about")


def likeliest(i: np.ndarray, j: np.ndarray, score: np.ndarray, size: int) -> np.ndarray:
    """Places of pairs that make a spanning forest of all pairs, the highest scores first (Boruvka's way)."""
    order = np.argsort(-score, kind="stable")
    comp, rank, chosen = np.arange(size), np.arange(len(order)), []
    while True:
        x, y = comp[i[order[rank]]], comp[j[order[rank]]]
        live = x != y
        x, y, rank = x[live], y[live], rank[live]
        if not len(rank):
            return order[np.unique(np.concatenate(chosen))] if chosen else order[:0]
        best = np.full(size, len(order))
        np.minimum.at(best, x, rank)
        np.minimum.at(best, y, rank)
        picked = np.unique(best[best < len(order)])
        chosen.append(picked)
        comp = lowest_reachable(comp[i[order[picked]]], comp[j[order[picked]]], size)[comp]


def pairs_of_parts(sizes: np.ndarray, sigs: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, largest possible overlap by size) of pairs that signature trees leave over.

    left and right are places of classes; pairs lie between the two, or within left if right is None.
    """
    widths = np.array([len(x) for x in sigs])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def tree(own: np.ndarray, words: int) -> Tree:
        return Tree(sizes[own], folded_rows([sigs[k] for k in own], words))

    for w in np.unique(widths[left]):
        for v in np.unique(widths[left if right is None else right]):
            if right is None and v < w:
                continue
            one = left[widths[left] == w]
            two = (left if right is None else right)[widths[left if right is None else right] == v]
            if sizes[one].min() * num > sizes[two].max() * den or sizes[two].min() * num > sizes[one].max() * den:
                continue
            words = int(min(w, v))
            a = tree(one, words)
            b = a if right is None and v == w else tree(two, words)
            i, j = traverse(a, b, num, den)
            if len(i):
                most = np.bitwise_count(a.rows[i] & b.rows[j]).sum(axis=1, dtype=np.int64)
                out.append((one[i], two[j], most / (sizes[one[i]] + sizes[two[j]])))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def folded_rows(bits: list[np.ndarray], words: int) -> np.ndarray:
    """Bitmaps of one width as rows of a smaller one."""
    return folded(np.stack(bits), words)


def _tree_pairs(dealt: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """(a, b, key, low, high): pairs of classes of different components that the signature trees leave over,
    each with one place where it was found.  A task tells a pair once, as far as it remembers.

    Rows come sorted by (key, low, high); a group of rows is at most two parts of a bucket.  forest: only a
    spanning forest of the pairs of a group.
    """

    def found(at: tuple, rows: list[pa.RecordBatch], told: set[tuple[int, int]]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows)
        ids, sizes, part, comp = (table.column(c).to_numpy() for c in ("set", "n", "part", "component"))
        if len(ids) < 2 or (comp == comp[0]).all():
            return None
        one, two = np.flatnonzero(part == at[1]), np.flatnonzero(part == at[2])
        if not len(one) or not len(two):
            return None
        sigs = [np.frombuffer(x, np.uint64) for x in table.column("sig").to_pylist()]
        i, j, score = pairs_of_parts(sizes, sigs, one, None if at[1] == at[2] else two, num, den)
        apart = comp[i] != comp[j]
        i, j, score = i[apart], j[apart], score[apart]
        if forest:
            some = likeliest(i, j, score, len(ids))
            i, j = i[some], j[some]
        pairs = set(zip(np.minimum(ids[i], ids[j]).tolist(), np.maximum(ids[i], ids[j]).tolist())) - told
        if not pairs:
            return None
        if len(told) > TOLD:
            told.clear()
        told |= pairs
        a, b = zip(*pairs)
        where = [pa.array(np.full(len(a), x)) for x in at]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), where[0], where[1].cast(pa.int32()), where[2].cast(pa.int32())], ["a", "b", "key", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        for at, rows in groups(batches, ("key", "low", "high")):
            if (out := found(at, rows, told)) is not None:
                yield out

    pairs = dealt.mapInArrow(run, "a long, b long, key long, low int, high int")
    return pairs.groupBy("a", "b").agg(F.min(F.struct("key", "low", "high")).alias("at")).select("a", "b", "at.*")


def groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with equal columns ``names``, of rows that come sorted by them."""
    key, rows = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in names)))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if keys[a] != key and rows:
                yield key, rows
                rows = []
            key = keys[a]
            rows.append(batch.slice(a, b - a))
    if rows:
        yield key, rows


def _checked(pairs: DataFrame, held: DataFrame, fits: Callable[[int, np.ndarray, int, np.ndarray], bool]) -> DataFrame:
    """Those of the pairs (a, b, key, low, high) that fit by what ``held`` (set, n, data) says of them.

    What a class holds moves once for a part of a bucket, not for a pair.
    """
    place = ["key", "low", "high"]
    named = pairs.select(*place, F.explode(F.array("a", "b")).alias("set")).distinct().join(held, "set")
    given = named.select(*place, F.col("set").alias("a"), F.lit(None).cast("long").alias("b"), "n", "data")
    asked = pairs.select(*place, "a", "b", F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("data"))
    # In a group the classes come before the pairs (their b is null).
    rows = given.unionByName(asked).repartition(*place).sortWithinPartitions(*place, F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        for batch in slices(batches, 6):
            keep = []
            for *here, a, b, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                if here != at:
                    at, known = here, {}
                if b is None:
                    known[a] = n, np.frombuffer(data, np.uint64)
                    keep.append(False)
                else:
                    keep.append(fits(*known[a], *known[b]))
            order = [batch.column(c) for c in (3, 4, 0, 1, 2)]
            yield pa.RecordBatch.from_arrays(order, ["a", "b", *place]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long, key long, low int, high int")


def links(documents: DataFrame, width: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, named, links).

    classes: (doc_id, digest, n) of every row; named: (set, digest, first, n) of every different set;
    links (a, b) between sets: all verified, and enough to connect whatever is linked.
    """
    rows = as_binary(documents, id_col, text_col)
    full = durable(_classes(rows, width, num, den))
    named = _numbered(full)
    classes = durable(full.select("doc_id", "digest", "n"))
    drop(full)
    buckets = _buckets(named.filter("prefix is not null"))
    slim = durable(named.select("set", "digest", "first", "n", "sig", F.coalesce("bits", "sig").alias("data")))
    drop(named)

    def round_(buckets: DataFrame, signatures: DataFrame, first: bool, before: DataFrame | None) -> DataFrame:
        pairs = _tree_pairs(_dealt(buckets, signatures, every=not first), num, den, forest=first)
        pairs = durable(pairs if before is None else pairs.join(before.select("a", "b"), ["a", "b"], "left_anti"))
        able = durable(_checked(pairs, slim.select("set", "n", "data"), lambda n, x, m, y: possible(n, x, m, y, num, den)))
        wanted = durable(able.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(slim.select("set", "digest", F.col("first").alias("doc_id")), "set"))
        sets = durable(_sets(rows.join(broadcast_if_small(wanted, F.lit(64)), "doc_id").select("doc_id", "text", "digest", "set"), width))
        out = durable(_checked(able, sets, lambda n, x, m, y: similar(x, y, num, den)).select("a", "b"))
        drop(able, wanted, sets)
        return out, pairs

    signatures = slim.filter("sig is not null").select("set", "n", "sig")
    near, tried = round_(buckets.withColumn("about", F.col("key")), signatures.withColumn("component", F.col("set")), True, None)
    done = components(near).withColumnRenamed("id", "set")
    # Buckets that still hold several components.
    open_ = buckets.join(done, "set", "left").withColumn("component", F.coalesce("component", "set"))
    ends = [F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")]
    mixed = durable(open_.groupBy("key").agg(*ends).filter("low < high").select(F.bitwise_not("key").alias("again"), F.xxhash64("low", "high").alias("about"), "size"))
    still = durable(buckets.withColumn("again", F.bitwise_not("key")).join(_spread(mixed), "again").drop("again"))
    drop(mixed)
    known = signatures.join(done, "set", "left").withColumn("component", F.coalesce("component", "set"))
    rest, others = round_(still, known, False, tried)
    out = durable(near.unionByName(rest))
    named = durable(slim.select("set", "digest", "first", "n"))
    drop(slim, near, rest, tried, others, still, buckets, done)
    return classes, named, out


def join(documents: DataFrame, width: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: groups of texts linked at num/den or more."""
    classes, named, linked = links(documents, width, num, den, id_col, text_col)
    done = components(linked).withColumnRenamed("id", "set")
    # From classes to documents: the component is named by its smallest document.
    parts = named.join(done, "set", "left").select("digest", "first", F.coalesce("component", "set").alias("component"))
    low = parts.groupBy("component").agg(F.min("first").alias("component_id")).select(F.bitwise_not("component").alias("low_key"), "component_id")
    by_set = parts.select(F.col("digest").alias("of"), F.bitwise_not("component").alias("low_key")).join(low, "low_key").select("of", "component_id")
    return classes.join(by_set, F.col("digest") == F.col("of"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
