"""N-gram Jaccard join: which documents have nearly the same shingles.

A document's set holds its distinct runs of ``N`` words; two sets are linked
when their intersection is ``PERCENT`` percent of their union or more.  Equal
sets are one set from the start.

Before the join, a lossless filter.  Linked sets of n and m shingles share at
least o(n) = ceil(n * PERCENT / 100) of them, so in any fixed order of all
shingles the first n - o(n) + s of each set have s in common.  Ordered by hash,
those first shingles are counted, and only sets survive in which enough of
them occur elsewhere.  A task hands on a shingle of two of its sets at most, as
it knows by itself that further ones meet others there; so shingles are shuffled
once, and none has many rows.  Only these sets' shingles are counted as a whole, which
gives the order of the join: rarest first.

The join goes by size.

* Light sets, of fewer than x shingles: all pairs among the first
  n - o(n) + 2 shingles are enumerated; linked sets have a pair in common.
* Heavy sets: the inverted lists of the first n - o(n) + 1 shingles are
  scanned.  Lists hold heavy sets, and light ones near enough in size.
* x is chosen by cost: for every size, the pairs of shingles to enumerate
  against the list entries to scan, both counted.  As an entry is compared with
  its list's leader only, it costs a row and a comparison, however long the
  list is.

Sets that meet at a key are not paired all with all.  First each is compared
with the key's leader, which costs one comparison per entry; what is linked so
becomes one component.  Sets that meet at keys of several components form
families, directly or in steps, and only sets of one family and of different
components are compared: block by block, where blocks of one component are left
out.

Before shingles are compared one by one, sketches are: bit i of a sketch tells
whether an odd number of shingles falls to i.  Where two sketches differ the
sets must, so more differing bits than a linked pair may have shingles rule it
out for sure.  A sketch has about 2 to 4 bits per shingle, a 25th of the
shingles' own size.  What passes is compared exactly: no link between
components is lost.  Two blocks give the sets that are in such a pair, not the
pairs, of which there may be many more; these sets' shingles are compared in one
task, which gives the links that join components.

Defined cases: NULL and empty texts, and texts of white space, have an empty
set and are linked with nothing; a text of fewer than ``N`` words has its whole
run as the one shingle; rows with a NULL key take part, and their component is
the least key that is not NULL; an empty table gives no rows; other columns
are left out by ``classes`` and kept by ``first_of_each``; letters
are compared as they are, or, with ``lower``, A-Z as a-z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speclake.llm import words as W
from speclake.llm.graph import components
from speclake.llm.shared import arrow_schema, staged

N = 5
PERCENT = 75
SPARE = 16  # one more common shingle is asked for per so many, in the filter
BLOCK = 512  # sets of a block
SHINGLES = 1024  # shingles per set of a block, on average
LOT = 1 << 20  # first shingles that a task holds to compare its sets by them
BROADCAST = 1_000_000  # keys that may be broadcast, 24 bytes each


def least_common(n, percent: int = PERCENT):
    """Shingles that a set of ``n`` has in common with any linked set."""
    return -(-(n * percent) // 100)


def _spare(n, percent: int):
    """Common shingles asked for among a set's first ones; never more for a lesser set."""
    return 1 + n // SPARE


def shingle_sets(words: W.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, rising per text, and the texts' borders."""
    counts = np.diff(words.bounds)
    hashes = W.window_hashes(words.hashes, n)
    owner = W.owners(words.bounds)
    if len(hashes):
        own = owner[: len(hashes)] == owner[n - 1 :]
        hashes, texts = hashes[own], owner[: len(own)][own]
    else:
        texts = np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = [
            W.window_hashes(words.hashes[words.bounds[i] : words.bounds[i + 1]], int(counts[i]))[0]
            for i in short
        ]
        hashes = np.concatenate((hashes, np.array(whole, np.uint64)))
        texts = np.concatenate((texts, short))
    order = np.lexsort((hashes, texts))
    hashes, texts = hashes[order], texts[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
    hashes, texts = hashes[new], texts[new]
    return hashes, np.searchsorted(texts, np.arange(len(counts) + 1))


def _names(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of every set, from its shingles in order."""
    import hashlib

    data = memoryview(hashes.tobytes())
    return np.array(
        [
            int.from_bytes(
                hashlib.blake2b(data[8 * a : 8 * b], digest_size=8).digest(), "little", signed=True
            )
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
        ],
        np.int64,
    )


def _base(held: DataFrame, n: int, percent: int, lower: bool) -> DataFrame:
    """Per document its set's name and size; with the set's first use in a task, its first shingles.

    ``keys`` leaves out those that two sets before it in a lot of documents have; ``met``
    is their number.
    """
    schema = T.StructType(
        [held.schema["id"], *T._parse_datatype_string("h LONG, set LONG, n INT, met INT, keys ARRAY<LONG>").fields]
    )
    shape = arrow_schema(schema)

    def told(lot: list[tuple]) -> pa.RecordBatch:
        ids, hs, names, sizes, taken, keys = zip(*lot, strict=True)
        taken, keys = np.concatenate(taken), np.concatenate(keys)
        many = np.maximum(taken, 0)
        kept, met = _first_two(keys, many)
        ends = np.cumsum(many - met)
        cut = np.stack((ends - (many - met), ends), axis=1)
        return pa.record_batch(
            [
                pa.concat_arrays(ids),
                pa.concat_arrays(hs),
                pa.array(np.concatenate(names)),
                pa.array(np.concatenate(sizes).astype(np.int32)),
                pa.array(met.astype(np.int32)),
                _parts(keys[kept], cut, np.flatnonzero(taken >= 0)),
            ],
            schema=shape,
        )

    def run(batches):
        seen: set[int] = set()  # the task's sets
        lot, size = [], 0
        for batch in batches:
            for some in W.slices(batch, "t"):
                hashes, bounds = shingle_sets(W.words_of(some.column(2), W.SPACED, lower), n)
                sizes = np.diff(bounds)
                names = _names(hashes, bounds)
                new = []
                for i, name in enumerate(names.tolist()):
                    if sizes[i] and name not in seen:
                        seen.add(name)
                        new.append(i)
                firsts = sizes - least_common(sizes, percent) + _spare(sizes, percent)
                taken = np.full(len(sizes), -1)  # no keys at all
                taken[new] = np.minimum(firsts, sizes)[new]
                cut = np.stack((bounds[:-1], bounds[:-1] + np.maximum(taken, 0)), axis=1)
                keys = np.asarray(_parts(hashes, cut, np.array(new, np.int64)).values).view(np.uint64)
                lot.append((some.column(0), some.column(1), names, sizes, taken, keys))
                size += len(keys) + len(sizes)
                if size > LOT:
                    yield told(lot)
                    lot, size = [], 0
        if lot:
            yield told(lot)

    return held.mapInArrow(run, schema)


def _first_two(keys: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys that no two sets before have, and per set how many of its keys are left out.

    Sets follow each other in ``keys``, with ``taken`` different keys each.
    """
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    more = np.zeros(len(keys), bool)
    more[2:] = ranked[2:] == ranked[:-2]
    left_out = np.zeros(len(keys), bool)
    left_out[order[more]] = True
    owner = W.owners(np.concatenate(([0], np.cumsum(taken))))
    return np.flatnonzero(~left_out), np.bincount(owner[left_out], minlength=len(taken))


def _parts(hashes: np.ndarray, cut: np.ndarray, some: np.ndarray) -> pa.ListArray:
    """A list column: hashes[cut[i]] for the chosen rows, NULL for the others."""
    sizes = np.zeros(len(cut), np.int64)
    sizes[some] = cut[some, 1] - cut[some, 0]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    take = np.arange(offsets[-1]) + np.repeat(cut[:, 0] - offsets[:-1], sizes)
    mask = np.ones(len(cut), bool)
    mask[some] = False
    return pa.ListArray.from_arrays(
        pa.array(offsets.astype(np.int32)), pa.array(hashes[take].view(np.int64)), mask=pa.array(mask)
    )


def _common(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / F.lit(100.0)).cast("int")


def _survivors(base: DataFrame, percent: int) -> DataFrame:
    """Sets of whose first shingles enough occur in other sets."""
    held = base.where("keys IS NOT NULL")
    # No key has more than two rows of a lot; both that read them read one exchange.
    first = held.select("set", F.explode("keys").alias("key")).repartition("key")
    shared = (
        first.groupBy("key")
        .agg(F.min("set").alias("a"), F.max("set").alias("b"))
        .where("a != b")
        .select("key")
    )
    met = first.join(shared, "key").select("set", F.lit(None).cast("int").alias("n"), F.lit(1).alias("met"))
    # A set that several tasks saw counts more than once; that only keeps more.
    least = F.floor(_common(F.col("n"), percent) / F.lit(SPARE)) + 1
    return (
        held.select("set", "n", "met")
        .unionByName(met)
        .groupBy("set")
        .agg(F.sum("met").alias("c"), F.max("n").alias("n"))
        .where(F.col("c") >= least)
        .select("set", "n")
    )


def _whole(
    held: DataFrame, base: DataFrame, survivors: DataFrame, n: int, lower: bool
) -> DataFrame:
    """The survivors' shingles, from one document of each set."""
    one = (
        base.join(survivors.select("set"), "set")
        .groupBy("set")
        .agg(F.min(F.struct("id", "h")).alias("doc"))
        .select("set", F.col("doc.id").alias("_id"), F.col("doc.h").alias("_h"))
    )
    if survivors.count() <= BROADCAST:
        one = F.broadcast(one)
    rows = held.join(
        one, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    ).select("set", "t")
    schema = "set LONG, n INT, shingles ARRAY<LONG>"
    shape = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for some in W.slices(batch, "t"):
                hashes, bounds = shingle_sets(W.words_of(some.column(1), W.SPACED, lower), n)
                cut = np.stack((bounds[:-1], bounds[1:]), axis=1)
                yield pa.record_batch(
                    [
                        some.column(0),
                        pa.array(np.diff(bounds).astype(np.int32)),
                        _parts(hashes, cut, np.arange(len(cut))),
                    ],
                    schema=shape,
                )

    return rows.mapInArrow(run, schema)


def _firsts(whole: DataFrame, percent: int) -> DataFrame:
    """Per set: its first n - o(n) + 2 shingles, rarest first, of those that others have.

    ``scan`` is how many of them are among the first n - o(n) + 1.
    """
    each = whole.select("set", F.explode("shingles").alias("s"))
    counted = (
        each.groupBy("s")
        .agg(F.count("*").alias("f"), F.min("set").alias("a"), F.max("set").alias("b"))
        .where("a != b")
        .select("s", "f")
    )
    o = _common(F.col("n"), percent)
    known = F.size("all")
    alone = F.col("n") - known  # shingles of no other set come first
    return (
        each.join(counted, "s")
        .groupBy("set")
        .agg(F.array_sort(F.collect_set(F.struct("f", "s"))).alias("all"))
        .join(whole.select("set", "n").distinct(), "set")
        .where(known >= o)
        .select(
            "set",
            "n",
            F.greatest(F.col("n") - o + 1 - alone, F.lit(0)).alias("scan"),
            F.slice(F.col("all.s"), 1, F.greatest(F.col("n") - o + 2 - alone, F.lit(0))).alias("s"),
        )
    )


def boundary(sizes: list[tuple[int, int, int]]) -> int:
    """The size x with the least cost; rows are (size, cost as light, cost as heavy)."""
    rest = sum(heavy for _, _, heavy in sizes)
    best, x, light = rest, 0, 0
    for size, as_light, as_heavy in sorted(sizes):
        light, rest = light + as_light, rest - as_heavy
        if light + rest < best:
            best, x = light + rest, size + 1
    return x


def _costs(firsts: DataFrame) -> list[tuple[int, int, int]]:
    """One row per set size."""
    scans = firsts.select("set", "n", F.explode(F.slice("s", 1, F.col("scan"))).alias("s"))
    lists = scans.groupBy("s").agg(F.count("*").alias("c"))
    # An entry whose list has others is a row and a comparison with the leader.
    heavy = (
        scans.join(lists.where("c > 1"), "s").groupBy("n").agg((F.count("*") * 2).alias("heavy"))
    )
    k = F.size("s").cast("long")
    light = firsts.groupBy("n").agg(F.sum(k * (k - 1) / 2).cast("long").alias("light"))
    rows = light.join(heavy, "n", "left").collect()
    return [(r.n, r.light, r.heavy or 0) for r in rows]


def _meetings(firsts: DataFrame, x: int, percent: int) -> DataFrame:
    """(key, set, n): where sets meet; pairs of shingles for light ones, lists for heavy ones."""
    light = firsts.where(F.col("n") < x).select(
        "set",
        "n",
        F.explode(
            F.flatten(
                F.transform(
                    "s",
                    lambda a, i: F.transform(
                        F.slice("s", i + 2, F.size("s")), lambda b: F.xxhash64(F.lit(2), a, b)
                    ),
                )
            )
        ).alias("key"),
    )
    near = least_common(x, percent)
    heavy = firsts.where(F.col("n") >= near).select(
        "set", "n", F.explode(F.slice("s", 1, F.col("scan"))).alias("key")
    )
    return light.unionByName(heavy).select("key", "set", "n")


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be linked."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def sketches(whole: DataFrame) -> DataFrame:
    """(set, n, sketch): the parity of shingles per bit, as 64-bit words."""
    schema = "set LONG, n INT, sketch ARRAY<LONG>"
    shape = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            values, at = np.asarray(batch.column(2).values), np.asarray(batch.column(2).offsets)
            found = [sketch(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))),
                ],
                schema=shape,
            )

    return whole.mapInArrow(run, schema)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bits; their number is a power of two, twice the shingles or more."""
    bits = 64
    while bits < 2 * len(shingles):
        bits *= 2
    places = W.mixed(shingles.view(np.uint64)) & np.uint64(bits - 1)
    odd = np.bincount(places.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows) folded to fewer words; parities add up."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def may_link(differing, a, b, percent: int):
    """Whether sets of a and b shingles with so many differing bits can be linked.

    Linked sets differ in (a + b) * (100 - percent) / (100 + percent) shingles at most.
    """
    return (100 + percent) * differing <= (100 - percent) * (a + b)


def _passing(pairs: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that their sketches do not rule out."""
    first = drawn.select(F.col("set").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("x"))
    second = drawn.select(F.col("set").alias("b"), "n", F.col("sketch").alias("y"))
    rows = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "m", "n", "x", "y")
    schema = "a LONG, b LONG"
    shape = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            m, n = (np.asarray(batch.column(i), np.int64) for i in (2, 3))
            (x, at), (y, to) = (
                (np.asarray(c.values).view(np.uint64), np.asarray(c.offsets))
                for c in (batch.column(4), batch.column(5))
            )
            differing = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                p, q = x[None, at[i] : at[i + 1]], y[None, to[i] : to[i + 1]]
                words = min(p.shape[1], q.shape[1])
                differing[i] = np.bitwise_count(folded(p, words) ^ folded(q, words)).sum()
            taken = pa.array(np.flatnonzero(may_link(differing, m, n, percent)))
            yield pa.record_batch([batch.column(0).take(taken), batch.column(1).take(taken)], schema=shape)

    return rows.mapInArrow(run, schema)


def _linked(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that are linked; shingles are compared one by one."""
    first = whole.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
    second = whole.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    rows = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "x", "y")
    schema = "a LONG, b LONG"
    shape = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            keep = []
            lists = []
            for i in (2, 3):
                column = batch.column(i)
                lists.append((np.asarray(column.values), np.asarray(column.offsets)))
            (x, at), (y, to) = lists
            for i in range(batch.num_rows):
                p, q = x[at[i] : at[i + 1]], y[to[i] : to[i + 1]]
                both = np.sort(np.concatenate((p, q)))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(p) + len(q) - common):
                    keep.append(i)
            taken = pa.array(keep, pa.int64())
            yield pa.record_batch([batch.column(0).take(taken), batch.column(1).take(taken)], schema=shape)

    return rows.mapInArrow(run, schema)


def _with_roots(met: DataFrame, roots: DataFrame) -> DataFrame:
    return met.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn(
        "root", F.coalesce("root", "set")
    )


def _families(apart: DataFrame) -> DataFrame:
    """(set, root, family): sets that meet at keys of several components, directly or in steps.

    A pair that meets at many keys is in one family, so it is compared once.
    """
    leaders = apart.groupBy("key").agg(F.min("set").alias("leader"))
    steps = apart.join(leaders, "key").where("set != leader").select("set", "leader").distinct()
    return (
        components(steps, "set", "leader")
        .select(F.col("node").alias("set"), F.col("root").alias("family"))
        .join(apart.select("set", "root", "n").distinct(), "set")
    )


def _across(
    apart: DataFrame, drawn: DataFrame, whole: DataFrame, percent: int
) -> DataFrame:
    """Links that join different components, family by family and block by block.

    A component with many sets in a family has blocks of its own; two blocks of
    one component are not compared.  Blocks hold sketches only; shingles are read
    of the sets that have a partner which sketches do not rule out.
    """
    every = staged(_families(apart))
    sizes = every.groupBy("family", "root").agg(F.count("*").alias("own"))
    part = F.when(F.col("own") * 2 >= BLOCK, F.col("root"))
    placed = every.join(sizes, ["family", "root"]).withColumn("part", part)
    totals = placed.groupBy("family", "part").agg(
        F.greatest(
            F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / (BLOCK * SHINGLES))
        ).alias("total")
    )
    placed = placed.join(
        totals.select(F.col("family").alias("_f"), F.col("part").alias("_p"), "total"),
        (F.col("family") == F.col("_f")) & F.col("part").eqNullSafe(F.col("_p")),
    ).withColumn(
        "block", F.pmod(F.xxhash64("set"), F.col("total")).cast("int")
    )
    placed = staged(placed.select("family", "part", "block", "set", "root"))
    blocks = placed.select("family", "part", "block").distinct()
    one, two = blocks.alias("one"), blocks.alias("two")
    order = lambda side: F.struct(F.col(f"{side}.part"), F.col(f"{side}.block"))
    pairs = one.join(two, F.col("one.family") == F.col("two.family")).where(
        F.col("one.part").isNull() & F.col("two.part").isNull() & (order("one") <= order("two"))
        | ~F.col("one.part").eqNullSafe(F.col("two.part")) & (order("one") < order("two"))
    )
    pairs = pairs.select(
        F.col("one.family").alias("family"),
        F.struct("one.part", "one.block").alias("x"),
        F.struct("two.part", "two.block").alias("y"),
    )
    # One block holds about BLOCK sets.
    filled = (
        placed.join(drawn, "set")
        .groupBy("family", F.struct("part", "block").alias("at"))
        .agg(F.collect_list(F.struct("set", "root", "n", "sketch")).alias("sets"))
    )
    rows = (
        pairs.join(filled.select("family", F.col("at").alias("x"), F.col("sets").alias("first")), ["family", "x"])
        .join(filled.select("family", F.col("at").alias("y"), F.col("sets").alias("second")), ["family", "y"])
        .select(F.xxhash64("family", "x", "y").alias("meeting"), "first", "second")
    )
    schema = "meeting LONG, set LONG, root LONG"
    shape = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sets, roots = _near(_block(batch.column(1), i), _block(batch.column(2), i), percent)
                meeting = np.full(len(sets), batch.column(0)[i].as_py(), np.int64)
                yield pa.record_batch([pa.array(x) for x in (meeting, sets, roots)], schema=shape)

    near = staged(rows.mapInArrow(run, schema))
    gathered = (
        near.join(whole.select("set", "shingles"), "set")
        .groupBy("meeting")
        .agg(F.collect_list(F.struct("set", "root", "shingles")).alias("sets"))
        .select("sets")
    )
    pair = "a LONG, b LONG"
    pair_shape = arrow_schema(pair)

    def joined(batches):
        for batch in batches:
            column = batch.column(0)
            for low, high in zip(column.offsets[:-1].tolist(), column.offsets[1:].tolist(), strict=True):
                found = _joining(column.values[low:high], percent)
                yield pa.record_batch([pa.array(x, pa.int64()) for x in found], schema=pair_shape)

    return gathered.mapInArrow(joined, pair)


def _joining(rows: pa.StructArray, percent: int) -> tuple[list[int], list[int]]:
    """Links (greater, lesser) between components, as many as join all that have one."""
    names, roots = (np.asarray(rows.field(k)) for k in ("set", "root"))
    column = rows.field("shingles")
    at, values = np.asarray(column.offsets), np.asarray(column.values)
    lists = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    drawn = [sketch(x) for x in lists]
    sizes, words = np.diff(at).astype(np.int64), np.array([len(x) for x in drawn])
    places = [np.flatnonzero(words == w) for w in np.unique(words)]
    parts = [(some, np.array([drawn[i] for i in some])) for some in places]
    above = dict.fromkeys(roots.tolist())

    def top(root: int) -> int:
        while above[root] is not None:
            root = above[root]
        return root

    first, second = [], []
    for k, (some, bits) in enumerate(parts):
        for others, more in parts[k:]:
            hit = _close(bits, sizes[some], more, sizes[others], percent)
            hit &= roots[some][:, None] != roots[others][None, :]
            for i, j in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
                i, j = int(some[i]), int(others[j])
                x, y = top(int(roots[i])), top(int(roots[j]))
                if x == y:
                    continue
                both = np.sort(np.concatenate((lists[i], lists[j])))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    above[max(x, y)] = min(x, y)
                    first.append(max(int(names[i]), int(names[j])))
                    second.append(min(int(names[i]), int(names[j])))
    return first, second


def _block(column: pa.ListArray, i: int):
    """Sets of one block by the number of words in their sketches."""
    low, high = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
    rows = column.values[low:high]
    names, roots, sizes = (np.asarray(rows.field(k)) for k in ("set", "root", "n"))
    lists = rows.field("sketch")
    at, values = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
    words = np.diff(at)
    out = []
    for w in np.unique(words):
        some = np.flatnonzero(words == w)
        bits = values[at[some][:, None] + np.arange(w)]
        out.append((names[some], roots[some], sizes[some].astype(np.int64), bits))
    return out


def _close(bits, sizes, more, counts, percent: int) -> np.ndarray:
    """Which pairs of two lots of sets their sketches do not rule out."""
    words = min(bits.shape[1], more.shape[1])
    x, y = folded(bits, words), folded(more, words)
    differing = np.zeros((len(x), len(y)), np.int64)
    for k in range(words):
        differing += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return may_link(differing, sizes[:, None], counts[None, :], percent)


def _near(first, second, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets, and their roots, that are in a pair of different components that sketches do not rule out."""
    known: dict[int, int] = {}
    for names, roots, sizes, bits in first:
        for others, their, counts, more in second:
            hit = _close(bits, sizes, more, counts, percent) & (roots[:, None] != their[None, :])
            for some, own, found in ((names, roots, hit.any(axis=1)), (others, their, hit.any(axis=0))):
                known.update(zip(some[found].tolist(), own[found].tolist(), strict=True))
    return np.array(list(known), np.int64), np.array(list(known.values()), np.int64)


def set_links(whole: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between sets that join all components that have a link between them."""
    firsts = staged(_firsts(whole, percent))
    drawn = staged(sketches(whole.join(firsts.select("set"), "set", "left_semi")))
    x = boundary(_costs(firsts))
    met = _meetings(firsts, x, percent)
    counts = met.groupBy("key").agg(F.count("*").alias("c"), F.min("set").alias("leader"))
    met = staged(met.join(counts.where("c > 1"), "key"))
    leaders = met.select("leader").distinct()
    sizes = firsts.join(leaders, F.col("set") == F.col("leader")).select(
        "leader", F.col("n").alias("m")
    )
    done = staged(
        met.where("set != leader")
        .select(F.col("set").alias("a"), "leader", "n")
        .distinct()
        .join(sizes, "leader")
        .where(_fits(F.col("n"), F.col("m"), percent))
        .select("a", F.col("leader").alias("b"))
    )
    links = staged(_linked(_passing(done, drawn, percent), whole, percent))
    placed = _with_roots(met, components(links))
    spread = (
        placed.groupBy("key")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low != high")
        .select("key")
    )
    apart = staged(placed.join(spread, "key").select("key", "set", "root", "n"))
    return links.unionByName(_across(apart, drawn, whole, percent))


def classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n: int = N,
    percent: int = PERCENT,
    lower: bool = False,
) -> DataFrame:
    """Per document: key, n_shingles and component_id; ``lower`` takes A-Z for a-z."""
    shown = _classes(docs, key, text, n, percent, lower)
    return shown.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"),
                        F.coalesce("component", "id").alias("component_id"))


def _classes(
    docs: DataFrame, key: str, text: str, n: int, percent: int, lower: bool
) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    held = docs.select(F.col(key).alias("id"), F.xxhash64(whole).alias("h"), whole.alias("t"))
    base = staged(_base(held, n, percent, lower))
    survivors = staged(_survivors(base, percent))
    roots = components(set_links(staged(_whole(held, base, survivors, n, lower)), percent))
    rows = base.select("id", "h", "n", "set").join(
        roots.withColumnRenamed("node", "set"), "set", "left"
    )
    # The least key of a component; a set that is not linked is one by itself.
    rows = rows.withColumn("class", F.when(F.col("n") > 0, F.coalesce("root", "set")))
    least = (
        rows.where(F.col("class").isNotNull())
        .groupBy(F.col("class").alias("_class"))
        .agg(
            F.min("id").alias("component"),
            F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("first"),
        )
    )
    return rows.join(least, F.col("class") == F.col("_class"), "left")


def first_of_each(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n: int = N,
    percent: int = PERCENT,
    lower: bool = False,
) -> DataFrame:
    """The documents, with all their columns, but only the one of each class with the least key.

    Documents with an empty set all stay; so do rows that repeat the kept one's key and text.
    """
    shown = _classes(docs, key, text, n, percent, lower)
    gone = (
        shown.where(
            F.col("class").isNotNull()
            & (F.struct(F.col("id").isNull(), "id", "h") != F.col("first"))
        )
        .select("id", "h")
        .distinct()
    )
    # The row goes into a struct of its own, as its columns may have any names.
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(key).alias("key"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("hash"),
    )
    return held.join(
        gone, F.col("key").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")), "left_anti"
    ).select("row.*")
