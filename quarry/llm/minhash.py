"""MinHash near-duplicates by a multi-index Hamming join.

A text's set is its distinct word shingles (64-bit hashes). Its signature is ``chunks * width``
symbols of 8 bits, the low bits of mixed minima under as many permutations; each symbol of two
texts agrees with a chance of their Jaccard similarity. The signature is split into ``chunks``
chunks. Two signatures within ``errors * chunks + chunks - 1`` symbol errors have, by the
pigeonhole principle, a chunk with at most ``errors`` errors; all such patterns are enumerated by
leaving out every set of ``errors`` symbols of every chunk, so each text has
``chunks * C(width, errors)`` keys and every pair under that distance shares one. With the
defaults (12 chunks of 6 symbols, 1 error) a pair at similarity 0.8 shares no key with a chance
of 3 in a million. Links are confirmed on the full word sets, never on hashes of signatures.

No bucket emits all its pairs. Equal sets become one class first (known by their size and 128 bits
of sums). Keys are sorted across tasks by key and class, so a hot bucket is spread over as many
tasks as it fills, and its least class becomes the pivot. Every member near its pivot is compared
with it once, in groups of ``BLOCK_ROWS`` members with a copy of the pivot each, and keeps the
symmetric difference of the two sets. Members of one pivot are then compared with each other by
these differences (|x ^ y| = |dx ^ dy|), in blocks of bounded size, only across components of the
links found so far, and a block gives a spanning forest of its links. So a group of n near copies
costs about n confirmations, and no link between different components is lost.

A far member can have links with those of its bucket that aren't close to the pivot (signature
distances obey the triangle inequality). These get new keys, the shingles among the rarest of the
text of which a text at the wanted similarity must share one (prefix filter): a passage that many
texts share fills buckets and not these. A text has one row for each, so a fifth of its set and one
at most, however many buckets it was in. Only where more than ``FEW`` texts hold such a shingle does
the key take the old bucket's pivot too, which linked texts of a bucket have in common. Here too a pivot is compared with the members;
those far from it again are joined with their bucket behind a bound on the signature distance and
confirmed on the texts. The order of shingles comes from a table of ``COUNTERS`` counters, whose
size is fixed; any order gives the same links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, buffers, mix, record, sieve, sliced, table
from .components import connected

#: Signature errors a candidate may have, as a share of its symbols: 30 of 72. At similarity 0.8 a fifth is
#: expected, and more than this has a chance of about 1e-6. (The pigeonhole guarantees a key up to 23 of 72.)
LOOSE = 0.43
#: Errors up to which a member is near its pivot, as a share of the symbols (a similarity of about 0.4).
NEAR = 0.6
#: A block of members has about so many rows, and hashes in their differences.
BLOCK_ROWS, BLOCK_LOAD = 512, 1 << 18
#: Texts up to which a rare shingle is a key by itself.
FEW = 16
#: Counters of shingles, by which rare ones come before frequent ones.
COUNTERS = 1 << 20


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of k-word shingles; fewer words make one shingle of all."""
    if not words.size:
        return words
    k = min(k, words.size)
    odd = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    n = words.size - k + 1
    acc = words[:n] * odd[0]
    for j in range(1, k):
        acc += words[j : n + j] * odd[j]
    return np.unique(mix(acc))


def signer(shingle: int, chunks: int, width: int):
    size = chunks * width
    rng = np.random.default_rng(20)
    mul = rng.integers(0, 1 << 31, size, np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, size, np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("signature", pa.binary())])

    def sign(s: np.ndarray) -> bytes:
        low = np.full(size, 0xFFFFFFFF, np.uint32)
        x = (s >> np.uint64(32)).astype(np.uint32)
        for i in range(0, x.size, 4096):
            np.minimum(low, (x[None, i : i + 4096] * mul[:, None] + add[:, None]).min(axis=1), out=low)
        return (mix(low.astype(np.uint64) + (np.arange(size, dtype=np.uint64) << np.uint64(32))) >> np.uint64(56)).astype(np.uint8).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in sliced(batches):
            ids = batch.column("doc_id")
            for at, texts in words.texts(*buffers(batch.column("text"))):
                n, a, b, sig = [], [], [], []
                for w in texts:
                    s = shingles(w, shingle)
                    n.append(s.size)
                    a.append(s.sum(dtype=np.uint64).astype(np.int64))
                    b.append(mix(s).sum(dtype=np.uint64).astype(np.int64))
                    sig.append(sign(s) if s.size else None)
                yield record(schema, ids.slice(at, len(texts)), n, a, b, sig)

    return run


def keyer(chunks: int, width: int, errors: int):
    """Keys of each signature: every chunk with every choice of ``errors`` symbols left out."""
    kept = [c for c in itertools.combinations(range(width), width - errors)]
    columns = np.array([[i * width + j for j in c] for i in range(chunks) for c in kept])
    salt = mix(np.arange(1, len(columns) + 1, dtype=np.uint64))
    schema = pa.schema([("rep", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(-1, chunks * width)
                key = np.broadcast_to(salt, (len(sig), len(salt))).copy()
                for j in range(columns.shape[1]):
                    key = mix(key ^ sig[:, columns[:, j]].astype(np.uint64))
                reps = np.repeat(batch.column("rep").to_numpy(), len(salt))
                yield record(schema, reps, key.view(np.int64).ravel())

    return run


def pivoter():
    """Of rows sorted by key and rep: every later member of a run of equal keys, with the first one as pivot.

    A run may go on in the next task, so each task also gives its first and last run's first member
    as a row marked ``edge``.
    """
    schema = pa.schema([("key", pa.int64()), ("pivot", pa.int64()), ("rep", pa.int64()), ("edge", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        for batch in batches:
            key, rep = batch.column("key").to_numpy(), batch.column("rep").to_numpy()
            if not key.size:
                continue
            fresh = np.ones(key.size, bool)
            fresh[1:] = key[1:] != key[:-1]
            pivot = rep[np.maximum.accumulate(np.where(fresh, np.arange(key.size), 0))]
            if last is None:
                yield record(schema, [int(key[0])], [int(pivot[0])], [int(pivot[0])], [True])
            elif last[0] == key[0]:  # the run of the batch before goes on
                n = int(np.flatnonzero(fresh)[1]) if fresh.sum() > 1 else key.size
                pivot[:n], fresh[0] = last[1], False
            if not fresh.all():
                later = ~fresh
                yield record(schema, key[later], pivot[later], rep[later], np.zeros(int(later.sum()), bool))
            last = int(key[-1]), int(pivot[-1])
        if last is not None:
            yield record(schema, [last[0]], [last[1]], [last[1]], [True])

    return run


def counter(shingle: int):
    """How often shingles occur, counted in ``COUNTERS`` counters by their low bits."""
    schema = pa.schema([("at", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(COUNTERS, np.int64)
        for batch in sliced(batches):
            for _, texts in words.texts(*buffers(batch.column("text"))):
                at, n = np.unique(np.concatenate([shingles(w, shingle) for w in texts]) & np.uint64(COUNTERS - 1), return_counts=True)
                total[at.astype(np.int64)] += n
        at = np.flatnonzero(total)
        yield record(schema, at.astype(np.int32), total[at])

    return run


def rarest(shingle: int, percent: int, counts: DataFrame):
    """Of each text the shingles of which any text at similarity ``percent`` / 100 holds one.

    In any fixed order of shingles, the first common one of two such texts is among the first
    n - ceil(percent * n / 100) + 1 of each. The order is by count, so passages that many texts
    share come last; shingles of a counter of 1 are in no other text and left out.
    """
    found = counts.toArrow()  # no more rows than there are counters
    count = np.zeros(COUNTERS, np.int64)
    count[found.column("at").to_numpy()] = found.column("n").to_numpy()
    count = np.minimum(count, (1 << 31) - 1).astype(np.int32)
    schema = pa.schema([("rep", pa.int64()), ("rare", pa.list_(pa.int64()))])

    def first(s: np.ndarray) -> np.ndarray:
        n = count[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
        head = np.argsort(n, kind="stable")[: s.size + percent * s.size // -100 + 1]  # the set is sorted, so ties are in order
        return s[head[n[head] > 1]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in sliced(batches):
            for at, texts in words.texts(*buffers(batch.column("text"))):
                yield record(schema, batch.column("doc_id").slice(at, len(texts)), [first(shingles(w, shingle)) for w in texts])

    return run


def confirmer(shingle: int, percent: int):
    """Texts compared with the first of their group, exactly, with the symmetric difference of the sets.

    Rows are sorted by ``a`` and ``block``, the texts of ``a`` (``first``) before those of ``b``.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("delta", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        group, firsts = None, []
        for batch in sliced(batches, "text", 1 << 19):
            rows = []
            sets = (shingles(w, shingle) for _, part in words.texts(*buffers(batch.column("text"))) for w in part)
            for a, block, role, b, y in zip(*(batch.column(c).to_pylist() for c in ("a", "block", "role", "doc_id")), sets):
                if (a, block) != group:
                    group, firsts = (a, block), []
                if role == 0:
                    # rows that repeat a doc_id may have several texts
                    if not any(np.array_equal(x, y) for x in firsts):
                        firsts.append(y)
                    continue
                for x in firsts:
                    d = np.setxor1d(x, y, assume_unique=True)
                    both = (x.size + y.size - d.size) // 2
                    rows.append((a, b, bool(both) and 100 * both >= percent * (x.size + y.size - both), x.size, y.size, d.view(np.int64)))
            if rows:
                yield record(schema, *zip(*rows))

    return run


def _shared(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, some columns at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for i in range(0, common.size, columns):
        part = common[i : i + columns]
        sides = []
        for side in (left, right):
            m = np.zeros((len(side), part.size), np.float32)
            for row, s in zip(m, side):
                at = np.searchsorted(part, s)
                at[at == part.size] = 0
                row[at[part[at] == s]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of vertices."""
    root: dict[int, int] = {}

    def top(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(links))):
        a, b = top(int(left[i])), top(int(right[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(left[i]), int(right[j])))
    return out


def comparer(percent: int):
    """Links between a block of one side and a block of the other, by differences to their pivot."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def sides(t: pa.Table):
        t = t.combine_chunks()
        deltas = [np.asarray(d, np.int64) for d in t.column("delta").to_pylist()]
        return t.column("rep").to_numpy(), t.column("component").to_numpy(), t.column("n").to_numpy().astype(np.float64), deltas

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        (i, ci, ni, di), (j, cj, nj, dj) = sides(left), sides(right)
        apart = np.array([d.size for d in di])[:, None] + np.array([d.size for d in dj])[None, :] - 2 * _shared(di, dj)
        whole = ni[:, None] + nj[None, :]
        both = (whole - apart) / 2
        links = (100 * both >= percent * (whole - both)) & (both > 0) & (ci[:, None] != cj[None, :])
        found = _forest(links, i, j)
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], schema=schema)

    return run


def _packed(signature: str, size: int):
    """A signature as an array of longs (eight symbols each), so that comparing is arithmetic."""
    half = lambda i: F.conv(F.hex(F.substring(signature, i + 1, 4)), 16, 10).cast("bigint")
    return F.array(*[F.shiftleft(half(i), 32).bitwiseOR(half(i + 4)) for i in range(0, size, 8)])


def _apart(a, b, size: int):
    """Symbols in which two packed signatures differ."""
    total = None
    for i in range(size // 8):
        x = a[i].bitwiseXOR(b[i])
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        part = F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
        total = part if total is None else total + part
    return total


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, chunks: int = 12, width: int = 6, errors: int = 1) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept, class_id``.

    ``component_id`` is the least doc_id reachable over links of similarity ``percent`` / 100 or
    more, ``class_id`` the least doc_id with the same set. Null, empty and wordless texts link
    with nothing; a null doc_id has a null component and is kept. Rows that repeat a doc_id are
    one node of the graph. Other columns are ignored.
    """
    if (chunks * width) % 8:
        raise ValueError("chunks * width must be a multiple of 8")
    size = chunks * width
    loose, near_ = int(LOOSE * size), int(NEAR * size)
    tables = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = tables.save(docs.mapInArrow(signer(shingle, chunks, width), "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature binary"), "signed")
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["set_a", "set_b", "n_shingles"]
    reps = tables.save(some.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature")), "reps")
    packed = reps.select("rep", F.col("n_shingles").alias("n"), _packed("signature", size).alias("sig"))

    left = packed.select(F.col("rep").alias("pivot"), F.col("sig").alias("sa"))
    right = packed.select("rep", F.col("sig").alias("sb"))

    def stars(keys: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """Pairs near their bucket's pivot, and the members left of buckets with far ones; keys are shuffled once."""
        runs = tables.save(keys.repartitionByRange("key", "rep").sortWithinPartitions("key", "rep").mapInArrow(pivoter(), "key bigint, pivot bigint, rep bigint, edge boolean"), f"runs{level}")
        # buckets that go on from task to task; there are two rows for each task
        edges = runs.where("edge").groupBy("key").agg(F.min("pivot").alias("least"), F.max("pivot").alias("top")).where("least < top").select("key", "least")
        later = runs.select("key", "pivot", "rep").join(F.broadcast(edges), "key", "left")
        held = later.select("key", F.coalesce("least", "pivot").alias("pivot"), "rep").where("pivot <> rep")
        star = held.select("pivot", "rep").distinct().join(left, "pivot").join(right, "rep")
        star = tables.save(star.select("pivot", "rep", _apart(F.col("sa"), F.col("sb"), size).alias("apart")), f"star{level}")
        # a far member and one this close to the pivot are more than ``loose`` apart themselves
        rest = held.join(star.where(F.col("apart") > near_ - loose), ["pivot", "rep"]).select("key", "pivot", "rep", (F.col("apart") > near_).alias("far"))
        rest = tables.save(rest.join(rest.where("far").select("key").distinct(), "key", "left_semi").distinct(), f"rest{level}")
        tables.drop(f"runs{level}")
        return star.where(F.col("apart") <= near_).select(F.col("pivot").alias("a"), F.col("rep").alias("b")), rest

    keys = reps.select("rep", "signature").mapInArrow(keyer(chunks, width, errors), "rep bigint, key bigint")
    near, rest = stars(keys, 1)

    # those left meet again where they share one of their rarest shingles too
    met = tables.save(rest.select("rep", "pivot").distinct(), "met")
    some = sieve(docs, met.select(F.col("rep").alias("doc_id"))).where("maybe").select("doc_id", "text")
    counts = some.mapInArrow(counter(shingle), "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    rare = some.mapInArrow(rarest(shingle, percent, counts), "rep bigint, rare array<bigint>").join(met.select("rep").distinct(), "rep", "left_semi")
    rare = tables.save(rare.select("rep", F.explode("rare").alias("rare")), "rare")
    many = rare.groupBy("rare").agg((F.count("*") > FEW).alias("many"))
    rare = rare.join(many, "rare")
    keys = rare.where("NOT many").select("rep", F.xxhash64("rare").alias("key"))
    keys = keys.unionByName(rare.where("many").join(met, "rep").select("rep", F.xxhash64("rare", "pivot").alias("key")))
    again, rest = stars(keys, 2)
    near = near.unionByName(again).distinct()

    # members far from this pivot too against those that share both
    alike = (F.least("n", "nx") * 100 >= F.greatest("n", "nx") * percent) & (_apart(F.col("sig"), F.col("sx"), size) <= loose)
    far = rest.where("far").select("key", F.col("rep").alias("x")).join(packed.select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("sig").alias("sx")), "x")
    lone = far.join(rest.select("key", "rep").join(packed, "rep"), "key").where((F.col("x") != F.col("rep")) & alike)
    lone = tables.save(lone.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct(), "lone")
    tables.drop("rest1", "rest2", "met", "rare")

    def confirmed(pairs: DataFrame) -> DataFrame:
        blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
        rows = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"), F.lit(1).alias("role"), F.col("b").alias("doc_id"))
        rows = rows.unionByName(blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("a").alias("doc_id")))
        # pairs grow with the corpus: they are merged at every size, and only texts that have one are shuffled
        texts = sieve(docs, rows).where("maybe").drop("maybe").join(rows.hint("merge"), "doc_id")
        grouped = texts.repartition("a", "block").sortWithinPartitions("a", "block", "role")
        return grouped.mapInArrow(confirmer(shingle, percent), "a bigint, b bigint, linked boolean, n_a bigint, n_b bigint, delta array<bigint>")

    around = tables.save(confirmed(near), "around")
    first = tables.save(around.where("linked").select("a", "b").unionByName(confirmed(lone).where("linked").select("a", "b")).distinct(), "links")
    member = connected(first, "a", "b")

    # members of a pivot against each other, across components
    rows = around.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), F.col("n_b").alias("n"), "delta")
    rows = rows.join(member.withColumnRenamed("vertex", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sized = rows.groupBy("pivot", "component").agg(F.count("*").alias("rows"), F.sum(F.size("delta")).alias("load"))
    mixed = sized.groupBy("pivot").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.sum("load").alias("load"), F.max(F.struct("rows", "component", "load")).alias("most"))
    blocks = lambda rows, load: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(load / BLOCK_LOAD), F.lit(1)).cast("int")
    mixed = mixed.where("parts > 1").select("pivot", "main", blocks(F.col("rows"), F.col("load")).alias("ny"), blocks(F.col("rows") - F.col("most.rows"), F.col("load") - F.col("most.load")).alias("nx"))
    open_ = tables.save(rows.join(mixed, "pivot"), "open")
    tables.drop("around")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["pivot", "rep", "component", "n", "delta"]
    minor = open_.where("component <> main").select(*kept, block("nx").alias("x"), each("ny").alias("y"))
    whole = open_.select(*kept, block("ny").alias("y"), each("nx").alias("x"))
    second = tables.save(minor.groupBy("pivot", "x", "y").cogroup(whole.groupBy("pivot", "x", "y")).applyInArrow(comparer(percent), "a bigint, b bigint"), "more")
    tables.drop("open", "star1", "star2", "lone", "links")

    member = connected(member.select(F.col("vertex").alias("a"), F.col("component").alias("b")).unionByName(second), "a", "b")
    classes = reps.select(*same, "rep").join(member.withColumnRenamed("vertex", "rep"), "rep", "left")
    out = signed.where("doc_id IS NOT NULL").drop("signature").join(classes, same, "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"))
    nothing = F.lit(None).cast("bigint")
    out = out.unionByName(signed.where("doc_id IS NULL").select("doc_id", "n_shingles", nothing.alias("component_id"), nothing.alias("class_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the doc_ids of ``gone``; rows that a bitmap of those rules out aren't shuffled."""
    seen = sieve(docs, gone)
    left = seen.where("maybe").join(gone.select("doc_id").hint("merge"), "doc_id", "left_anti")
    return seen.where("NOT maybe").unionByName(left).drop("maybe")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


#: The same in DuckDB: shingles meet by equality and components are walked, which is for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM w),
c AS (SELECT s, len(s) AS n, min(doc_id) AS rep FROM s GROUP BY s),
g AS (SELECT rep, n, unnest(s) AS g FROM c),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM g a JOIN g b ON a.g = b.g AND a.rep < b.rep AND least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT rep AS a, rep AS b FROM c WHERE n > 0 UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS rep, min(b) AS component FROM r GROUP BY 1),
k AS (SELECT s.doc_id, len(s.s) AS n, c.rep, m.component FROM s LEFT JOIN c ON len(s.s) > 0 AND c.s = s.s LEFT JOIN m ON m.rep = c.rep)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept, coalesce(rep, doc_id) AS class_id FROM k
"""

QUERIES = {"op1_minhash_near_dedup": op1_minhash_near_dedup}
ORACLES = {"op1_minhash_near_dedup": ORACLE}
