"""Parity-sketch join on word shingles (operator 6).

A document's set holds the 64-bit hashes of its distinct 5-word shingles. A sketch of a set deals its
members into k parts and keeps the XOR of each part, so two sets differ in at most as many parts as
their symmetric difference has members. With Jaccard similarity t or more that difference is at
most (a + b)(1 - t)/(1 + t) for sizes a and b, so with more non-empty parts than that, one at least
agrees: sketches are joined on single parts (pigeonhole). k depends on the size band, and a set
whose partners may lie in the next band enters that band as well. A set with too few non-empty
parts adds keys for its empty ones, and since any pair that no non-empty part joins has two such sets,
none is lost. k leaves parts to spare, so a set too many of whose parts nobody shares is done
with at once, and the parts of passages that many documents hold are passed over for rarer ones.

Within a key's documents no pairs are made. First each document is compared with one hub, the document
with most neighbours, and components of those links are labels. Only documents of one key with different
labels are compared after that, in blocks of bounded size; a block sends on the links that join labels, a forest, and no
pair else. The components are exact, and of n near copies of one original about n rows move.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from viatrix.llm.components import components
from viatrix.llm.store import Cuts
from viatrix.llm.words import Hasher, mix, shingle_hashes, slices, split, strings

RATIO = 1.75
#: sets that a task remembers, to give keys once for copies; beyond it begins anew, and some keys come twice
SEEN = 50_000


def band_edges(most: int = 2**40) -> np.ndarray:
    """First size of each band; the last lies beyond any text."""
    edges, x = [1], 1.0
    while edges[-1] < most:
        x *= RATIO
        edges.append(max(edges[-1] + 1, int(np.ceil(x))))
    return np.array(edges, np.int64)


def sets_of(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """doc ids and sorted sets of shingle hashes, by slices of the input (doc_id, text)."""
    hasher = Hasher(seed=6)
    for batch in slices(batches, 1):
        data, offsets = strings(batch.column(1))
        starts, ends, first = split(data, offsets)
        found, at = shingle_hashes(hasher.spans(data, starts, ends), first, k)
        yield batch.column(0).to_pylist(), [np.unique(found[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def bands(n: int, numerator: int, denominator: int, edges: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(band, parts, parts that may differ) where partners of a set of size n may lie: two bands at most, one after the other."""
    largest = n * denominator // numerator
    own = int(np.searchsorted(edges, n, side="right")) - 1
    for band in range(own, int(np.searchsorted(edges, largest, side="right"))):
        top = int(edges[band + 1]) - 1
        apart = (n + min(top, largest)) * (denominator - numerator) // (denominator + numerator)
        if apart:
            yield band, top * 2 * (denominator - numerator) // (denominator + numerator) * 8 // 5 + 4, apart


def sketch_parts(members: np.ndarray, numerator: int, denominator: int, edges: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(band, spare, part names, XORs) for each of its bands; numerator/denominator is the similarity.

    A partner shares more than ``spare`` of these parts; if empty ones are among them, only a partner that names its
    empty parts too does, and any other shares a non-empty one.
    """
    out = []
    for band, k, apart in bands(len(members), numerator, denominator, edges):
        part = ((members >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # ascending, as members are
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        xors = np.bitwise_xor.reduceat(mix(members), begin)
        name = part[begin]
        if len(begin) <= apart:
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), name)
            name, xors = np.concatenate([name, empty]), np.concatenate([xors, np.zeros(len(empty), np.uint64)])
        out.append((band, len(name) - apart - 1, name, xors))
    return out


def spare_parts(members: np.ndarray, numerator: int, denominator: int, edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """(band, spare) as sketch_parts has them, without the sketches; all bits of spare are turned if empty parts are named."""
    for band, k, apart in bands(len(members), numerator, denominator, edges):
        part = ((members >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        some = 1 + int(np.count_nonzero(part[1:] != part[:-1]))
        yield band, some - apart - 1 if some > apart else ~(k - apart - 1)


def digest(members: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed numbers."""
    if not len(members):
        return 0, 0
    two = np.array([np.bitwise_xor.reduce(members), np.add.reduce(mix(members))], np.uint64)
    return tuple(two.view(np.int64).tolist())


def shingle_sets(docs: DataFrame, k: int, numerator: int, denominator: int) -> DataFrame:
    """(doc_id, n, d1, d2, even, odd): size and digest of every set, and its spare parts in its band of even and of odd number, with all bits turned if it names empty parts."""

    def run(batches):
        edges = band_edges()
        for ids, sets in sets_of(batches, k):
            rows = []
            for i, s in zip(ids, sets):
                spare = [None, None]
                for band, left in spare_parts(s, numerator, denominator, edges) if len(s) else ():
                    spare[band % 2] = left
                rows.append((i, len(s), *digest(s), *spare))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "n", "d1", "d2", "even", "odd"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, even long, odd long")


def sketch_keys(docs: DataFrame, k: int, numerator: int, denominator: int) -> DataFrame:
    """(key, d2): sketch parts, the band's parity in the lowest bit and 1 in the next for an empty part, and half the set's digest; of equal sets in one task mostly only the first gives keys.

    Should two sets have the same half, the rows of either stand for both, and none is lost.
    """

    def run(batches):
        edges, seen = band_edges(), set()
        for _, sets in sets_of(batches, k):
            keys, of = [], []
            for s in sets:
                told = digest(s)
                if not len(s) or told in seen:
                    continue
                if len(seen) == SEEN:
                    seen.clear()
                seen.add(told)
                for band, _, name, xors in sketch_parts(s, numerator, denominator, edges):
                    x = mix(xors ^ mix(name + np.uint64((band + 1) << 40)))
                    keys.append((x & ~np.uint64(3)) | (xors == 0).astype(np.uint64) << np.uint64(1) | np.uint64(band % 2))
                    of.append((told[1], len(x)))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array([i for i, _ in of], np.int64), [m for _, m in of]))], names=["key", "d2"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, d2 long")


def key_groups(keys: DataFrame) -> DataFrame:
    """Those of keys (key, d2) that stand in two rows or more."""

    def run(batches):
        last = None  # the last row, held back until the next one's key is known
        before = None  # the key before it
        for batch in batches:
            key, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            if last is not None:
                key, doc = np.concatenate([last[0], key]), np.concatenate([last[1], doc])
            same = key[1:] == key[:-1]
            many = np.concatenate([[before is not None and key[0] == before], same])
            many[:-1] |= same
            if len(key) > 1:
                before = key[-2]
            last = key[-1:], doc[-1:], many[-1]
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][many[:-1]]), pa.array(doc[:-1][many[:-1]])], names=["key", "d2"])
        if last is not None and last[2]:
            yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1])], names=["key", "d2"])

    # one sort column: Spark sorts it by radix
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, d2 long")


def candidate_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, bits, members): parity bits and hashes of each set.

    Bit i of the sketch is the parity of the members whose mixed hash ends in i; its length is a power of
    two, from four to eight times the set's size, and halves by XOR to meet a shorter one.
    """

    def run(batches):
        for ids, sets in sets_of(batches, k):
            bits = []
            for s in sets:
                size = 1 << max(6, (4 * len(s) - 1).bit_length())
                at = (mix(s ^ np.uint64(0xA5A5)) & np.uint64(size - 1)).astype(np.int64)
                bits.append(np.packbits((np.bincount(at, minlength=size) & 1).astype(bool)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bits, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "bits", "members"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, n long, bits binary, members binary")


def differing(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference: odd bits of the sketches' XOR, at the shorter one's length."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def similar(x: np.ndarray, y: np.ndarray, numerator: int, denominator: int) -> bool:
    """Whether two sorted sets are similar enough, by exact counts."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return denominator * common >= numerator * (len(both) - common)


def verified(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int, cuts: Cuts) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar enough: by the sketches' bound first, then by exact counts."""

    def may(batches):
        for batch in batches:
            keep = []
            for n, x, m, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                keep.append(numerator * max(n, m) <= denominator * min(n, m) and differing(x, y) * (denominator + numerator) <= (n + m) * (denominator - numerator))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def run(batches):
        for batch in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), numerator, denominator) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def beside(frame: DataFrame, end: str, *columns: str) -> DataFrame:
        return frame.join(sets.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)

    near = cuts.cut(beside(beside(pairs, "a", "n", "bits"), "b", "n", "bits").select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(may, "a long, b long"))
    found = cuts.cut(beside(beside(near, "a", "members"), "b", "members").select("a", "b", "members_a", "members_b").mapInArrow(run, "a long, b long"))
    cuts.drop(near)
    return found


def bridges(held: DataFrame, sets: DataFrame, numerator: int, denominator: int, cuts: Cuts, most: int = 1024, mb: int = 8) -> DataFrame:
    """(a, b): links that join the labels of each group, a forest a block.

    held: (home, doc_id, label). Documents of a group's commonest label need no comparison among themselves, so
    the others are dealt into blocks of about ``most`` documents and ``mb`` MB, and all into blocks of the same size; one
    block of either kind meets in a task, which holds no more than these two. Documents of unlike labels
    are compared by the sketches' bound and then exactly, unless links of the same block have joined their labels.
    """
    told = held.join(sets.select(F.col("id").alias("doc_id"), (F.length("members") + F.length("bits")).alias("size")), "doc_id")
    many = told.groupBy("home", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    sizes = many.groupBy("home").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "label", "size")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")

    def dealt(n, size):
        return F.ceil(F.greatest(n / F.lit(most), size / F.lit(mb * 10**6))).cast("int")

    sizes = sizes.select("home", F.col("top.label").alias("common"), dealt(F.col("n"), F.col("size")).alias("cols"), dealt(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("rows"))
    told = cuts.cut(held.join(sizes, "home").withColumnRenamed("doc_id", "id"))
    own = told.where("label <> common").select("home", "id", "label", F.pmod(F.xxhash64("id"), "rows").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), F.lit(True).alias("own"))
    all_ = told.select("home", "id", "label", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(F.xxhash64("id", F.lit(7)), "cols").cast("int").alias("j"), F.lit(False).alias("own"))
    blocks = own.unionByName(all_.select(own.columns)).join(sets, "id")

    def run(table: pa.Table) -> pa.Table:
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        own = table.column("own").to_numpy(zero_copy_only=False)
        _, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
        bits = [np.frombuffer(x, np.uint64) for x in table.column("bits").to_pylist()]
        width = min(len(x) for x in bits)
        bits = np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in bits])
        members = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
        root = np.arange(label.max(initial=0) + 1)
        others = np.flatnonzero(~own)
        mine = set(ids[own].tolist())
        first = np.array([x not in mine for x in ids[others].tolist()], bool)  # pairs of two own documents count once
        a, b = [], []
        for r in np.flatnonzero(own):
            far = (root[label[others]] != root[label[r]]) & (first | (ids[others] > ids[r]))
            other = others[far & (numerator * np.maximum(n[others], n[r]) <= denominator * np.minimum(n[others], n[r]))]
            odd = np.bitwise_count(bits[other] ^ bits[r]).sum(axis=1)
            near = odd * (denominator + numerator) <= (n[other] + n[r]) * (denominator - numerator)
            other = other[near][np.argsort(odd[near], kind="stable")]
            while len(other):
                o, other = other[0], other[1:]
                if similar(members[r], members[o], numerator, denominator):
                    a.append(int(ids[r]))
                    b.append(int(ids[o]))
                    root[root == root[label[o]]] = root[label[r]]
                    other = other[root[label[other]] != root[label[r]]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = cuts.cut(blocks.groupBy("home", "i", "j").applyInArrow(run, "a long, b long"))
    cuts.drop(told)
    return found


def near_groups(docs: DataFrame, k: int = 5, numerator: int = 75, denominator: int = 100, block: int = 1024) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_alike) for every row of docs (doc_id, text, any others).

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A null, empty or blank
    text has an empty set and stands alone; one with fewer than k words has its whole sequence as one
    shingle. n_alike counts the rows with the very same set. doc_id must be a key; rows repeated
    altogether count each and lie in one component. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark, "ngram")
    docs = docs.select("doc_id", "text")
    stats = cuts.cut(shingle_sets(docs, k, numerator, denominator))
    alike = cuts.cut(stats.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_alike")))
    member = cuts.cut(stats.join(alike, ["n", "d1", "d2"], "left").select("doc_id", "n", "d2", "even", "odd", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("n_alike", F.lit(1)).alias("n_alike")))
    cuts.drop(stats, alike)
    # sets that several tasks met count once
    told = cuts.cut(key_groups(sketch_keys(docs, k, numerator, denominator)))
    groups = told.distinct()
    sizes = groups.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # a set with more unshared parts than a partner may lack has no partner, and of the shared ones the
    # rarest suffice: of all parts in order of size, a pair meets among the first of either set, without as many as are spare
    spare = F.when(F.col("key").bitwiseAND(F.lit(1)) == 0, F.col("even")).otherwise(F.col("odd"))
    held = Window.partitionBy("doc_id", "spare", F.col("key").bitwiseAND(F.lit(1)))
    reps = member.where("doc_id = rep and n > 0").select("d2", "doc_id", "even", "odd")
    shared = groups.join(sizes, "key").join(reps, "d2").select("key", "doc_id", "size", spare.alias("spare"))
    # where a set names empty parts, its partner may name none: then all its non-empty parts stay
    shared = shared.withColumn("have", F.count(F.lit(1)).over(held)).withColumn("thin", (F.col("spare") < 0) & (F.col("key").bitwiseAND(F.lit(2)) == 0)).withColumn("spare", F.greatest("spare", F.bitwise_not("spare")))
    shared = shared.where("thin or have > spare").withColumn("nth", F.row_number().over(held.orderBy("size", "key"))).where("thin or nth <= have - spare")
    few = cuts.cut(shared.select("key", "doc_id"))
    cuts.drop(told)
    sizes = few.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = cuts.cut(few.join(sizes, "key"))
    cuts.drop(few)
    sets = cuts.cut(candidate_sets(docs.join(groups.select("doc_id").distinct(), "doc_id"), k))
    # the hub of a key is its document with most neighbours: the original rather than one of its variants
    rank = cuts.cut(groups.groupBy("doc_id").agg(F.sum("size").alias("rank")))
    hubs = groups.join(rank, "doc_id").groupBy("key").agg(F.max(F.struct("rank", F.negative("doc_id").alias("h"))).alias("m")).select("key", F.negative("m.h").alias("hub"))
    stars = groups.join(hubs, "key").where("doc_id <> hub").groupBy("doc_id", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = cuts.cut(stars.groupBy("doc_id").agg(F.max(F.struct("n", F.negative("hub").alias("h"))).alias("m")).select("doc_id", F.negative("m.h").alias("hub")))
    first = best.select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct()
    links = verified(first, sets, numerator, denominator, cuts)
    labels = components(links, cuts)
    # a hub's hub ranks no lower, so a few steps gather most variants of one original under one home
    own = rank.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("hub", "doc_id").alias("hub"))
    for _ in range(2):
        own = cuts.cut(own.join(own.toDF("hub", "onward"), "hub").select("doc_id", F.col("onward").alias("hub")))
    own = own.join(rank.withColumnsRenamed({"doc_id": "hub", "rank": "r"}), "hub").select("doc_id", F.struct("r", F.negative("hub").alias("h")).alias("hub"))
    own = own.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "hub", F.coalesce("component", "doc_id").alias("label"))
    # documents of one key and of different labels all go to the home of the key: the first of their hubs
    named = cuts.cut(groups.select("key", "doc_id").join(own, "doc_id"))
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.negative(F.max("hub")["h"]).alias("home")).where("lo < hi").select("key", "home")
    held = cuts.cut(named.join(mixed, "key").groupBy("home", "doc_id").agg(F.first("label").alias("label")))
    links = links.union(bridges(held, sets, numerator, denominator, cuts, block))
    final = components(links, cuts)
    cuts.drop_but(member, final)
    out = member.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"), "n_alike")
