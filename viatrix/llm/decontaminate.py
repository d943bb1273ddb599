"""Benchmark decontamination (operator 7), in DataFrame functions only.

A document is leaked if one of its windows is similar to a benchmark item: a window of as many
words as the item has (the whole document, if it is shorter), whose multiset of 5-word shingles has a
weighted Jaccard similarity of ``numerator/denominator`` or more with the item's (each shingle
weighs as often as it stands there).

Windows: every window of an item's size is laid, at every word, but where no shingle of any item of that size is inside, for
such a window has similarity 0 with all of them. Windows of one size in a row form a stretch.
Fingerprints: 64-bit SimHashes over words, each told from its like by its number of occurrence in the window, so that a
word that repeats weighs no more in a bit than words that do not. A word is a window's n-th of its kind for starts in one interval, so
it is added where that begins and taken off where it ends; running sums over starts give all windows of a stretch.
Candidates: a multi-index. A fingerprint is cut into BLOCKS blocks; two within RADIUS bits differ in NEAR bits
or fewer in one block at least. Each item's blocks are indexed with all their neighbours within NEAR bits, windows are looked
up among all items of their size, and the Hamming distance of what is found is checked.
Verification: exact shingle counts of every candidate. Nothing is capped.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from viatrix.llm.store import Cuts

#: Bits of a block in which its neighbours may differ, blocks, and the radius that they guarantee. At similarity 0.75 six
#: sevenths of the shingles are common, and so at least of the words with their numbers: fingerprints differ in 11 bits with a deviation of 3.
NEAR, BLOCKS = 3, 5
RADIUS = BLOCKS * (NEAR + 1) - 1
#: two bits are counted in one sum, in lanes of 32 bits: more than the words of any text
LANES = 0x0000000100000001
#: rows of a table that is sent to all executors; a longer one is joined by shuffle
SMALL = 100_000


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space, A-Z in lower case."""
    plain = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def shingles(words: Column, k: int) -> Column:
    """Hashes of runs of k words, in order; none if there are fewer words."""
    n = F.array_size(words) - k
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<long>"))


def fingerprint(counts: list[Column], n: Column) -> Column:
    """Bit b is set if more than half of n words have it; sum b holds the counts of bits b and b + 32."""
    bits = None
    for b, both in enumerate(counts):
        for lane in (0, 32):
            count = F.shiftrightunsigned(both, lane).bitwiseAND(F.lit(0xFFFFFFFF))
            bit = F.when(count * 2 > n, F.lit(1 << (b + lane) if b + lane < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
            bits = bit if bits is None else bits.bitwiseOR(bit)
    return bits


def lanes(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, b).bitwiseAND(F.lit(LANES)) for b in range(32)]


def simhashes(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and fingerprint of texts (keys, words)."""
    told = texts.select(*keys, F.posexplode("words").alias("at", "w")).select(*keys, "at", F.xxhash64("w").alias("h"))
    told = told.withColumn("h", F.xxhash64("h", F.row_number().over(Window.partitionBy(*keys, "h").orderBy("at"))))
    sums = told.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{b}") for b, x in enumerate(lanes(F.col("h")))])
    return sums.select(*keys, fingerprint([F.col(f"s{b}") for b in range(32)], F.col("n")).alias("fingerprint"))


def blocks(print_: Column, near: int = 0) -> Column:
    """(number, bits) of all blocks of a fingerprint, with those of up to ``near`` other bits."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]

    def block(i: int) -> Column:
        top = F.lit((1 << (edges[i + 1] - edges[i])) - 1).cast("long")
        own = F.shiftrightunsigned(print_, edges[i]).bitwiseAND(top)
        turns = F.filter(F.sequence(F.lit(0).cast("long"), top), lambda m: F.bit_count(m) <= near) if near else F.array(F.lit(0).cast("long"))
        return F.transform(turns, lambda m: F.struct(F.lit(i).alias("number"), own.bitwiseXOR(m).alias("bits")))

    return F.flatten(F.array(*[block(i) for i in range(BLOCKS)]))


def united(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lo, hi of spans (keys, lo, hi) with those that touch or overlap made one."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("begun", F.when(F.col("lo") <= before + 1, 0).otherwise(1))
    numbered = begun.withColumn("number", F.sum("begun").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "number").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("number")


def window_prints(docs: DataFrame, stretches: DataFrame, longest: int, cuts: Cuts) -> DataFrame:
    """(doc_id, v, size, many, start, fingerprint) of every window of stretches (doc_id, v, size, many, lo, hi).

    many is a window's number of words, ``longest`` at most; docs: (doc_id, v, text), one row each. All steps after the join go
    by document, as the join does, so that nothing is shuffled again.
    """
    doc = ["doc_id", "v"]
    key = [*doc, "size", "many", "lo", "hi"]
    areas = stretches.groupBy(*doc).agg(F.collect_list(F.struct("size", "many", "lo", "hi")).alias("areas"))  # of one document
    # hashes are made once a document, its stretches are slices of them
    told = docs.hint("merge").join(areas, doc).select(*doc, "areas", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("all"))
    told = told.select(*doc, "all", F.explode("areas").alias("x")).select(*doc, "x.*", F.slice("all", F.col("x.lo") + 1, F.col("x.hi") - F.col("x.lo") + F.col("x.many")).alias("own"))
    told = told.select(*key, F.posexplode("own").alias("at", "h")).withColumn("at", F.col("at") + F.col("lo"))
    like = Window.partitionBy(*key, "h").orderBy("at").rangeBetween(1 - longest, 0)
    # the word's own place and those of its like that a window can hold with it, from the last to the first
    before = F.reverse(F.sort_array(F.filter(F.collect_list("at").over(like), lambda x: x > F.col("at") - F.col("many"))))
    told = told.withColumn("like", before)
    # the n-th of its kind for starts behind the next place and up to the n-th
    begins = F.greatest(F.coalesce(F.get("like", F.col("n") + 1), F.col("at") - F.col("many")) + 1, F.col("lo"))
    told = told.select(*key, "h", "at", "like", F.explode(F.sequence(F.lit(0), F.array_size("like") - 1)).alias("n"))
    told = told.select(*key, F.xxhash64("h", F.col("n") + 1).alias("h"), begins.alias("begin"), F.least(F.get("like", F.col("n")), F.col("hi")).alias("end")).where("begin <= end")
    turn = F.array(F.struct(F.lit(1).cast("long").alias("sign"), F.col("begin").alias("start")), F.struct(F.lit(-1).cast("long").alias("sign"), (F.col("end") + 1).alias("start")))
    told = told.select(*key, "h", F.explode(turn).alias("t")).select(*key, "h", "t.*").where("start <= hi")
    order = Window.partitionBy(*key).orderBy("start")
    running = order.rangeBetween(Window.unboundedPreceding, 0)
    sums = told.select(*key, "start", F.lead("start").over(order).alias("next"), *[F.sum(x * F.col("sign")).over(running).alias(f"s{b}") for b, x in enumerate(lanes(F.col("h")))])
    sums = sums.where("next is null or next > start")  # one row a start
    return cuts.cut(sums.select(*doc, "size", "many", "start", fingerprint([F.col(f"s{b}") for b in range(32)], F.col("many")).alias("fingerprint")))


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, numerator: int = 75, denominator: int = 100) -> DataFrame:
    """(doc_id, item_id, start, similarity): the best window of every leaked document and item; ties go to the first.

    docs (doc_id, text) and benchmark (item_id, text) may have any other columns. Null, empty and blank
    texts and items match nothing. Items of fewer than k words are found where their whole word
    sequence stands. Rows with one doc_id or item_id and unlike texts are taken as versions of one, and rows that
    repeat altogether count once; rows without an id are left out. Empty tables give an empty result.
    """
    cuts = Cuts(docs.sparkSession, "leaks")
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.array_size("words") > 0).where("item_id is not null").distinct()
    items = cuts.cut(items.select("item_id", "words", F.xxhash64("words").alias("version"), F.array_size("words").alias("size"), F.least(F.array_size("words"), F.lit(k)).alias("k")))
    ks = sorted(r["k"] for r in items.select("k").distinct().collect())  # k values at most
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("v")).where("text is not null and doc_id is not null")
    split = docs.select("doc_id", "v", words_of(F.col("text")).alias("all"))  # a column of its own: made once a row
    split = split.select("doc_id", "v", "all", F.array_size("all").alias("words"))  # no list goes along with what is exploded
    item, doc = ["item_id", "version"], ["doc_id", "v"]

    def sent(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if frame.count() <= SMALL else frame

    found = None
    for n in ks:  # one pass, and another for each length of items shorter than k
        sized = cuts.cut(items.where(F.col("k") == n).select("size", F.explode(shingles(F.col("words"), n)).alias("h")).distinct())
        place = split.select(*doc, "words", F.posexplode(shingles(F.col("all"), n)).alias("p", "h"))
        many = F.least("size", "words")
        hits = place.join(sent(sized), "h").select(*doc, "size", many.alias("many"), F.lit(n).alias("k"), F.greatest(F.lit(0), F.col("p") + n - many).alias("lo"), F.least(F.col("p"), F.col("words") - many).alias("hi"))
        found = hits if found is None else found.union(hits)
    schema = "doc_id long, item_id long, start int, similarity double"
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    found = cuts.cut(found)
    stretches = cuts.cut(united(found, [*doc, "size", "many", "k"]))
    some = stretches.select(*doc).distinct()
    texts = cuts.cut(docs.join(some, doc).groupBy(*doc).agg(F.first("text").alias("text")))
    longest = items.agg(F.max("size").alias("n")).first()["n"]
    ours = window_prints(texts, stretches.select(*doc, "size", "many", "lo", "hi"), longest, cuts)
    theirs = simhashes(items.select(*item, "size", "words"), [*item, "size"]).withColumnRenamed("fingerprint", "theirs")
    index = cuts.cut(theirs.select(*item, "size", "theirs", F.explode(blocks(F.col("theirs"), NEAR)).alias("b")).select(*item, "size", "theirs", "b.*"))
    looked = ours.select(*doc, "size", "many", "start", "fingerprint", F.explode(blocks(F.col("fingerprint"))).alias("b")).select(*doc, "size", "many", "start", "fingerprint", "b.*")
    near = looked.join(sent(index), ["size", "number", "bits"])
    at = [*doc, "size", "many", "start", *item]
    near = cuts.cut(near.where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("theirs"))) <= RADIUS).select(*at).distinct())

    def counted(frame: DataFrame, by: list[str]) -> DataFrame:
        hashes = None
        for n in ks:
            hashes = F.when(F.col("k") == n, shingles(F.col("words"), n)) if hashes is None else hashes.when(F.col("k") == n, shingles(F.col("words"), n))
        return frame.select(*by, F.explode(hashes).alias("h")).groupBy(*by, "h").agg(F.count(F.lit(1)).alias("n"))

    place = [*doc, "start", "many", "size"]
    laid = near.select(*place).distinct().groupBy(*doc).agg(F.collect_list(F.struct("start", "many", "size")).alias("w"))  # of one document
    laid = texts.join(laid, doc).select(*doc, "w", words_of(F.col("text")).alias("all")).select(*doc, "all", F.explode("w").alias("w"))
    laid = laid.select(*doc, "w.*", F.least("w.size", F.lit(k)).alias("k"), F.slice("all", F.col("w.start") + 1, F.col("w.many")).alias("words"))
    shares = counted(laid, place).withColumn("total", F.sum("n").over(Window.partitionBy(*place)))
    own = counted(items, item).withColumnRenamed("n", "m")
    whole = items.select(*item, (F.col("size") - F.col("k") + 1).alias("item_total"))
    # windows as short as their text have fewer shingles than the item
    pairs = near.join(shares, place).join(sent(own), [*item, "h"]).groupBy(*at).agg(F.sum(F.least("n", "m")).alias("common"), F.first("total").alias("total"))
    told = pairs.join(sent(whole), item)
    union = F.col("total") + F.col("item_total") - F.col("common")
    told = told.where(denominator * F.col("common") >= numerator * union).withColumn("similarity", F.col("common") / union)
    best = told.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", F.negative("start").alias("s"))).alias("m"))
    out = cuts.cut(best.select("doc_id", "item_id", F.negative("m.s").cast("int").alias("start"), "m.similarity"))
    cuts.drop_but(out)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, leaked, n_items, item_ids, similarity) of every row of docs; similarity is the greatest, null if clean."""
    found = leaks(docs, benchmark, **how).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("item_id")).alias("items"), F.max("similarity").alias("similarity"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", F.col("n").isNotNull().alias("leaked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<long>")).alias("item_ids"), "similarity")
