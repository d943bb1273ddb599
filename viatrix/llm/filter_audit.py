"""Filter interaction audit (operator 13).

Each document fails some of k filters: a mask of k bits. For every part and label, 2**k signed parity sums are taken
over all documents: sum u adds a document with a plus if it fails an even number of the filters in u, otherwise with a
minus. The inverse Walsh-Hadamard transform of these sums gives how many documents have each mask, exactly. From these cells follows
every order in which the filters may be applied, and the Shapley share in closed form: of all k! orders, a document that fails f filters is
removed by each of them in k!/f.
"""

import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from viatrix.llm.words import slices

SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def own_failures(text: str, least_words: int, least_distinct: int, most_capitals: int) -> int:
    """Bits of the filters that look at one text: A too short, B repetitive, C capitals, D symbols."""
    data = text.encode()
    words = data.split()  # bytes are split at ASCII white space only
    short, distinct = len(words) < least_words, len(set(words))
    loud = 100 * (len(data) - len(data.translate(None, CAPITALS))) > most_capitals * len(text)
    return short | (100 * distinct < least_distinct * len(words)) << 1 | loud << 2 | (len(data.translate(None, SYMBOLS)) < len(data)) << 3


def masks(docs: DataFrame, least_words: int = 100, least_distinct: int = 80, most_capitals: int = 10) -> DataFrame:
    """(doc_id, part, mask, n) of docs (doc_id, text, lang; other columns are not read): n rows of one id, text and lang.

    mask: bit 0 (A) under least_words words; bit 1 (B) under least_distinct per cent of words distinct; bit 2 (C) over most_capitals per cent
    of code points in A-Z; bit 3 (D) holds one of #$%&*|; bit 4 (E) the same text stands at a smaller doc_id. A null text counts as empty,
    part is lang or empty. Rows of one doc_id are no copies of each other; a row without an id is no copy and has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [own_failures(t or "", least_words, least_distinct, most_capitals) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(found, pa.int32())], names=["doc_id", "part", "digest", "mask"])

    told = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"))
    told = told.mapInArrow(run, "doc_id long, part string, digest binary, mask int")
    # repeated rows become one, so that no id and digest together are common
    told = told.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = told.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    # by id and digest: each is met once, however many copies a text has
    told = told.join(first, ["doc_id", "digest"], "left")
    copy = (F.col("first").isNull() & F.col("doc_id").isNotNull()).cast("int")
    return told.select("doc_id", "part", (F.col("mask") + 16 * copy).alias("mask"), "n")


def sign(a: F.Column, b: F.Column) -> F.Column:
    return F.when(F.bit_count(a.bitwiseAND(b)) % 2 == 0, F.lit(1)).otherwise(F.lit(-1)).cast("long")


def parity_sums(masked: DataFrame, k: int, counts: list[str]) -> DataFrame:
    """(part, label, sums): 2**k signed sums for each of the columns counts of masked (part, mask, ...), which name the labels."""
    size = 1 << k
    # few partial rows a task: each part has 2**k masks at most
    sums = [F.sum(sign(F.col("mask"), F.lit(u)) * F.col(c)).alias(f"{c}_{u}") for c in counts for u in range(size)]
    wide = masked.groupBy("part").agg(*sums)
    told = F.array(*[F.struct(F.lit(c).alias("label"), F.array(*[F.col(f"{c}_{u}") for u in range(size)]).alias("sums")) for c in counts])
    return wide.select("part", F.explode(told).alias("s")).select("part", "s.*")


def cells(sums: DataFrame, k: int) -> DataFrame:
    """(part, label, cells): documents of each mask, in its order; the sums' transform divided by 2**k, which leaves nothing over."""
    size = 1 << k
    back = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.aggregate(F.transform("sums", lambda s, u: s * sign(m, u)), F.lit(0).cast("long"), lambda x, y: x + y))
    return sums.select("part", "label", F.transform(back, lambda x: F.shiftright(x, k)).alias("cells"))  # a division without remainder


def audit(masked: DataFrame, names: str = "ABCDE", labels: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, <label>_lost, shapley.

    masked: (part, mask, n, and for each label how many of the n bear it). Rows with zeros stay. No rows give no parts.
    """
    k = len(names)
    told = cells(parity_sums(masked, k, ["n", *labels]), k)
    parts = told.groupBy("part").agg(*[F.first(F.when(F.col("label") == c, F.col("cells")), ignorenulls=True).alias(c) for c in ["n", *labels]])
    orders = F.array(*[F.lit("".join(o)) for o in itertools.permutations(names)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    bit = f"shiftleft(1, instr('{names}', substr(filter_order, i, 1)) - 1)"
    steps = steps.withColumn("own", F.expr(bit.replace("i, 1)", "step, 1)"))).withColumn("before", F.expr(f"aggregate(filter(sequence(1, {k}), i -> i < step), 0, (x, i) -> x + {bit})"))
    own, before = F.col("own"), F.col("before")
    shares = F.array(*[F.lit(math.factorial(k) // max(f, 1)).cast("long") for f in range(k + 1)])  # by the number of filters failed

    def total(cell: str, wanted, weight=lambda m: F.lit(1)) -> F.Column:
        held = F.transform(cell, lambda x, m: F.when(wanted(m), x * weight(m)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(held, F.lit(0).cast("long"), lambda x, y: x + y)

    fails = lambda m: m.bitwiseAND(own) != 0
    clean = lambda m: m.bitwiseAND(before) == 0
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(before + own) == 0).alias("kept"),
        total("n", lambda m: fails(m) & clean(m)).alias("removed"),
        total("n", lambda m: fails(m) & ~clean(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        *[total(c, lambda m: fails(m) & clean(m)).alias(f"{c}_lost") for c in labels],
        total("n", fails, lambda m: F.get(shares, F.bit_count(m))).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """audit() of the five filters of masks() over docs, with labels (doc_id, quality, toxic).

    A document is good if a row of its id has quality 1, toxic if one has toxic 1; ids without labels, and rows without an id, are neither.
    """
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    told = masks(docs, **bounds).join(marked, "doc_id", "left")
    return audit(told.select("part", "mask", "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]))
