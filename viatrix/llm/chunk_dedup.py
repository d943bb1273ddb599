"""Substring dedup by content-defined chunking (operator 5).

A gear hash rolls over the bytes of each text; where its value has given bits zero a chunk ends, but no
sooner than LEAST bytes after the last end and no later than MOST. Ends depend on the bytes just
before them only, so after an insertion they fall into step again. Chunks with one 128-bit digest are
copies. A run of neighbouring chunks that have copies in documents of smaller doc_id, or sooner in their own, is a
repeated span if it has ``span`` bytes or more.
"""

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from viatrix.llm.store import Cuts, fresh
from viatrix.llm.words import Hasher, slices, strings

LEAST, MOST, BITS = 16, 96, 5


def ends_of(data: np.ndarray, block: int = 1 << 21) -> np.ndarray:
    """Positions behind which a chunk may end: the gear hash of the last 16 bytes, in four doubling steps; long texts go block by block."""
    if len(data) > block:
        parts = [(lo, max(lo - 16, 0)) for lo in range(0, len(data), block)]
        found = [(lo, a + ends_of(data[a : lo + block], 2 * block + 16)) for lo, a in parts]
        return np.concatenate([x[x > lo] for lo, x in found])
    gear = np.random.default_rng(50).integers(0, 2**32, 256, dtype=np.uint32)
    h = gear[data]
    for step in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] if len(h) > step else shifted[step:]
        h = h + (shifted << np.uint32(step))
    return np.flatnonzero((h >> np.uint32(11)) & np.uint32((1 << BITS) - 1) == 0) + 1


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all chunks, and the text of each. A text's first bytes see nothing of the text before."""
    starts, ends, of = [], [], []
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        may = (ends_of(data[a:b]) + a).tolist()
        while a < b:
            k = bisect.bisect_left(may, a + LEAST)
            e = min(may[k] if k < len(may) else b, a + MOST, b)
            starts.append(a)
            ends.append(e)
            of.append(d)
            a = e
    return np.array(starts, np.int64), np.array(ends, np.int64), np.array(of, np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """(d1, d2, doc_id, start, length): every chunk of every text, in bytes of UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Hasher(seed=51, lower=False), Hasher(seed=52, lower=False)
        for batch in slices(batches, 1):
            data, offsets = strings(batch.column(1))
            starts, ends, of = chunk_bounds(data, offsets)
            if len(starts):
                ids = batch.column(0).to_numpy()[of]
                yield pa.RecordBatch.from_arrays([pa.array(one.spans(data, starts, ends).view(np.int64)), pa.array(two.spans(data, starts, ends).view(np.int64)), pa.array(ids), pa.array((starts - offsets[of]).astype(np.int32)), pa.array((ends - starts).astype(np.int32))], names=["d1", "d2", "doc_id", "start", "length"])

    return docs.select("doc_id", "text").where("text is not null").mapInArrow(run, "d1 long, d2 long, doc_id long, start int, length int")


def repeats(docs: DataFrame, span: int = 100) -> DataFrame:
    """(doc_id, start, end, first_doc_id, n_chunks): repeated spans in bytes, with the smallest document that has the first chunk.

    Only docs' doc_id (a key) and text are read; rows repeated altogether stand for one. Null and empty texts have no chunks. first_doc_id is
    doc_id itself where a passage stands sooner in the same document alone. An empty table gives an empty result.
    """
    cuts = Cuts(docs.sparkSession, "chunks")
    first = chunks(docs).groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "start")).alias("m"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # a table of its own: a join of two plain shuffles can split the rows of a chunk that very many documents hold
    first = cuts.cut(first.select("d1", "d2", F.col("m.doc_id").alias("first_doc_id"), F.col("m.start").alias("first_start")))
    # chunks are made twice: they take less time than a table of all of them takes room
    again = cuts.cut(chunks(docs).join(first, ["d1", "d2"]).where("doc_id > first_doc_id or start > first_start").select("doc_id", "start", "length", "first_doc_id"))
    cuts.drop(first)
    w = Window.partitionBy("doc_id").orderBy("start")  # a document's own chunks
    begun = F.when(F.lag(F.col("start") + F.col("length")).over(w) >= F.col("start"), 0).otherwise(1)
    same = F.coalesce(F.lag("start").over(w) == F.col("start"), F.lit(False))  # of repeated rows
    runs = again.withColumns({"begun": begun, "same": same}).withColumn("run", F.sum("begun").over(w))
    runs = runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), F.min(F.struct("start", "first_doc_id")).alias("m"), F.count(F.when(~F.col("same"), 1)).alias("n_chunks"))
    return runs.where(F.col("end") - F.col("start") >= span).select("doc_id", "start", "end", F.col("m.first_doc_id").alias("first_doc_id"), "n_chunks")


def without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the spans (doc_id, start, end; in bytes, apart) cut out of text."""
    key, of, names = fresh("key", docs.columns), fresh("spans", docs.columns), docs.columns
    cut = spans.groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            out = []
            for text, spans_ in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                if spans_:
                    raw, a, kept = text.encode("utf-8"), 0, []
                    for s in spans_:
                        kept.append(raw[a : s["start"]])
                        a = s["end"]
                    # a cut inside a character takes the rest of it
                    text = b"".join([*kept, raw[a:]]).decode("utf-8", "ignore")
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names=names)

    return docs.join(cut, docs["doc_id"] == cut[key], "left").select(*names, of).mapInArrow(run, docs.schema)
