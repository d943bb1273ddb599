"""Best-fit packing of token sequences (operator 9).

Large-item matching over the histogram of piece lengths: pieces above a third of the capacity go
into a sequence at most twice, paired greedily (the longest with the longest that still fits);
smaller pieces, longest first, best-fit the gaps that remain. Only lengths decide, and there are
at most ``capacity`` of them, so the plan is made from counts: a table whose size does not depend on
the input. Executors then look up each piece's place from its rank among pieces of its length.
"""

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from viatrix.llm.store import Cuts
from viatrix.llm.words import Hasher, slices, strings

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """[(how many sequences, lengths in each)] for counts of pieces by length.

    >>> plan_bins({6: 1, 4: 1, 3: 2}, 10)
    [(1, [6, 4]), (1, [3, 3])]
    """
    left = {n: c for n, c in counts.items() if c > 0}
    gaps: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    third = capacity / 3
    large = sorted(n for n in left if n > third)
    while large:
        n = large[-1]
        i = bisect.bisect_right(large, capacity - n) - 1
        if i < 0:
            gaps[capacity - n].append((left.pop(n), [n]))
            large.pop()
            continue
        m = large[i]
        k = left[n] // 2 if m == n else min(left[n], left[m])
        if m == n and k == 0:  # the last of its length; its partner is the next that fits
            if i == 0:
                gaps[capacity - n].append((left.pop(n), [n]))
                large.pop()
                continue
            m = large[i - 1]
            k = min(left[n], left[m])
        gaps[capacity - n - m].append((k, [n, m]))
        for x in (n, m):
            left[x] -= k
        for x in {n, m}:
            if left[x] == 0:
                del left[x]
                large.remove(x)
    sizes = sorted(gaps)
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            i = bisect.bisect_left(sizes, n)
            if i == len(sizes):
                per = capacity // n
                full, rest = divmod(c, per)
                new = ([(full, per)] if full else []) + ([(1, rest)] if rest else [])
                for many, each in new:
                    gap = capacity - each * n
                    if not gaps[gap]:
                        bisect.insort(sizes, gap)
                    gaps[gap].append((many, [n] * each))
                c = 0
                continue
            gap = sizes[i]
            many, has = gaps[gap].pop()
            per = gap // n  # best fit keeps to the bin it has just narrowed
            full = min(many, c // per)
            parts = [(full, per)]
            if full < many and c - full * per:
                parts.append((1, c - full * per))
            used = sum(x for x, _ in parts)
            if many > used:
                gaps[gap].append((many - used, has))
            elif not gaps[gap]:
                sizes.pop(i)
            for x, each in parts:
                if x:
                    c -= x * each
                    now = gap - each * n
                    if not gaps[now]:
                        bisect.insort(sizes, now)
                    gaps[now].append((x, has + [n] * each))
    return [b for gap in sorted(gaps) for b in gaps[gap]]


def places(bins: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset): rank r of a row's range lies in sequence first + r - first rank."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    seq = 0
    for many, lengths in bins:
        at = 0
        for n in lengths:
            out[n].append((rank[n], seq, at))
            rank[n] += many
            at += n
        seq += many
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def _byte_alphabet() -> dict[str, int]:
    """Character for each byte in byte-level vocabularies: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE tokenizer file, without special tokens added, for many texts at once.

    Its split never crosses a space that a non-space follows, so units " word" are encoded once
    each and looked up. Texts where that may not hold (runs of spaces, special tokens) go through
    the tokenizer itself.
    """

    KEEP = 500_000

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [t["content"] for t in told.get("added_tokens", ())]
        pre = told.get("pre_tokenizer") or {}
        self.fast = told["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not told.get("normalizer")
        if self.fast:
            alphabet = _byte_alphabet()
            ranks = {bytes(alphabet[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in self.special}
            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            self.bpe = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.bytes_of = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            for token, i in ranks.items():
                self.bytes_of[i] = len(token)
        self.hasher = Hasher(seed=9, lower=False)
        self._clear()

    def _clear(self):
        #: codes by unit hash; code 0 is for units that only the tokenizer itself may split
        self.code: dict[int, int] = {}
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def _learn(self, hashes: list[int], units: list[bytes]) -> None:
        """Units of text, each after its space; those that are empty or begin with white space may join what stands before."""
        texts = [u.decode("utf-8") for u in units]
        good = [i for i, t in enumerate(texts) if t and not t[0].isspace() and not t[0] in "\x85\u200b\ufeff"]
        got = np.asarray(self.bpe.encode_ordinary("".join([" " + texts[i] for i in good])), dtype=np.int64)
        ends = np.cumsum(np.fromiter((len(units[i]) + 1 for i in good), np.int64, len(good)))
        upto = np.searchsorted(np.cumsum(self.bytes_of[got]), ends) + 1
        n = len(self.at) - 1
        self.code.update(dict.fromkeys(hashes, 0))
        self.code.update({hashes[i]: n + k for k, i in enumerate(good)})
        self.at = np.concatenate([self.at, self.at[-1] + upto])
        self.ids = np.concatenate([self.ids, got.astype(np.uint32)])

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        if not self.fast:
            return [self._whole(t or "") for t in texts.to_pylist()]
        data, offsets = strings(texts)
        raw = data.tobytes()
        # a unit begins behind each space, or with its text; the first of a text has no space before it
        space = np.flatnonzero(data == 32)
        starts = np.concatenate([space + 1, offsets[:-1]])
        head = np.concatenate([np.zeros(len(space), bool), np.ones(len(offsets) - 1, bool)])
        doc = np.concatenate([np.searchsorted(offsets, space, side="right") - 1, np.arange(len(offsets) - 1)])
        order = np.lexsort((~head, starts, doc))
        starts, head, doc = starts[order], head[order], doc[order]
        ends = np.concatenate([starts[1:] - 1, [0]])
        last = np.concatenate([doc[1:] != doc[:-1], [True]])
        ends[last] = offsets[doc[last] + 1]
        hashes = self.hasher.spans(data, starts, ends)
        body = np.flatnonzero(~head)
        known, place, inverse = np.unique(hashes[body], return_index=True, return_inverse=True)
        if len(self.code) > self.KEEP:
            self._clear()
        known = known.tolist()
        fresh = [i for i, h in enumerate(known) if h not in self.code]
        if fresh:
            at = body[place[fresh]]
            self._learn([known[i] for i in fresh], [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
        table = np.fromiter(map(self.code.__getitem__, known), np.int64, len(known))
        codes = table[inverse]
        lengths = self.at[codes + 1] - self.at[codes]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.ids[np.repeat(self.at[codes] - upto[:-1], lengths) + np.arange(upto[-1])]
        heads = np.flatnonzero(head)
        first = np.searchsorted(body, heads)  # the texts' first units behind a space
        bounds = upto[np.concatenate([first, [len(body)]])]
        odd = np.zeros(len(heads), bool)
        odd[doc[body[codes == 0]]] = True
        out = []
        for i, (a, b) in enumerate(zip(starts[heads].tolist(), ends[heads].tolist())):
            whole = raw[offsets[i] : offsets[i + 1]]
            if odd[i] or any(s.encode() in whole for s in self.special):
                out.append(self._whole(whole.decode("utf-8")))
                continue
            rest = flat[bounds[i] : bounds[i + 1]]
            out.append(np.concatenate([np.asarray(self.bpe.encode_ordinary(raw[a:b].decode("utf-8")), dtype=np.uint32), rest]) if b > a else rest)
        return out


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: documents' ids and end_id, cut from the back so that only the first piece may be short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys
        import types
        import zlib

        from pyspark import TaskContext

        # kept between the tasks of a Python worker, in a module made for it
        cache = vars(sys.modules.setdefault("_viatrix_encoders", types.ModuleType("_viatrix_encoders")))
        encoder, part = cache.setdefault(path, None) or Encoder(path), TaskContext.get().partitionId()
        cache[path] = encoder
        seen = np.zeros(capacity + 1, np.int64)
        last = np.array([end_id], np.uint32)
        for batch in slices(batches, 1):
            rows: list[tuple] = []
            for d, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                ids = np.concatenate([ids, last]).astype("<u4")
                cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    n = b - a
                    rows.append((d, k, a, n, zlib.crc32(ids[a:b]), part, int(seen[n])))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Places of all pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed each. An empty table gives
    an empty result. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark, "pack")
    # the ranks are fixed once written: a retried task can't deal them anew
    pieces = cuts.cut(token_pieces(docs, path, capacity, end_id))
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = places(plan_bins(counts, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            firsts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, b in zip(firsts, [*firsts[1:], len(order)]):
                rows, table = order[a:b], plan[int(length[order[a]])]
                hit = np.searchsorted(table[:, 0], rank[rows], side="right") - 1
                seq[rows] = table[hit, 1] + rank[rows] - table[hit, 0]
                offset[rows] = table[hit, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
