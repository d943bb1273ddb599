"""Fill-in-the-middle transformation (operator 11).

A text becomes an array of UTF-32 code points. Neighbouring classes of code points are compared, and the
places where a unit ends are found at once (``flatnonzero``); a hash of the row's id picks the ranks of two
of these bounds. Prefix, middle and suffix are slices of the array, put behind markers in one of two orders:

* psm: prefix mark, prefix, suffix mark, suffix, middle mark, middle;
* spm: suffix mark, suffix, prefix mark, prefix, middle mark, middle.

Every row is worked on by itself, whole, and a row's form and cuts depend on nothing but its id and text.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from viatrix.llm.words import slices

#: marks of prefix, suffix and middle
MARKS = ("<P>", "<S>", "<M>")
WHITE = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def bounds(codes: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin or end, with 0 and the length: n + 1 places for n units; one place if there is no code point.

    ``line``: a unit ends behind each newline; ``word``: where white space gives way to other characters; ``char``: everywhere.
    """
    if unit == "line":
        left = codes[:-1] == 10
        inner = np.flatnonzero(left)
    elif unit == "word":
        white = np.isin(codes, WHITE)
        inner = np.flatnonzero(white[:-1] & ~white[1:])
    elif unit == "char":
        inner = np.arange(max(len(codes) - 1, 0))
    else:
        raise ValueError(f"units are line, word or char, not {unit}")
    return np.concatenate([[0], inner + 1, [len(codes)]]) if len(codes) else np.zeros(1, np.int64)


def numbers(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits; a null id counts as an empty string."""
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(told[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(text: str, doc_id: int | None, seed: int, rate: int, spm: int, unit: str, marks: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix, of middle, output) of one text."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    edge = bounds(codes, unit)
    h1, h2, h3, h4 = numbers(seed, doc_id)
    n = len(edge) - 1
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((int(edge[h1 % (n + 1)]), int(edge[h2 % (n + 1)])))
    prefix, middle, suffix = (codes[i:j].tobytes().decode("utf-32-le") for i, j in ((0, a), (a, b), (b, len(codes))))
    p, s, m = marks
    if h4 % 100 < spm:
        return n, "spm", a, b - a, "".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a, b - a, "".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of docs (doc_id, text; other columns are not read).

    rate: per cent of texts that are cut; spm: per cent of those in the form spm. A null text counts as empty. Empty texts and those that
    hold a mark stay plain, as do those that the rate leaves out; their output is the text, their two counts are null. Rows that
    repeat are cut alike; a null doc_id is hashed as an empty string. Cuts may coincide, so parts may be empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids = batch.column(0).to_pylist()
            rows = [cut(t or "", i, seed, rate, spm, unit, marks) for i, t in zip(ids, batch.column(1).to_pylist())]
            n, form, prefix, middle, output = zip(*rows)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip((n, form, prefix, middle, output), kinds))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. No text with a mark in it is cut, and no mark can arise where parts meet marks, so three marks part it."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks))
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
