"""Line dedup by winnowing (operator 10), in DataFrame functions only.

A run of ``run_lines`` or more consecutive lines that stands earlier, in a document of a smaller
doc_id or higher up in the same one, is deleted where it stands again. A line that repeats alone is no run and stays.
Lines that are blank take no part: they neither break a run nor are deleted by themselves.

Winnowing: of every ``run_lines`` consecutive line hashes the smallest (the last of equals) is chosen, so two
equal runs of that length have a fingerprint in common at the same place. Chosen positions are fewer than lines,
and each goes with the lines around it that lie in a window of which it is the smallest.
Positions: a fingerprint that only one position in the corpus has is in no repeated run. The others' positions are
joined with the first position that has the same window around its fingerprint. Comparison with the first occurrence
of every window stands for comparison with all earlier ones, so a run shared by a third of the corpus costs a row per
occurrence, never a pair.
Extension: a match goes on, both ways, as long as the windows beside it match beside the same first occurrence; a run's
windows all have their fingerprints, so the matches in a row along one diagonal are the whole run.
"""

from pyspark.sql import DataFrame, Window, functions as F

from viatrix.llm.store import Cuts, fresh


def line_positions(docs: DataFrame, run_lines: int) -> DataFrame:
    """(doc_id, fingerprint, lo, around): chosen positions, the first window of each, and the lines of all its windows.

    Lines are numbered without blank ones; around holds (i, h, g): the number in the text, and two independent
    hashes that make 128 bits.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    told = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x"))), lambda s: s["x"] != "")
    hashed = F.transform(told, lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("h"), F.xxhash64(s["x"], F.lit(17)).alias("g")))
    d = docs.select("doc_id", hashed.alias("l")).where(F.size("l") >= run_lines)
    # the position of each window's smallest hash rises with the window
    least = F.transform(F.sequence(F.lit(0), F.size("l") - run_lines), lambda k: F.negative(F.least(*[F.struct(F.get("l", k + j)["h"].alias("h"), F.negative(k + j).alias("p")) for j in range(run_lines)])["p"]) if run_lines > 1 else k)
    d = d.select("doc_id", "l", least.alias("m"))
    begun = F.filter(F.transform("m", lambda p, k: F.struct(p.alias("p"), k.alias("lo"))), lambda s: (s["lo"] == 0) | (F.get("m", s["lo"] - 1) != s["p"]))
    d = d.select("doc_id", "l", F.size("m").alias("n"), begun.alias("b"))
    # a position's windows go on to the next position's first
    chosen = F.transform("b", lambda s, x: F.struct(
        F.get("l", s["p"])["h"].alias("fingerprint"), s["lo"].alias("lo"),
        F.slice("l", s["lo"] + 1, F.coalesce(F.get("b", x + 1)["lo"], F.col("n")) - s["lo"] + run_lines - 1).alias("around"),
    ))
    return d.select("doc_id", F.explode(chosen).alias("c")).select("doc_id", "c.*")


def repeated_runs(docs: DataFrame, run_lines: int, cuts: Cuts) -> DataFrame:
    """(doc_id, start, n, lines, first_doc_id, first_start): runs that stand earlier, as long as they go.

    start and first_start count lines without blank ones; lines has the numbers of the run's n lines in the text.
    """
    positions = cuts.cut(line_positions(docs, run_lines))
    shared = cuts.cut(positions.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint"))
    near = positions.join(shared, "fingerprint")
    part = [F.get("around", F.col("k") + j) for j in range(run_lines)]
    windows = near.select("doc_id", "lo", "around", F.explode(F.sequence(F.lit(0), F.size("around") - run_lines)).alias("k"))
    windows = windows.select("doc_id", (F.col("lo") + F.col("k")).alias("at"), F.transform(F.array(*part), lambda s: s["i"]).alias("rows"), F.xxhash64(*[x["h"] for x in part]).alias("h1"), F.xxhash64(*[x["g"] for x in part]).alias("h2"))
    windows = cuts.cut(windows)
    cuts.drop(positions, shared)
    first = cuts.cut(windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    later = windows.join(first, ["h1", "h2"]).where("doc_id > first.doc_id or at > first.at")
    later = later.select("doc_id", "at", "rows", F.col("first.doc_id").alias("first_doc_id"), (F.col("at") - F.col("first.at")).alias("off"))
    diagonal = ["doc_id", "first_doc_id", "off"]
    # equal rows of one document fall together; the number of places before less the place is the same along a run
    run = F.col("at") - F.dense_rank().over(Window.partitionBy(*diagonal).orderBy("at"))
    runs = later.withColumn("run", run).groupBy(*diagonal, "run").agg(F.min("at").alias("start"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rows")))).alias("lines"))
    runs = cuts.cut(runs.select("doc_id", "start", F.size("lines").alias("n"), "lines", "first_doc_id", (F.col("start") - F.col("off")).alias("first_start")))
    cuts.drop(windows, first)
    return runs


def dedup_lines(docs: DataFrame, run_lines: int = 2) -> DataFrame:
    """docs with text cut, and n_lines, n_removed (of its lines, blank ones counted in n_lines) added.

    doc_id must be a key; of rows repeated altogether each keeps or loses the same lines. A
    null text stays null and an empty one empty, with no line removed. Lines count as equal
    without the spaces around them. Columns beyond doc_id and text pass through, whatever their names,
    but those named n_lines and n_removed are replaced. An empty table gives an empty result.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    gone, flags, key = (fresh(c, docs.columns) for c in ("gone", "flags", "key"))
    runs = repeated_runs(docs.select("doc_id", "text"), run_lines, Cuts(docs.sparkSession, "lines"))
    cut = runs.groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("lines")))).alias(gone))
    lines = F.split("text", "\n")
    # numbers of deleted lines as flags: a lookup a line, not a scan
    kept = F.filter(lines, lambda _, i: ~F.coalesce(F.get(F.col(flags), i), F.lit(False)))
    # texts move once at every size; runs are as many as the corpus makes them, so they are never sent to all
    marked = docs.join(cut.hint("merge"), docs["doc_id"] == cut[key], "left")
    gaps = F.zip_with(
        F.col(gone),
        F.concat(F.array(F.lit(-1)), F.slice(gone, 1, F.array_size(gone) - 1)),
        lambda here, before: F.concat(F.array_repeat(F.lit(False), here - before - 1), F.array(F.lit(True))),
    )
    marked = marked.withColumn(flags, F.when(F.col(gone).isNotNull(), F.flatten(gaps)))
    n_removed = F.coalesce(F.array_size(gone), F.lit(0)).cast("long")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return marked.select(*rest, text.alias("text"), F.coalesce(F.array_size(lines), F.lit(0)).cast("long").alias("n_lines"), n_removed.alias("n_removed"))
