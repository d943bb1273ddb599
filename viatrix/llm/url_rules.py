"""URL filters (operator 12).

Rules are pairs of a host and a path. A url is expanded into expressions: each suffix of its host that begins at a
label, put before each directory of its path (what ends in a slash, and nothing). A rule's expression is its host and the
directory of its path. Urls and rules meet in an equi-join on the first 32 bits of the expressions' SHA-256; the full digest and
the rest of the rule's path then confirm what was found, and the longest rule wins.

Urls are expanded no further than the longest rule reaches, in labels and in slashes. Rules that are few go
to all executors; more of them are dealt by key and salt, so that a host with a third of all urls is spread out.
"""

from pyspark.sql import Column, DataFrame, Row, functions as F

from viatrix.llm.store import Cuts

#: rules that are sent to all executors; more are joined by shuffle, each key dealt to so many parts
SMALL, SALTS = 100_000, 64


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    found = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, most: Column) -> Column:
    """Suffixes of up to ``most`` labels, from short to long."""
    labels = F.split(host, r"\.")
    n = F.array_size(labels)
    return F.transform(F.sequence(F.lit(1), F.least(n, F.greatest(most, F.lit(1)))), lambda i: F.array_join(F.slice(labels, n - i + 1, i), "."))


def directories(path: Column, most: Column) -> Column:
    """Nothing, and what ends in each of the first ``most`` slashes."""
    return F.transform(F.sequence(F.lit(0), F.least(F.array_size(F.split(path, "/")) - 1, most)), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", path, F.lit("/"), i), F.lit("/"))))


def digest(host: Column, directory: Column) -> Column:
    """Of an expression; the host's length keeps its two parts apart."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(" "), host, directory), 256)


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", small: int = SMALL) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url) by rules (verdict, host, path).

    Other columns are not read. A rule fits its host and all subdomains if the url's path starts with the rule's path, letter by
    letter. The longest rule wins (host and path together), of equally long ones that with the longer host, of equal ones ``block``
    before others. A url that no rule fits has a null rule and the default verdict. A null url, or one without ://, has an empty host
    and path. Rules with a null are left out, their hosts are lower-cased; rows that repeat are judged each. Empty tables are fine.
    """
    cuts = Cuts(pages.sparkSession, "urls")
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = rules.select("verdict", lower.alias("host"), "path").dropna()
    # block sorts before what is otherwise equal
    own = own.groupBy("host", "path").agg(F.min(F.struct((F.col("verdict") != "block").alias("last"), "verdict")).getField("verdict").alias("verdict"))
    own = own.select("host", "path", "verdict", F.array_size(F.split("host", r"\.")).alias("labels"), (F.array_size(F.split("path", "/")) - 1).alias("slashes"))
    reach = own.agg(F.count(F.lit(1)).alias("n"), F.max("labels").alias("labels"), F.max("slashes").alias("slashes")).first()  # one row
    # rows are numbered once, in a written table, as nothing else tells repeated rows apart
    rows = cuts.cut(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("row", F.monotonically_increasing_id()))
    nothing = rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if not reach["n"]:
        return nothing
    directory = F.when(F.col("slashes") == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), F.col("slashes")), F.lit("/")))
    told = own.select(F.col("path").alias("start"), F.col("verdict").alias("v"), F.col("host").alias("suffix"), digest(F.col("host"), directory).alias("full")).withColumn("short", F.substring("full", 1, 8))
    hosts = rows.select("row", "path", F.explode(host_suffixes(F.col("host"), F.lit(reach["labels"]))).alias("suffix"))
    urls = hosts.select("row", "path", "suffix", F.explode(directories(F.col("path"), F.lit(reach["slashes"]))).alias("directory"))
    urls = urls.select("row", "path", digest(F.col("suffix"), F.col("directory")).alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    if reach["n"] <= small:
        met = urls.join(F.broadcast(told), "short")
    else:
        salted = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = urls.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["short", "salt"])
    met = met.where("digest = full AND startswith(path, start)")
    rank = F.struct((F.length("suffix") + F.length("start")).alias("long"), F.length("suffix").alias("of_host"), F.concat("suffix", "start").alias("rule"), F.col("v").alias("verdict"))
    best = met.groupBy("row").agg(F.max(rank).alias("best"))
    return rows.join(best, "row", "left").select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def table_of(rules: list[tuple[str, str, str]], docs: DataFrame) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return docs.sparkSession.createDataFrame([Row(*r) for r in rules], "verdict string, host string, path string")
