"""Tables written to the shared folder, to cut lineage without losing recovery."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from viatrix.session import shared_dir


def fresh(name: str, taken: list[str]) -> str:
    """A column name like name that none of taken is."""
    known = {c.lower() for c in taken}
    while name in known:
        name += "_"
    return name


def one_each(docs: DataFrame, chosen: DataFrame, *also: str) -> DataFrame:
    """(doc_id, text, columns of chosen): one row for each doc_id of chosen, which has each once and a bounded size.

    Rows are joined on doc_id and on the columns ``also``. Of several texts of one id that with the least hash is taken; copies are folded in
    the tasks that read them, so what is collected of the result is bounded by chosen, however often rows repeat.
    """
    rows = docs.select("doc_id", "text", *also).where("text is not null").join(F.broadcast(chosen), ["doc_id", *also])
    rest = [c for c in chosen.columns if c != "doc_id"]
    return rows.groupBy("doc_id", *rest).agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", *rest)


class Cuts:
    """Writes frames as Parquet under spark.checkpoint.dir; drop() deletes those that no returned plan still reads.

    A written table survives a lost executor, unlike blocks kept in executors, and a retried task
    reads the same rows again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0, {}

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop_but(self, *frames: DataFrame) -> None:
        """Deletes all tables but these."""
        keep = {id(df) for df in frames}
        self.drop(*[df for _, df in list(self.paths.values()) if id(df) not in keep])

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            if (found := self.paths.pop(id(df), None)) is None:
                continue
            path = jvm.org.apache.hadoop.fs.Path(found[0])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
