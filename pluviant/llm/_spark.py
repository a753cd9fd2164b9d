"""Session helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Whitespace of the contracts, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder; one of our own only in local mode without one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pluviant-checkpoint-")  # one machine, as in tests
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like `durable`, for wide rows: a compressed table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the table that `stored` wrote for `df`, once nothing is read from it any more."""
    spark = df.sparkSession
    root = shared_folder(spark)
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getName().startswith("table-") and str(path).endswith(f"{root.rsplit('/', 1)[-1]}/{path.getName()}"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed_texts(docs: DataFrame, place: Column | None = None, bits=None) -> DataFrame:
    """id, k, text (k may be missing) -> id, k, size, packed: texts compressed, as a shuffle compresses them less well.

    With `bits`, a numpy array of bytes, only rows at whose `place` a bit is set."""
    import pyarrow as pa

    keys = [c for c in docs.columns if c != "text"]
    docs = docs.select(*keys, "text", *([] if bits is None else [place.alias("place")]))

    def run(batches):
        press = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            if bits is not None:
                h = batch.column(len(keys) + 1).to_numpy()
                batch = batch.filter(pa.array((bits[h >> 3] >> (h & 7) & 1).astype(bool)))
            texts = [t.as_buffer() if t.is_valid else pa.py_buffer(b"") for t in batch.column(len(keys))]
            packed = pa.array([press.compress(t, asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array([t.size for t in texts], pa.int64()), packed], [*keys, "size", "packed"])

    head = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.mapInArrow(run, f"{head}, size long, packed binary")


def row_key(docs: DataFrame, id_col: str) -> Column:
    """A key that only rows equal in all columns share, whether they have an id or not; sorted by id, null ids last."""
    parts = [x for c in docs.columns for x in (F.isnull(docs[c]), docs[c])]
    return F.struct(F.isnull(docs[id_col]).alias("lacks"), docs[id_col].alias("id"), F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("second"), *parts).alias("b"))


def labelled_texts(ids: DataFrame, texts: DataFrame, per_label: int) -> list[tuple]:
    """(label, nth, text) of at most `per_label` of each label's ids (id, label), sorted; `texts` has id, text, perhaps label.

    Ids are picked by their hash: with the labels' counts known, only rows below a bound of the hash, somewhat more than
    are wanted, meet in a label's task. Texts are fetched whole, for picked ids alone; of texts that share an id and label
    the greatest is taken. Rows without id, label or text are not picked.
    """
    ids = ids.filter("id is not null and label is not null").distinct()
    count = ids.groupBy("label").agg(F.count(F.lit(1)).alias("total")).withColumnRenamed("label", "of")
    h = F.xxhash64("id", F.lit("sample"))
    bound = (F.lit(1.25 * per_label + 64) / F.col("total") - 0.5) * float(1 << 64)
    near = ids.join(count, F.col("label") == F.col("of")).filter(h.cast("double") < bound)
    nth = F.row_number().over(W.partitionBy("label").orderBy(h, "id"))
    picked = near.select(F.col("id").alias("pid"), F.col("label").alias("plabel"), nth.alias("nth")).filter(F.col("nth") <= per_label)
    same = F.col("id") == F.col("pid")
    if "label" in texts.columns:
        same = same & (F.col("label") == F.col("plabel"))
    # At most per_label ids of each label are broadcast.
    got = texts.filter("text is not null").join(F.broadcast(picked), same).groupBy("plabel", "nth").agg(F.max("text"))
    return sorted(tuple(r) for r in got.collect())


def nth_value(counts: DataFrame, rank: int) -> float:
    """Of distinct values v and their counts c, the value at a rank from 0. A range that holds it is halved until few values are left."""
    counts = durable(counts)
    low, high = counts.agg(F.min("v"), F.max("v")).first()
    while True:
        middle = low + (high - low) / 2
        part = counts.filter(F.col("v").between(low, high))
        n = part.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("v") <= middle, F.col("c"))), F.lit(0)).alias("c"), F.max(F.when(F.col("v") <= middle, F.col("v"))).alias("a"), F.min(F.when(F.col("v") > middle, F.col("v"))).alias("z")).first()
        if n.n <= 10_000 or n.z is None:
            for v, c in sorted((r.v, r.c) for r in part.select("v", "c").collect()):
                rank -= c
                if rank < 0:
                    return v
            raise ValueError("the rank is beyond the values")
        low, high, rank = (low, n.a, rank) if rank < n.c else (n.z, high, rank - n.c)


def size_estimate(df: DataFrame, unknown: int = 256 << 20) -> int:
    """Bytes of the input as Catalyst estimates them; no job runs. Spark's huge default means that it can't tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return unknown if size >= 1 << 60 else size


def expand(df: DataFrame, count: str, out: str, parts: int, chunk: int = 4096) -> DataFrame:
    """One row for each of 0 .. count-1, in two steps so that no array is long; the chunks of a row go to many tasks."""
    part = f"{out}__part"
    df = df.filter(F.col(count) > 0).withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), ((F.col(count) - 1) / chunk).cast("long"))))
    first = F.col(part) * chunk
    return df.repartition(parts, *df.columns).withColumn(out, F.explode(F.sequence(first, F.least(first + chunk, F.col(count)) - 1))).drop(part)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
