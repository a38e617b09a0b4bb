"""What the corpus operators share: written cut points, skew-proof joins, row ids, connected components.

Joins here never put the rows of one key into one task: keys that hold more than a fixed share of the rows are
salted (there are at most `share` such keys, whatever the input), and a dimension is broadcast only after its rows
have been counted against a bound.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dimensions of at most so many rows may be broadcast (they are counted first).
BROADCAST_ROWS = 50_000
#: A key is heavy if it holds more than one part in SHARE of the rows; so at most SHARE keys are heavy.
SHARE = 400
#: Heavy keys are dealt over so many salts.
SALTS = 64
#: Rows of a batch that goes to Python. Texts of 100 KB make batches of 50 MB.
BATCH_ROWS = 512

_folders: dict[str, str] = {}
#: Paths of the cut points that are still there, in the order in which they were written.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one if all runs in this process, as in tests; else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _folders.get("base")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _folders.setdefault("base", tempfile.mkdtemp(prefix="pagelens-"))
    run = f"{base.rstrip('/')}/pagelens-{spark.sparkContext.applicationId}"
    if run not in _folders:
        _folders[run] = run
        atexit.register(_remove, spark, run)
    return run


def _remove(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """While a cut point is written, batches for Python have at most `rows` rows; the session's setting returns after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: lineage ends here, and lost executors lose nothing.

    Files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    with small_batches(spark, rows):
        df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


class Scratch:
    """What was written since the scope began; the tables to keep are named by `keep`."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.before, self.kept = spark, set(_written), set()

    def keep(self, df: DataFrame) -> DataFrame:
        """`df`, a table as `materialize` gives it, whose files outlive the scope."""
        self.kept.add(df.__dict__["written_to"])
        return df

    def paths(self) -> list[str]:
        return [p for p in _written if p not in self.before and p not in self.kept]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A scope whose cut points go at its end, but for those kept. All that leaves it must be kept, or be no DataFrame."""
    scope = Scratch(spark)
    yield scope
    release(spark, scope.paths())


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete these cut points."""
    for path in paths:
        _remove(spark, path)
        if path in _written:
            _written.remove(path)


def nested(docs: DataFrame) -> Column:
    """All columns of docs in the struct __row, beside which no name of an operator's own can clash with one of theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")


def unnested(docs: DataFrame) -> list[Column]:
    """The columns of docs out of __row."""
    return [F.col("__row").getField(c).alias(c) for c in docs.columns]


def column_or_null(df: DataFrame, name: str | None, kind: str) -> Column:
    """Column `name` cast to `kind`; NULL if there is no such column."""
    return F.col(f"`{name}`").cast(kind) if name is not None and name in df.columns else F.lit(None).cast(kind)


def fits(dim: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether `dim` has at most `rows` rows, by a count that stops there."""
    return dim.limit(rows + 1).count() <= rows


def lookup_join(facts: DataFrame, dim: DataFrame, key: str, how: str = "left", rows: int = BROADCAST_ROWS, spread: Column | None = None, heavy: DataFrame | None = None) -> DataFrame:
    """facts JOIN dim USING (key), for a dim with one row a key, whatever share of the facts one key holds.

    Both sides should be cheap to read again (written tables). A dim that is counted small is broadcast (rows=0: never). Else the
    heavy keys, at most SHARE of them, are joined on (key, salt) and the others on the key. NULL keys match nothing;
    with how="left" they are kept. `spread` says what deals out the rows of a heavy key (default: a random salt, safe
    as it only picks the task that joins a row); `heavy` has the heavy keys where a caller has counted them already.
    """
    if rows and fits(dim, rows):
        return facts.join(F.broadcast(dim), key, how)
    nulls = facts.filter(F.col(key).isNull())
    facts = facts.filter(F.col(key).isNotNull())
    if heavy is None:
        total = facts.count()
        heavy = facts.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") * SHARE > total).select(key)
    heavy = F.broadcast(materialize(heavy))
    salt = spread if spread is not None else F.xxhash64(F.monotonically_increasing_id())
    few = facts.join(heavy, key, "left_semi").withColumn("__salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    few_dim = dim.join(heavy, key, "left_semi").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = few.join(few_dim, [key, "__salt"], how).drop("__salt").unionByName(facts.join(heavy, key, "left_anti").join(dim, key, how))
    if how == "left":
        missing = [f for f in dim.schema.fields if f.name != key]
        out = out.unionByName(nulls.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]))
    return out


def drop_rows(rows: DataFrame, gone: DataFrame, bound: int = 500_000) -> DataFrame:
    """`rows` without those whose __uid is in `gone`; up to `bound` ids (counted first) are broadcast, more are shuffled."""
    return rows.join(F.broadcast(gone) if fits(gone, bound) else gone, "__uid", "left_anti")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp): for each node of the long edges (a, b), the least node it is linked to.

    Each round hooks every component to its least neighbour and halves the resulting paths until they are flat, then
    contracts the edges; the rounds grow with the logarithm of the longest path. All state stays in written tables.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("comp")))
    rest = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        parent = materialize(both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).select("c", F.least("c", "m").alias("p")))
        while True:
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            jumped = materialize(lookup_join(parent, up, "p", "inner").select("c", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
            parent = jumped.select("c", "p")
            if jumped.filter("moved").isEmpty():
                break
        renamed = parent.select(F.col("c").alias("comp"), "p")
        labels = materialize(lookup_join(labels, renamed, "comp").select("node", F.coalesce("p", "comp").alias("comp")))
        one = lookup_join(rest, parent.select(F.col("c").alias("a"), F.col("p").alias("pa")), "a", "inner")
        two = lookup_join(materialize(one), parent.select(F.col("c").alias("b"), F.col("p").alias("pb")), "b", "inner")
        rest = materialize(two.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return labels
