"""The shared folder of a session, written intermediates, and the package on executors."""

from __future__ import annotations

import json
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / f"{top.name}.zip"  # Spark's file server hands it out
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share.

    It is ``spark.checkpoint.dir`` of the session.  Where that is unset, a local
    session gets a folder under /tmp, and a cluster session one in its warehouse,
    which executors share by definition.
    """
    ship(spark)
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        named = "/tmp/checkpoints" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; no other run uses it."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestrand/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; its results must not be read any more."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation, and a second
    use does not run the plan again.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """Write ``df`` to the shared folder as a table of ``buckets`` by ``keys``, sorted, and read it back.

    A join on the keys with what is dealt into as many parts moves none of its
    rows, and a look-up of single keys reads their buckets only.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    table = f"lodestrand_{path.rpartition('/')[2].replace('-', '_')}"
    # each bucket is one file: rows meet before they are written
    whole = df.repartition(buckets, *keys)
    whole.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, which must not be read any more."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_at)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan of fewer splits than cores over all cores.

    A small file has one row group, which one task reads; what follows would run
    in that task too.  Larger scans are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dense_ids(df: DataFrame, *order, name: str = "id", start: int = 0) -> DataFrame:
    """Append consecutive numbers in the given total order.

    The sort is distributed: rows are numbered within each sorted partition, and
    the partitions' offsets are running sums over one row a partition.
    """
    spread = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ids")
    part = F.shiftright("_at", 33)
    sizes = spread.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = spread.withColumn("_part", part).join(offsets, "_part")
    low = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(name, (F.col("_before") + low + start).cast("long")).drop("_part", "_before", "_at")


def _hadoop(spark: SparkSession, at: str):
    """A path and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    path, fs = _hadoop(spark, f"{folder}/_manifest/*.json")
    return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.globStatus(path) or [])


def committed(spark: SparkSession, folder: str) -> dict | None:
    """What the newest manifest of ``folder`` says; None where there is none."""
    found = _manifests(spark, folder)
    if not found:
        return None
    path, fs = _hadoop(spark, f"{folder}/_manifest/{found[-1]}.json")
    stream = fs.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, folder: str, state: dict) -> None:
    """Make ``state`` the newest manifest of ``folder``, by one rename of a written file.

    Readers that trust manifests see all of a write or nothing of it.  One writer at a time.
    """
    new = (_manifests(spark, folder) or [-1])[-1] + 1
    draft, fs = _hadoop(spark, f"{folder}/_manifest/.{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    stream.write(json.dumps(state, sort_keys=True).encode())
    stream.close()
    if not fs.rename(draft, _hadoop(spark, f"{folder}/_manifest/{new}.json")[0]):
        raise OSError(f"manifest {new} of {folder} was written by another")


def current_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Tables ``*.csv`` of a folder by name, as paths: those its manifest names, and others at its top that no manifest replaced."""
    path, fs = _hadoop(spark, f"{folder}/*.csv")
    state = committed(spark, folder) or {}
    top = {s.getPath().getName(): f"{folder}/{s.getPath().getName()}" for s in fs.globStatus(path) or []}
    out = {n: p for n, p in top.items() if n not in state.get("replaced", [])}
    return out | {n: f"{folder}/{p}" for n, p in state.get("files", {}).items()}


def move(spark: SparkSession, found: dict[str, str]) -> None:
    """Rename files or folders (from: to), across file systems too; what was there before goes."""
    for source, target in found.items():
        (a, from_), (b, to) = _hadoop(spark, source), _hadoop(spark, target)
        to.mkdirs(b.getParent())
        to.delete(b, True)
        same = from_.getUri() == to.getUri()
        done = from_.rename(a, b) if same else spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(from_, a, to, b, True, True, spark.sparkContext._jsc.hadoopConfiguration())
        if not done:
            raise OSError(f"{source} could not be moved to {target}")


def publish(spark: SparkSession, folder: str, found: dict[str, str], replaces, *, versioned: bool) -> None:
    """Put tables (name: path of what a job wrote) into ``folder``, in place of those whose names ``replaces`` accepts.

    Versioned, they go to a new folder in it, and the manifest then names them and
    what they replace: ``current_files`` sees the old tables until then and the new
    ones afterwards, however the writer ends.  Otherwise they go to the top of the
    folder one by one, where other tools look for them.
    """
    state = committed(spark, folder)
    if not versioned:
        stale = [p for n, p in current_files(spark, folder).items() if replaces(n) and n not in found and p == f"{folder}/{n}"]
        move(spark, {path: f"{folder}/{name}" for name, path in found.items()})
        for old in stale:
            path, fs = _hadoop(spark, old)
            fs.delete(path, True)
        if state is not None:
            files = {n: p for n, p in state.get("files", {}).items() if n not in found and not replaces(n)}
            gone = [n for n in {*state.get("replaced", []), *filter(replaces, state.get("files", {}))} if n not in found]
            commit(spark, folder, {"files": files, "replaced": sorted(gone)})
        return
    own = version()
    move(spark, {path: f"{folder}/{own}/{name}" for name, path in found.items()})
    state = state or {}
    old = [n for n in current_files(spark, folder) if replaces(n)]
    files = {n: p for n, p in state.get("files", {}).items() if not replaces(n)} | {n: f"{own}/{n}" for n in found}
    commit(spark, folder, {"files": files, "replaced": sorted({*state.get("replaced", []), *old})})
    for n in old:
        path, fs = _hadoop(spark, f"{folder}/{n}")
        fs.delete(path, True)


def vacuum(spark: SparkSession, folder: str) -> list[str]:
    """Delete folders ``v-*`` that the newest manifest does not name, and older manifests; nobody may read or write the folder meanwhile."""
    named = json.dumps(committed(spark, folder))
    path, fs = _hadoop(spark, f"{folder}/v-*")
    gone = [s.getPath() for s in fs.globStatus(path) or [] if s.getPath().getName() not in named]
    for p in gone:
        fs.delete(p, True)
    for k in _manifests(spark, folder)[:-1]:
        fs.delete(_hadoop(spark, f"{folder}/_manifest/{k}.json")[0], False)
    return sorted(p.getName() for p in gone)


def version() -> str:
    """A new name for a folder that a manifest will name."""
    return f"v-{uuid.uuid4().hex}"
