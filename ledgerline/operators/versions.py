"""A versioned table in buckets: copy-on-write of the buckets that change, publication by compare and set.

A version is a manifest, a small JSON file ``<base>/_versions/<number>`` that
lists for each bucket the folder with its rows. A writer reads a version,
writes only the buckets that it changes into a folder of its own, checks
them, and publishes the manifest of the next number. That name can be taken
once: of two writers that started from one version, the second is refused and
has to start again from the new version, so no update is lost. Folders are
never changed after their manifest, readers of older versions are not
disturbed, and what a refused or failed writer has written is referred to by
no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has published the version that this one wanted to."""


@dataclass(frozen=True)
class Version:
    number: int
    folders: dict[int, str]     # bucket -> folder, below the table's base


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest(spark: SparkSession, base: str) -> Version:
    """The version with the highest number; number 0, without folders, when none is published."""
    folder, fs = _path(spark, f"{base}/_versions")
    if not fs.exists(folder):
        return Version(0, {})
    names = [st.getPath().getName() for st in fs.listStatus(folder)]
    number = max((int(n) for n in names if n.isdigit()), default=0)
    return version(spark, base, number)


def version(spark: SparkSession, base: str, number: int) -> Version:
    if number == 0:
        return Version(0, {})
    path, fs = _path(spark, f"{base}/_versions/{number:010d}")
    stream = fs.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(number, {int(b): f for b, f in json.loads(text)["folders"].items()})


def read(spark: SparkSession, base: str, of: Version, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets (only their folders are listed and read)."""
    paths = [f"{base}/{f}" for b, f in sorted(of.folders.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _publish_manifest(spark: SparkSession, base: str, new: Version) -> None:
    """Write the manifest under its number, unless that is taken: the text goes into a file of its own first, the rename refuses to overwrite."""
    jvm = spark.sparkContext._jvm
    name, fs = _path(spark, f"{base}/_versions/{new.number:010d}")
    draft, _ = _path(spark, f"{base}/_versions/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(json.dumps({"folders": {str(b): f for b, f in sorted(new.folders.items())}}).encode())
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(name.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) \
        if name.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    modes = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    modes[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(context.makeQualified(draft), context.makeQualified(name), modes)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {new.number} is published already") from e
        raise


def publish(df: DataFrame, base: str, after: Version, buckets: list[int],
            checks: Callable[[DataFrame], DataFrame] | None = None) -> Version:
    """Publish ``df`` (with a column BUCKET) as the new content of ``buckets``, all others as in ``after``.

    The rows are written once, partitioned by bucket; ``checks`` gives rows
    (check, violations) for the written rows, and any violation keeps the
    version unpublished. A bucket of ``buckets`` without rows becomes empty.
    Raises Conflict when another writer has published after ``after``.
    """
    spark = df.sparkSession
    name = f"data/{uuid.uuid4().hex}"
    df.repartition(len(buckets) or 1, F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{base}/{name}")
    folder, fs = _path(spark, f"{base}/{name}")
    written = {int(st.getPath().getName().split("=")[1]) for st in fs.listStatus(folder) if st.isDirectory()}
    if not written <= set(buckets):
        raise ValueError(f"rows of buckets that were not announced: {sorted(written - set(buckets))}")
    if checks is not None and written:
        failed = checks(spark.read.parquet(f"{base}/{name}")).where("violations <> 0").collect()
        if failed:
            raise RuntimeError("checks failed; previous version kept: " + ", ".join(f"{r['check']}={r['violations']}" for r in failed))
    kept = {b: f for b, f in after.folders.items() if b not in buckets}
    new = Version(after.number + 1, kept | {b: f"{name}/{BUCKET}={b}" for b in written})
    _publish_manifest(spark, base, new)
    return new


def upsert(batch: DataFrame, base: str, schema: str, bucket_key: Column, merge: Callable[[DataFrame, DataFrame], DataFrame],
           checks: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS, attempts: int = 3) -> Version:
    """Merge ``batch`` into the latest version: only the buckets that it touches are read and written.

    ``bucket_key`` must be a function of the key that ``merge(old, batch)`` replaces rows by, so that a key never
    changes its bucket. After a conflict the merge is made again on the new version.
    """
    spark = batch.sparkSession
    touched = sorted(r[0] for r in batch.select(bucket_of(bucket_key, buckets)).distinct().collect())   # at most ``buckets``
    if not touched:
        return latest(spark, base)
    for attempt in range(attempts):
        current = latest(spark, base)
        merged = merge(read(spark, base, current, schema, touched), batch)
        try:
            return publish(merged.withColumn(BUCKET, bucket_of(bucket_key, buckets)), base, current, touched, checks)
        except Conflict:
            if attempt == attempts - 1:
                raise
    raise AssertionError("not reached")
