"""Scripts as text files, one by one or bundled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_scripts(spark: SparkSession, root: str, bundled: bool = False) -> DataFrame:
    """One row per file under ``root``: its path below the root, and its text; with
    ``bundled``, one row per script of the bundles there, split by their size.

    The path is what follows the root's own path where the file's path begins
    with it. File URIs have percent signs for special characters; only these
    are decoded, a plus sign stays. Small files share partitions, as many as
    fit in ``spark.sql.files.maxPartitionBytes``.
    """
    base = root.rstrip("/")
    if bundled:
        bundles = spark.read.schema("path string, source string")
        return bundles.option("recursiveFileLookup", True).json(base)
    inside_base = base.split(":", 1)[-1] if "://" not in base else "/" + base.split("://", 1)[1].partition("/")[2]
    files = spark.read.option("recursiveFileLookup", True).text(base, wholetext=True)
    uri = F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    path = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    clean = "/" + inside_base.strip("/")
    return files.select(
        F.substring(path, F.lit(len(clean) + 1), F.length(path)).alias("path"),
        F.col("value").alias("source"),
    )


def write_bundles(scripts: DataFrame, root: str) -> None:
    """Write (path, source) as bundles: JSON lines with a script each, many to a
    file. A file per script costs a folder entry, a rename and a listing each,
    which is what limits a large corpus.
    """
    scripts.select("path", "source").write.json(root)
