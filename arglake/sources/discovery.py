"""Which files of a folder a job reads: listings as DataFrames (path, name, folder), by the layouts that jobs write."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "path string, name string, folder string"
#: Names of output files, of their folders and of shot types.
OUTPUT_FILES = ("generation_outputs_*.json", "individual_*.json", "checkpoint_*.json")
SHOTS = ("zero-shot", "one-shot", "few-shot")
PIPELINES = {"pipeline2": ("are",), "pipeline3": ("adur",), "both": ("are", "adur")}


def _bare(path):
    """A path without scheme, machine and repeated or last slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), r"(?<=/)/+|/+$", "")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def listing(spark: SparkSession, folder: str, pattern: str = "*.json", recursive: bool = False) -> DataFrame:
    """(path, name, folder) of the files under ``folder``, by path; ``folder`` is the name of the file's own one.  A folder that is not there has none."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    try:
        files = reader.load(folder if recursive else f"{folder.rstrip('/')}/*")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], _SCHEMA)
    steps = F.split("path", "/")
    files = files.select("path").select("path", F.element_at(steps, -1).alias("name"), F.element_at(steps, -2).alias("folder"))
    if not recursive:  # a glob reads the folders that it matches, too
        files = files.where(_bare(F.regexp_replace("path", "/[^/]*$", "")) == _bare(F.lit(folder)))
    return files.orderBy("path")


def _union(spark: SparkSession, frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], _SCHEMA)


def output_files(spark: SparkSession, folder: str, patterns: tuple[str, ...] = OUTPUT_FILES, once: bool = False) -> DataFrame:
    """Output files of a checkpoint folder and of the folders in it, by pattern.  A file of the folder itself is found by
    both searches and listed twice, which counts its outputs twice; ``once`` lists every file once."""
    found = [listing(spark, folder, p, deep) for p in patterns for deep in (False, True)]
    out = _union(spark, found)
    return out.distinct() if once else out


def pipeline_files(spark: SparkSession, folders: dict[str, list[str]], pipeline: str = "both") -> DataFrame:
    """JSON files of the stages of ``pipeline`` (``folders``: those of each stage's models): those in folders whose name has
    the pipeline's, else the model folder's own, else all below it."""
    tokens = ("pipeline2", "pipeline3") if pipeline == "both" else (pipeline,)
    found = []
    for stage in PIPELINES.get(pipeline, ("are",)):
        for folder in folders.get(stage, []):
            below = listing(spark, folder, recursive=True)
            steps = F.split(F.substring_index("path", folder.rstrip("/").split("/")[-1] + "/", -1), "/")
            named = below.where((F.size(steps) == 2) & F.lower("folder").rlike("|".join(tokens)))
            own = below.where(F.size(steps) == 1)
            found.append(next((x for x in (named, own) if not x.isEmpty()), below))
    return _union(spark, found)


def shot_files(spark: SparkSession, folders: dict[str, str], shot: str = "all") -> DataFrame:
    """(shot, path, name, folder): JSON files of each shot type's folder, or of its ``checkpoints`` where it has none of its own."""
    found = []
    for s in SHOTS if shot == "all" else (shot,):
        if s not in folders:
            raise FileNotFoundError(f"no output folder for {s}")
        files = listing(spark, folders[s])
        if files.isEmpty():
            files = listing(spark, f"{folders[s].rstrip('/')}/checkpoints")
        found.append(files.select(F.lit(s).alias("shot"), *files.columns))
    return reduce(DataFrame.unionByName, found)


def named_files(spark: SparkSession, names: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """The files named, or the JSON files of a folder, which must be there."""
    if names:
        return _union(spark, [spark.createDataFrame([(n, n.split("/")[-1], n.rstrip("/").split("/")[-2] if "/" in n else "")], _SCHEMA) for n in names])
    if folder and not exists(spark, folder):
        raise FileNotFoundError(f"input folder not found: {folder}")
    return listing(spark, folder) if folder else spark.createDataFrame([], _SCHEMA)


def input_list(spark: SparkSession, explicit: str | None, configured: str | None, folder: str, pattern: str = "*.csv") -> str:
    """The list of identifiers of a download: the explicit file, else the configured one, else the last of the folder by name."""
    for path in (explicit, configured):
        if path:
            return path
    last = listing(spark, folder, pattern).agg(F.max_by("path", "name")).first()[0]
    if last is None:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return last


def identifiers(spark: SparkSession, path: str | None, ids: list[str] | None = None, column: str = "identifier") -> DataFrame:
    """(identifier): the ids given, else those of the list, blanks left out."""
    if ids:
        return spark.createDataFrame([(i,) for i in ids], f"`{column}` string")
    rows = spark.read.option("header", True).csv(path).select(F.trim(F.col(column)).alias(column))
    return rows.where(F.col(column) != "")
