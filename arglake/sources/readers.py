"""Readers: records, tables, documents, maps, generations, checkpoints and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arglake.functions.text import collapse_values, extract_id, multi_values

#: Fields of a record and the columns that they become.
FIELDS = {"dc:title": "title", "dc:type": "type", "dc:creator": "authors", "dc:subject": "subjects", "dc:date": "year", "dc:identifier": "identifier-url", "dc:language": "language"}
_XML = "header struct<_status:string,identifier:string,datestamp:string>, metadata struct<dc:struct<" + ",".join(f"`{t}`:array<string>" for t in FIELDS) + ">>"


def stem(path: str | Column = "_metadata.file_path") -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]*$", "")


def id_from_stem(c: Column) -> Column:
    """The last part after ``_``, the whole stem where there is none."""
    return F.element_at(F.split(c, "_"), -1)


def records(spark: SparkSession, path: str, pattern: str = r"rec/(.+)$", wrapper: str = "dc") -> DataFrame:
    """Harvested XML records as a flat table with status, datestamp, languages, file and position; records without a header are dropped."""
    schema = _XML.replace("metadata struct<dc:", f"metadata struct<`{wrapper}`:")
    raw = spark.read.format("xml").option("rowTag", "record").option("mode", "PERMISSIVE").schema(schema).load(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos")).where("header is not null")
    stamp = F.regexp_replace("header.datestamp", "Z$", "").try_cast("timestamp_ntz")
    columns = [collapse_values(F.col(f"metadata.`{wrapper}`.`{t}`")).alias(n) for t, n in FIELDS.items()]
    return raw.select(extract_id("header.identifier", pattern).alias("identifier"), *columns, F.col("header._status").alias("status"), stamp.alias("datestamp"), F.coalesce(F.col(f"metadata.`{wrapper}`.`dc:language`"), F.array()).alias("languages"), "file", "pos")


def csv(spark: SparkSession, path, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def csv_rows(spark: SparkSession, path, key: str = "identifier") -> DataFrame:
    """Texts with stripped column names, missing cells empty, rows without a key dropped; of repeated keys the last row stays."""
    raw = csv(spark, path)
    raw = raw.select(*(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in raw.columns), F.monotonically_increasing_id().alias("_n"))
    rest = [c for c in raw.columns if c not in (key, "_n")]
    last = raw.where(F.col(key) != "").groupBy(key).agg(F.max_by(F.struct(*(f"`{c}`" for c in rest)), "_n").alias("_r"))
    return last.select(key, *(F.col(f"_r.`{c}`").alias(c) for c in rest))


def newest(spark: SparkSession, folder: str, patterns: list[str]) -> str | None:
    """The newest file (by time, then name) of the first pattern that any file matches."""
    for p in patterns:
        files = spark.read.format("binaryFile").option("pathGlobFilter", p).load(folder).select("path", "modificationTime")
        found = files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]
        if found:
            return found
    return None


def taxonomy_json(spark: SparkSession, path: str) -> DataFrame:
    """(category_id, name, parent_ids, primary_parent) of [[name, id, "p1,p2", primary], ...]; short rows are skipped, 0 and '' are no parent."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("r")).where(F.size("r") >= 4)
    parts = F.filter(F.transform(F.split(F.coalesce(F.col("r")[2], F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    ids = F.transform(parts, lambda x: x.try_cast("int"))
    ids = F.when(F.exists(ids, lambda x: x.isNull()), F.array().cast("array<int>")).otherwise(F.filter(ids, lambda x: x != 0))
    parent = F.col("r")[3].try_cast("int")
    return rows.select(F.col("r")[1].try_cast("int").alias("category_id"), F.col("r")[0].alias("name"), ids.alias("parent_ids"), F.when(parent != 0, parent).alias("primary_parent")).where("category_id is not null")


def assignments_json(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, category_ids) of [{"id", "categories": "1,2"}, ...]; a list with a bad element is empty."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<struct<id:string,categories:string>>")).alias("r"))
    ids = F.transform(multi_values("r.categories", ","), lambda x: x.try_cast("int"))
    return rows.select(F.col("r.id").alias("paper_id"), F.when(F.exists(ids, lambda x: x.isNull()), F.array().cast("array<int>")).otherwise(ids).alias("category_ids"))


def categories_csv(spark: SparkSession, path) -> DataFrame:
    ids = F.transform(multi_values("parent_ids", ";"), lambda x: x.try_cast("int"))
    return csv(spark, path).select(F.col("category_id").try_cast("int").alias("category_id"), "name", ids.alias("parent_ids"), F.col("primary_parent").try_cast("int").alias("primary_parent"))


def paper_categories_csv(spark: SparkSession, path) -> DataFrame:
    return csv(spark, path).select("paper_id", F.transform(multi_values("category_ids", ","), lambda x: x.try_cast("int")).alias("category_ids"))


PREFERENCE = ("_cleaned.md", "_cleaned.txt", ".md", ".txt")


def documents(spark: SparkSession, folder: str, preference: tuple[str, ...] = PREFERENCE) -> DataFrame:
    """(identifier, text): one file a document, by the order of ``preference``; ``.doctags.txt`` files are left out."""
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select("value", F.substring_index("_metadata.file_path", "/", -1).alias("name"))
    files = files.where(~F.endswith("name", F.lit(".doctags.txt")))
    rank, ident = F.lit(None), F.col("name")
    for i, end in reversed(list(enumerate(preference))):
        hit = F.endswith("name", F.lit(end))
        rank = F.when(hit, F.lit(i)).otherwise(rank)
        ident = F.when(hit, F.substr("name", F.lit(1), F.length("name") - len(end))).otherwise(ident)
    rows = files.select(ident.alias("identifier"), rank.alias("rank"), "value").where("rank is not null")
    return rows.groupBy("identifier").agg(F.min_by("value", "rank").alias("text"))


def json_files(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(path, id, value): whole files, id from the file's stem."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), stem().alias("id"), "value")


OUTPUT = "id string, text string, prompt_info struct<strategy:string,shot_type:string,system_file:string,user_file:string,variation:string>"


def generations(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text, prompt_info) of files that are a list of outputs, an object with ``outputs``, or one output."""
    return generations_of(json_files(spark, folder))


def generations_of(files: DataFrame) -> DataFrame:
    """``generations`` of whole files (value)."""
    rows = files.select(F.trim("value").alias("v"))
    one = "struct<" + ",".join(f"{a}:{b}" for a, b in (x.strip().split(" ", 1) for x in OUTPUT.split(", "))) + ">"
    many = F.when(F.startswith("v", F.lit("[")), F.from_json("v", f"array<{one}>")).otherwise(F.coalesce(F.from_json("v", f"struct<outputs:array<{one}>>")["outputs"], F.array(F.from_json("v", one))))
    return rows.select(F.explode(many).alias("o")).select("o.*").where("id is not null or text is not null")


def reload_checkpoints(spark: SparkSession, folder: str, strategy: str | None = None) -> DataFrame:
    """Lines of ``.jsonl`` files and outputs of ``.json`` envelopes; malformed ones are dropped, repeated ids and prompts once."""
    lines = spark.read.schema(OUTPUT).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).json(folder)
    out = lines.where("id is not null").unionByName(generations(spark, folder).where("id is not null"))
    if strategy:
        out = out.where(F.col("prompt_info.strategy") == strategy)
    return out.dropDuplicates(["id", "text"])


def logs(spark: SparkSession, folder: str, pattern: str = "*.log") -> DataFrame:
    """(path, line_no, value): lines of log files; a file's lines are numbered in order."""
    raw = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))


def sample_ids(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    ids = csv(spark, path).select("identifier").where(F.trim("identifier") != "")
    return ids.limit(limit) if limit is not None else ids


def pending_files(files: DataFrame, done: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Files (path) to work on: the named ones or all, without those whose stem is done."""
    rows = files.withColumn("stem", stem(F.col("path")))
    if names:
        rows = rows.where(F.col("stem").isin(*names))
    return rows.join(done.select("stem").distinct(), "stem", "left_anti")


def first_texts(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    """The first ``limit`` ``.txt`` files by path, paragraphs squeezed."""
    from arglake.functions.text import normalise_paragraphs

    return json_files(spark, folder, "*.txt").orderBy("path").limit(limit).select("id", normalise_paragraphs("value").alias("text"))


def with_position(df: DataFrame, group: str, order: str) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
