"""Category taxonomies: lookups, hierarchy paths, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arglake.work import written


def parent_names(categories: DataFrame) -> DataFrame:
    """Categories (category_id, name, parent_ids, primary_parent) with the names of their parents, in order; unknown ones as [Unknown ID: n]."""
    names = categories.select(F.col("category_id").alias("pid"), F.col("name").alias("pname"))
    flat = categories.select("category_id", F.posexplode_outer("parent_ids").alias("pos", "pid"))
    named = flat.join(names, "pid", "left").where("pid is not null")
    label = F.coalesce("pname", F.concat(F.lit("[Unknown ID: "), F.col("pid").cast("string"), F.lit("]")))
    lists = named.groupBy("category_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", label.alias("n")))), lambda x: x["n"]).alias("parent_names"))
    primary = names.select(F.col("pid").alias("primary_parent"), F.col("pname").alias("primary_parent_name"))
    out = categories.join(lists, "category_id", "left").join(primary, "primary_parent", "left")
    return out.select(*categories.columns, F.coalesce("parent_names", F.array()).alias("parent_names"), "primary_parent_name")


def ordered_names(assignments: DataFrame, categories: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, category_names): names in the order of the ids, unknown ids dropped."""
    flat = assignments.select(key, F.posexplode("category_ids").alias("pos", "category_id"))
    named = flat.join(categories.select("category_id", "name"), "category_id")
    return named.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("category_names"))


def paths(categories: DataFrame, depth: int = 10, separator: str = " > ") -> DataFrame:
    """(category_id, path, depth): the chain of primary parents from the root; stops at unknown parents, cycles and ``depth`` names.

    One self-join a level, of ids that are someone's parent; ended chains leave it, and at last each category takes the chain
    of its parent.  ``category_id`` is a key.
    """
    up = categories.select(F.col("category_id").alias("up_id"), F.col("name").alias("up_name"), F.col("primary_parent").alias("up_parent"))
    parents = up.select(F.col("up_parent").alias("up_id")).where("up_id is not null").distinct()
    own = written(up.join(parents, "up_id", "left_semi"), "parents")
    left = own.select(F.col("up_id").alias("first"), F.col("up_parent").alias("next"), F.array("up_id").alias("seen"), F.array("up_name").alias("above"))
    chains = None
    for _ in range(depth - 2):
        ended = left.where("next is null")
        chains = ended if chains is None else chains.unionByName(ended)
        found = left.where("next is not null").join(own, F.col("next") == F.col("up_id"), "left")
        go = F.col("up_id").isNotNull() & ~F.array_contains("seen", F.coalesce("up_id", F.col("first")))
        left = written(
            found.select(
                "first",
                F.when(go, F.col("up_parent")).alias("next"),
                F.when(go, F.array_append("seen", F.col("up_id"))).otherwise(F.col("seen")).alias("seen"),
                F.when(go, F.array_append("above", F.col("up_name"))).otherwise(F.col("above")).alias("above"),
            ),
            "chains",
        )
        if left.isEmpty():
            break
    chains = written(left if chains is None else chains.unionByName(left), "chains")
    out = categories.join(chains, F.col("primary_parent") == F.col("first"), "left")
    place = F.coalesce(F.array_position("seen", F.col("category_id")), F.lit(0))  # of the category itself: a cycle
    above = F.when(place > 0, place - 1).otherwise(F.greatest(F.coalesce(F.size("above"), F.lit(0)), F.lit(0))).cast("int")
    names = F.concat(F.reverse(F.slice(F.coalesce("above", F.array().cast("array<string>")), F.lit(1), F.least(above, F.lit(depth - 1)))), F.array("name"))
    return out.select("category_id", F.array_join(names, separator).alias("path"), F.size(names).cast("long").alias("depth"))


def combine(papers: DataFrame, assignments: DataFrame, categories: DataFrame, hierarchy: bool = True) -> DataFrame:
    """Papers with category ids, names, count and, if ``hierarchy``, the paths of their categories; papers without categories stay."""
    ids = assignments.withColumnRenamed("paper_id", "identifier")
    names = ordered_names(ids, categories, "identifier")
    out = papers.join(ids, "identifier", "left").join(names, "identifier", "left")
    out = out.withColumn("num_categories", F.when(F.col("category_ids").isNull(), 0).otherwise(F.size("category_ids")).cast("long"))
    if not hierarchy:
        return out
    flat = ids.select("identifier", F.posexplode("category_ids").alias("pos", "category_id")).join(paths(categories), "category_id")
    found = flat.groupBy("identifier").agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("p"))
    found = found.select("identifier", F.when(F.col("p")[0]["pos"] == 0, F.col("p")[0]["path"]).alias("primary_category_hierarchy"), F.array_join(F.transform("p", lambda x: x["path"]), " | ").alias("all_category_hierarchies"))
    return out.join(found, "identifier", "left")


def statistics(categories: DataFrame, assignments: DataFrame) -> DataFrame:
    """Totals of a taxonomy and of its use."""
    used = assignments.select(F.explode("category_ids").alias("category_id")).groupBy("category_id").agg(F.count("*").alias("n"))
    own = categories.agg(F.count("*").alias("categories"), F.sum((F.size("parent_ids") > 0).cast("long")).alias("with_parents"), F.sum((F.size("parent_ids") <= 0).cast("long")).alias("roots"))
    usage = used.agg(F.count("*").alias("used"), F.max("n").alias("most"), F.min("n").alias("least"), F.max_by("category_id", F.struct("n", -F.col("category_id"))).alias("most_used"), F.round(F.avg("n"), 6).alias("mean_use"))
    return own.join(F.broadcast(usage))  # one row each


def usage_report(categories: DataFrame, assignments: DataFrame, papers: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(coverage: papers with, papers without, assigned but unknown papers; the ``top`` categories by papers)."""
    p, a = papers.select("identifier").distinct(), assignments.select(F.col("paper_id").alias("identifier")).distinct()
    coverage = p.join(a.withColumn("_a", F.lit(1)), "identifier", "full").join(p.withColumn("_p", F.lit(1)), "identifier", "left")
    coverage = coverage.agg(F.sum((F.col("_p").isNotNull() & F.col("_a").isNotNull()).cast("long")).alias("with_categories"), F.sum((F.col("_p").isNotNull() & F.col("_a").isNull()).cast("long")).alias("without_categories"), F.sum(F.col("_p").isNull().cast("long")).alias("unknown_papers"))
    flat = assignments.select(F.explode("category_ids").alias("category_id")).groupBy("category_id").agg(F.count("*").alias("papers"))
    return coverage, flat.join(categories.select("category_id", "name"), "category_id").orderBy(F.desc("papers"), "category_id").limit(top)


def papers_in(assignments: DataFrame, category_id: int) -> DataFrame:
    return assignments.where(F.array_contains("category_ids", category_id)).select("paper_id")
