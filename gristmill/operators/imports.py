"""The import graph of source files: specifiers from contents, files that they resolve to, and what depends on a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import paths
from gristmill.operators.steps import settled

# What is put after a specifier, in this order, and the extensions that may stand for a source of another kind.
SUFFIXES = ["", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js"]
STRIPPED = r"\.(js|jsx|mjs|cjs)$"
#: ``import x from "y"``, ``import "y"``, ``export ... from "y"``, ``import("y")``, ``require("y")``.
SPECIFIERS = [r"\b(?:import|export)\b[^'\";]*?\bfrom\s*['\"]([^'\"\n]+)['\"]", r"\bimport\s*['\"]([^'\"\n]+)['\"]", r"\b(?:import|require)\s*\(\s*['\"]([^'\"\n]+)['\"]\s*\)"]


def specifiers(content: Column) -> Column:
    """Distinct module specifiers of a source."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in SPECIFIERS]))


def edges(files: DataFrame) -> DataFrame:
    """from_path, specifier, to_path: every relative import of ``files`` (path, content) that is one of the files.

    A specifier is taken from its file's folder; the first file that exists counts, of the path as it stands with each suffix, then of
    the path without a script extension. Bare specifiers are packages and have no edge; paths that repeat are one file.
    """
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    wanted = files.select(F.col("path").alias("from_path"), folder.alias("folder"), F.explode(specifiers(F.coalesce("content", F.lit("")))).alias("specifier")).where(F.col("specifier").startswith("."))
    wanted = wanted.withColumn("base", paths.normalised(F.concat("folder", "specifier"))).where("base <> ''")
    bases = F.array_distinct(F.array("base", F.regexp_replace("base", STRIPPED, "")))
    tried = wanted.select("from_path", "specifier", F.posexplode(bases).alias("turn", "key"))
    # a file is dealt out under what is left of its path without each suffix that it has, so that nothing is dealt out under a path that no file has
    without = [F.when(F.endswith("path", F.lit(s)), F.struct(F.lit(k).alias("place"), F.substr("path", F.lit(1), F.length("path") - len(s)).alias("key"))) for k, s in enumerate(SUFFIXES)]
    named = files.select("path").distinct().select("path", F.explode(F.array_compact(F.array(*without))).alias("n")).select("path", "n.place", "n.key")
    return tried.join(named, "key").groupBy("from_path", "specifier").agg(F.min_by("path", F.col("turn") * len(SUFFIXES) + F.col("place")).alias("to_path"))


def dependants(graph: DataFrame, changed: DataFrame, depth: int = 10) -> DataFrame:
    """path, distance: files that import one of ``changed`` (path), directly or through others, by up to ``depth`` steps; the shortest counts.

    Each step joins the files found last with the edges, which are found once, and keeps those not met before: cycles end of themselves.
    """
    links = settled(graph.where("from_path <> to_path").select("from_path", "to_path").distinct())
    met = settled(changed.select("path").where("path IS NOT NULL").distinct().withColumn("distance", F.lit(0)))
    for step in range(1, depth + 1):
        rim = met.where(F.col("distance") == step - 1).select(F.col("path").alias("to_path"))
        new = links.join(rim, "to_path").select(F.col("from_path").alias("path")).distinct().join(met.select("path"), "path", "left_anti")
        grown = settled(met.unionByName(new.withColumn("distance", F.lit(step))))
        if grown.where(F.col("distance") == step).isEmpty():
            break
        met = grown
    return met.where("distance > 0")
