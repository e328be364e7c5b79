"""Maven files as tables: dependencies, properties, settings, and the jars that a repository listing has for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.functions.signatures import trimmed
from calltide.operators.merge import first_wins, top_per_group
from calltide.session import Scratch

# Scopes that do not belong to a project's own classes.
LEFT_OUT = ["test", "provided", "system"]


def tag(text: Column, name: str) -> Column:
    """Trimmed text of the first element of a name; null without one."""
    return F.nullif(trimmed(F.regexp_extract(text, rf"(?s)<{name}>(.*?)</{name}>", 1)), F.lit(""))


def dependencies(poms: DataFrame) -> DataFrame:
    """(path, seq, group_id, artifact_id, version) of poms (path, xml): scopes of others left out, ``${name}`` versions from
    the properties of the same file, unknown names null."""
    body = F.regexp_replace("xml", r"(?s)<!--.*?-->|<dependencyManagement>.*?</dependencyManagement>", "")
    blocks = poms.select("path", F.posexplode(F.regexp_extract_all(body, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("seq", "b"))
    deps = blocks.select("path", "seq", tag(F.col("b"), "groupId").alias("group_id"), tag(F.col("b"), "artifactId").alias("artifact_id"), tag(F.col("b"), "version").alias("raw"), tag(F.col("b"), "scope").alias("scope"))
    deps = deps.where(F.col("scope").isNull() | ~F.col("scope").isin(*LEFT_OUT)).where("group_id is not null and artifact_id is not null")
    listed = F.regexp_extract_all(tag(F.col("xml"), "properties"), F.lit(r"<([\w.-]+)>[^<]*</"), F.lit(1))
    values = F.regexp_extract_all(tag(F.col("xml"), "properties"), F.lit(r"<[\w.-]+>([^<]*)</"), F.lit(1))
    props = poms.select("path", F.explode(F.arrays_zip(listed.alias("name"), values.alias("value"))).alias("p")).select("path", F.col("p.name").alias("name"), trimmed(F.col("p.value")).alias("value")).dropDuplicates(["path", "name"])
    named = deps.withColumn("name", F.nullif(F.regexp_extract("raw", r"^\$\{([^}]+)\}$", 1), F.lit("")))
    return named.join(props, ["path", "name"], "left").select("path", "seq", "group_id", "artifact_id", F.when(F.col("name").isNull(), F.col("raw")).otherwise(F.col("value")).alias("version"))


def with_parents(deps: DataFrame, parents: DataFrame, depth: int = 5) -> DataFrame:
    """Dependencies of each pom and of its parents (path, parent) up to ``depth``, the nearest of each artifact."""
    scratch = Scratch(deps.sparkSession)
    deps, parents = scratch.keep(deps), scratch.keep(parents.select("path", "parent"))  # poms are read once
    own = deps.select("path").union(parents.select("path")).distinct()
    frontier = own.select("path", F.col("path").alias("at"), F.lit(0).alias("depth"))
    every = frontier = scratch.keep(frontier)
    for k in range(1, depth + 1):
        up = frontier.join(parents.select(F.col("path").alias("at"), "parent"), "at").select("path", F.col("parent").alias("at"), F.lit(k).alias("depth"))
        frontier = scratch.keep(up.join(every.select("path", "at"), ["path", "at"], "left_anti").distinct())
        if frontier.isEmpty():
            break
        every = every.unionByName(frontier)
    found = every.join(deps.withColumnRenamed("path", "at"), "at").select("path", "group_id", "artifact_id", "depth", "seq", "version")
    return first_wins(found, ["path", "group_id", "artifact_id"], ["depth", "seq"])


def repositories(settings: DataFrame) -> DataFrame:
    """(path, local_repository, url) of settings files (path, xml), one row per repository."""
    urls = F.regexp_extract_all("xml", F.lit(r"(?s)<repository>.*?<url>(.*?)</url>.*?</repository>"), F.lit(1))
    return settings.select("path", tag(F.col("xml"), "localRepository").alias("local_repository"), F.explode_outer(urls).alias("url"))


def repository_jars(spark: SparkSession, root: str) -> DataFrame:
    """(path) of every jar below a local repository, relative to it; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jar").load(root).select("path")
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return found.select(F.regexp_replace("path", rf"^[a-z]*:?/*\Q{base}\E/", "").alias("path"))


def missing(resolved: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(the first ``n`` missing dependencies by name, how many more there are)."""
    gone = resolved.where("how = 'missing'").select("group_id", "artifact_id", "version").distinct()
    return gone.orderBy("group_id", "artifact_id", "version").limit(n), gone.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))


def resolved_jars(deps: DataFrame, files: DataFrame) -> DataFrame:
    """deps with ``jar`` and ``how``: the exact jar, else any jar of its version, else one of the last version in text order,
    else missing. ``files`` has the jars' paths below the repository (path)."""
    parts = F.split("path", "/")
    jars = files.where("path like '%.jar' and path not rlike '-(sources|javadoc)[.]jar$'").select(
        F.col("path").alias("jar"), F.array_join(F.slice(parts, 1, F.size(parts) - 3), ".").alias("group_id"), F.get(parts, F.size(parts) - 3).alias("artifact_id"), F.get(parts, F.size(parts) - 2).alias("found"), F.element_at(parts, -1).alias("file")
    )
    near = deps.join(jars, ["group_id", "artifact_id"], "left")
    exact = (F.col("found") == F.col("version")) & (F.col("file") == F.concat_ws("", "artifact_id", F.lit("-"), "version", F.lit(".jar")))
    how = F.when(F.col("jar").isNull(), "missing").when(exact, "exact").when(F.col("found") == F.col("version"), "version").otherwise("latest")
    order = [F.col("how") != "exact", F.col("how") != "version", F.desc("found"), F.asc("file")]
    return top_per_group(near.withColumn("how", how), [c for c in deps.columns], order).select(*deps.columns, "jar", "how")


def class_names(archives: DataFrame) -> DataFrame:
    """(path, name) of the outer classes in archives (path, content), as ``spark.read.format("binaryFile")`` gives them."""
    import io
    import zipfile

    def names(rows):
        import pandas as pd

        for chunk in rows:
            out = []
            for path, content in zip(chunk["path"], chunk["content"], strict=True):
                try:
                    found = zipfile.ZipFile(io.BytesIO(content)).namelist()
                except zipfile.BadZipFile:
                    continue
                out += [(path, n[:-6].replace("/", ".")) for n in found if n.endswith(".class") and "$" not in n and not n.startswith("META-INF/")]
            yield pd.DataFrame(out, columns=["path", "name"])

    return archives.select("path", "content").mapInPandas(names, "path string, name string").distinct()

