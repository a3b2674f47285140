"""Corpus statistics: languages, file types, totals, frameworks, trees, modules, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed as X
from ..functions import scalars as S


def language_counts(files: DataFrame) -> DataFrame:
    """language, files, share (percent of files that have one), extensions."""
    known = files.where("language is not null").groupBy("language").agg(F.count("*").alias("files"), F.sort_array(F.collect_set(S.extension_of(F.col("path")))).alias("extensions"))
    total = files.where("language is not null").agg(F.count("*").alias("total"))
    return known.join(F.broadcast(total)).select("language", "files", F.round(F.col("files") * 100 / F.col("total"), 2).alias("share"), "extensions")


def file_type_counts(files: DataFrame) -> DataFrame:
    ext = S.extension_of(F.col("path"))
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("files"), F.min(S.detect_language(F.col("path"))).alias("language"))


def directories(path: Column) -> Column:
    """The directories above a path, without the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.expr("cast(array() as array<string>)"))


def scan_totals(files: DataFrame) -> DataFrame:
    """total_files, total_folders, and flags of marker files, for each repo_id."""
    name = F.lower(S.basename(F.col("path")))
    counts = files.groupBy("repo_id").agg(
        F.count("*").alias("total_files"), F.bool_or(name == "package.json").alias("has_package_json"), F.bool_or(name.rlike(r"^tsconfig.*\.json$")).alias("has_tsconfig"),
        F.bool_or(name.rlike(r"^readme(\..*)?$")).alias("has_readme"), F.bool_or(F.col("path").rlike(r"(^|/)\.git/")).alias("has_git"),
    )
    folders = files.select("repo_id", F.explode(directories(F.col("path"))).alias("d")).groupBy("repo_id").agg(F.count_distinct("d").alias("total_folders"))
    return counts.join(folders, "repo_id", "left").na.fill(0, ["total_folders"])


def detect_framework(signals: DataFrame) -> DataFrame:
    """signals (repo_id, package_json, has_next_folder, has_requirements, has_pyproject, has_go_mod, has_cargo_toml,
    has_pom_xml, has_gemfile) -> repo_id, framework."""
    deps = F.map_keys(F.map_concat(*[F.coalesce(F.from_json(F.get_json_object("package_json", f"$.{k}"), "map<string,string>"), F.expr("cast(map() as map<string,string>)")) for k in ("dependencies",)]))
    dev = F.map_keys(F.coalesce(F.from_json(F.get_json_object("package_json", "$.devDependencies"), "map<string,string>"), F.expr("cast(map() as map<string,string>)")))
    have = F.array_union(deps, dev)
    marked = F.coalesce(*[F.when(F.array_contains(have, m), F.lit(f)) for m, f in X.FRAMEWORK_MARKERS])
    rest = (
        F.when(F.col("has_next_folder"), "next.js").when(F.col("has_pyproject") | F.col("has_requirements"), "python").when(F.col("has_go_mod"), "go")
        .when(F.col("has_cargo_toml"), "rust").when(F.col("has_pom_xml"), "java").when(F.col("has_gemfile"), "ruby").when(F.col("package_json").isNotNull(), "node.js")
    )
    return signals.select("repo_id", F.coalesce(marked, rest).alias("framework"))


def detect_package_manager(files: DataFrame) -> DataFrame:
    """repo_id, package_manager: by the first lockfile of the priority list that a repository has."""
    name = S.basename(F.col("path"))
    rank = F.coalesce(*[F.when(name == f, F.lit(i)) for i, (f, _) in enumerate(X.PACKAGE_MANAGERS)])
    manager = F.coalesce(*[F.when(F.col("best") == i, F.lit(m)) for i, (_, m) in enumerate(X.PACKAGE_MANAGERS)])
    return files.groupBy("repo_id").agg(F.min(rank).alias("best")).select("repo_id", manager.alias("package_manager"))


def file_tree(files: DataFrame) -> DataFrame:
    """parent, name, type (folder or file), children: one row for each entry of the tree; folders sort before files."""
    path = F.col("path")
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    leaves = files.select(parent.alias("parent"), S.basename(path).alias("name"), F.lit("file").alias("type"), path.alias("full")).distinct()
    folders = files.select(F.explode(directories(path)).alias("d")).distinct()
    folders = folders.select(F.regexp_extract("d", r"^(.*)/[^/]*$", 1).alias("parent"), S.basename(F.col("d")).alias("name"), F.lit("folder").alias("type"), F.col("d").alias("full"))
    entries = leaves.unionByName(folders)
    counts = entries.groupBy(F.col("parent").alias("full")).agg(F.count("*").alias("children"))
    return entries.join(counts, "full", "left").select("parent", "name", "type", F.coalesce("children", F.lit(0)).alias("children"))


def folder_modules(files: DataFrame) -> DataFrame:
    """path, name, module_type and files below, for every folder with a file somewhere below it."""
    each = files.select("path", F.explode(directories(F.col("path"))).alias("folder"))
    return each.groupBy("folder").agg(F.count_distinct("path").alias("files")).select(F.col("folder").alias("path"), S.basename(F.col("folder")).alias("name"), F.lit("folder").alias("module_type"), "files")


def join_ancestors(paths: DataFrame, dirs: DataFrame) -> DataFrame:
    """(path, dir) for every path below, or at, one of dirs (dir): an equi join on exploded ancestors."""
    each = paths.select("path", F.explode(F.concat(directories(F.col("path")), F.array("path"))).alias("dir"))
    return each.join(dirs.select("dir").distinct(), "dir")


def project_manifest(files: DataFrame, frameworks: DataFrame, managers: DataFrame, previous: DataFrame, now) -> DataFrame:
    """One row a repository; created_at is the previous manifest's where there is one, updated_at is now."""
    langs = files.where("language is not null").groupBy("repo_id").agg(F.sort_array(F.collect_set("language")).alias("languages"))
    out = scan_totals(files).join(langs, "repo_id", "left").join(frameworks, "repo_id", "left").join(managers, "repo_id", "left").join(previous.select("repo_id", F.col("created_at").alias("__c")), "repo_id", "left")
    return out.select("repo_id", "languages", "framework", "package_manager", "total_files", "total_folders", F.coalesce("__c", F.lit(now)).alias("created_at"), F.lit(now).alias("updated_at"))


def project_overview(tables: dict[str, DataFrame], saved: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """A row for each repo_id: the number of rows of each table (n_files, ...), the languages of files with their numbers, when it was saved
    (repo_id, saved_at) and its summary (repo_id, overview)."""
    out = None
    for name, df in tables.items():
        n = df.groupBy("repo_id").agg(F.count("*").alias(f"n_{name}"))
        out = n if out is None else out.join(n, "repo_id", "full_outer")
    out = out.na.fill(0)
    if "files" in tables and "language" in tables["files"].columns:
        by = tables["files"].where("language is not null").groupBy("repo_id", "language").agg(F.count("*").alias("n"))
        out = out.join(by.groupBy("repo_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n")))).alias("languages")), "repo_id", "left")
    if saved is not None:
        out = out.join(saved.groupBy("repo_id").agg(F.max("saved_at").alias("saved_at")), "repo_id", "left")
    if summaries is not None:
        out = out.join(summaries.select("repo_id", "overview"), "repo_id", "left")
    return out


def top_of_modules(files: DataFrame, symbols: DataFrame, modules: DataFrame, summaries: DataFrame, n: int = 3) -> DataFrame:
    """What explain_modules() counts, shown: for each module (dir) its summary (target, overview), its n files with most symbols and its n commonest
    names. Ties by path and name."""
    inside = join_ancestors(files.select("path").distinct(), modules)
    sizes = inside.join(symbols.groupBy("path").agg(F.count("*").alias("n")), "path", "left").na.fill(0, ["n"])
    names = inside.join(symbols.select("path", "name"), "path").groupBy("dir", "name").agg(F.count("*").alias("n"))

    def best(df: DataFrame, what: str, out: str) -> DataFrame:
        w = Window.partitionBy("dir").orderBy(F.desc("n"), what)
        top = df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
        return top.groupBy("dir").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", what))), lambda x: x[what]).alias(out))

    out = modules.select("dir").distinct().join(best(sizes, "path", "top_files"), "dir", "left").join(best(names, "name", "top_names"), "dir", "left")
    return out.join(summaries.select(F.col("target").alias("dir"), "overview"), "dir", "left")


def explain_modules(files: DataFrame, symbols: DataFrame, edges: DataFrame, modules: DataFrame) -> DataFrame:
    """For each module (dir): files, symbols, and edges (src_path, dst_path) that leave or enter it."""
    inside = join_ancestors(files.select("path").distinct(), modules)
    n_files = inside.groupBy("dir").agg(F.count("*").alias("files"))
    n_symbols = inside.join(symbols.groupBy("path").agg(F.count("*").alias("n")), "path").groupBy("dir").agg(F.sum("n").alias("symbols"))
    pairs = edges.groupBy("src_path", "dst_path").agg(F.count("*").alias("n"))
    a = inside.select(F.col("path").alias("src_path"), F.col("dir").alias("src_dir"))
    b = inside.select(F.col("path").alias("dst_path"), F.col("dir").alias("dst_dir"))
    out_n = pairs.join(a, "src_path").groupBy("src_dir").agg(F.sum("n").alias("n_out"))
    in_n = pairs.join(b, "dst_path").groupBy("dst_dir").agg(F.sum("n").alias("n_in"))
    both = pairs.join(a, "src_path").join(b, (pairs["dst_path"] == b["dst_path"]) & (F.col("src_dir") == F.col("dst_dir"))).groupBy("src_dir").agg(F.sum("n").alias("n_both"))
    out = modules.select("dir").distinct().join(n_files, "dir", "left").join(n_symbols, "dir", "left")
    for df, key in ((out_n, "src_dir"), (in_n, "dst_dir"), (both, "src_dir")):
        out = out.join(df.withColumnRenamed(key, "dir"), "dir", "left")
    out = out.na.fill(0)
    return out.select("dir", "files", "symbols", (F.col("n_out") - F.col("n_both")).alias("dependencies_out"), (F.col("n_in") - F.col("n_both")).alias("dependencies_in"))


def group_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def top_languages(files: DataFrame, n: int = 6) -> DataFrame:
    return files.where("language is not null").groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language").limit(n)
