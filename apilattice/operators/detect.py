"""Detection of a package's language, source folder and samples folder, over file tables.

files(package_id, rel_path, ext, size); specs(language, ext, pattern, rank) lists the build
files that mark a project, with patterns as globs on the file name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apilattice.functions.text import glob_to_regex, imports_library, is_test_path

#: Folders that no scan enters.
EXCLUDED = ("bin", "obj", "dist", "build", "target", "out", "artifacts", "node_modules", "vendor", "packages", ".nuget", "__pycache__", ".venv", "venv", "__pypackages__", ".mypy_cache", ".ruff_cache", ".eggs", ".tox", "htmlcov", ".git", ".vs", ".idea", ".next", "coverage", ".cache", ".gradle", ".pytest_cache")
#: Names of samples folders, best first.
SAMPLES = ("samples", "examples", "example", "sample", "demo", "demos", "quickstarts", "tests/samples", "docs/samples", "*-example", "*-examples", "*-samples")
#: Build files of each language, in order of detection.
BUILD_FILES = (("dotnet", ".cs", ("*.csproj",)), ("python", ".py", ("pyproject.toml", "setup.py")), ("java", ".java", ("pom.xml", "build.gradle", "build.gradle.kts")), ("typescript", ".ts", ("tsconfig.json",)), ("javascript", ".js", ("package.json",)), ("go", ".go", ("go.mod",)))
MAX_DEPTH, MAX_FILES, MAX_LINES, MAX_SCANNED = 10, 10_000, 50, 100


def folder(path):
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def depth(path):
    return F.size(F.split(path, "/")) - 1


#: Folders beside the sources of a package.
AUXILIARY = ("samples", "sample", "samples-dev", "examples", "example", "demo", "demos", "test", "tests", "spec", "specs", "__tests__", "docs", "doc", "documentation", "quickstarts", "tutorials")


def scannable(files: DataFrame, max_depth: int = MAX_DEPTH, max_files: int | None = MAX_FILES) -> DataFrame:
    """Files outside excluded folders, up to a depth and, in path order, a number (None: all) for each package."""
    segments = F.slice(F.split(F.lower("rel_path"), "/"), 1, F.greatest(depth("rel_path"), F.lit(1)))
    inside = F.when(depth("rel_path") > 0, F.exists(segments, lambda s: s.isin(*EXCLUDED))).otherwise(F.lit(False))
    rows = files.where(~inside & (depth("rel_path") <= max_depth))
    if max_files is None:
        return rows
    place = F.row_number().over(Window.partitionBy("package_id").orderBy("rel_path"))
    return rows.withColumn("_n", place).where(F.col("_n") <= max_files).drop("_n")


def by_extension(files: DataFrame, extensions: list[str], exclude: list[str] = ()) -> DataFrame:
    """Files of the extensions (any case) that match none of the globs."""
    out = files.where(F.lower("ext").isin(*[e.lower() for e in extensions]))
    for pattern in exclude:
        out = out.where(~F.col("rel_path").rlike(glob_to_regex(pattern)))
    return out


def build_markers(files: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """(package_id, rel_path, root, language, ext, rank): build files, by a small table of patterns."""
    specs = [(lang, ext, glob_to_regex(p), k) for k, (lang, ext, patterns) in enumerate(BUILD_FILES) for p in patterns]
    name = F.substring_index("rel_path", "/", -1)
    out = None
    for lang, ext, pattern, k in specs:
        hit = files.where(name.rlike(pattern)).select("package_id", "rel_path", folder("rel_path").alias("root"), F.lit(lang).alias("language"), F.lit(ext).alias("spec_ext"), F.lit(k).alias("rank"))
        out = hit if out is None else out.union(hit)
    return out


def count_sources(files: DataFrame, markers: DataFrame) -> DataFrame:
    """Markers with n_files: source files of their language below their root.

    A file is counted for every folder above it, so the join is on equal folders.
    """
    parts = F.split(folder("rel_path"), "/")
    above = F.when(folder("rel_path") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    counts = files.select("package_id", F.lower("ext").alias("spec_ext"), F.explode(above).alias("root")).groupBy("package_id", "spec_ext", "root").agg(F.count("*").alias("n_files"))
    return markers.join(counts, ["package_id", "spec_ext", "root"], "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))


def under_auxiliary(root: Column) -> Column:
    """Whether a project's folder is, or lies in, one that holds samples, tests or documents; names as they are written."""
    return F.arrays_overlap(F.split(root, "/"), F.array(*map(F.lit, AUXILIARY)))


def source_folder(files: DataFrame) -> DataFrame:
    """(package_id, language, source_root, n_files): projects at the root win, then the most source files, then detection order."""
    counted = count_sources(files, build_markers(files).where(~is_test_path(F.col("root")))).where("n_files > 0")
    order = Window.partitionBy("package_id").orderBy((F.col("root") != "").cast("int"), F.col("n_files").desc(), "rank", "root", "rel_path")
    return counted.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("package_id", "language", F.col("root").alias("source_root"), "n_files")


def samples_folder(files: DataFrame) -> DataFrame:
    """(package_id, samples_root): the best named folder at the root or one level deep."""
    dirs = files.select("package_id", folder("rel_path").alias("dir")).distinct()
    tops = dirs.select("package_id", F.explode(F.array(*[F.substring_index("dir", "/", n) for n in (1, 2, 3)])).alias("dir")).where("dir <> ''").distinct()
    rank = F.lit(None).cast("int")
    for k, pattern in reversed(list(enumerate(SAMPLES))):
        rank = F.when(F.col("dir").rlike(glob_to_regex(pattern)), k).when(F.col("dir").rlike(glob_to_regex("*/" + pattern)), k + len(SAMPLES)).otherwise(rank)
    best = tops.withColumn("_rank", rank).where("_rank is not null")
    order = Window.partitionBy("package_id").orderBy("_rank", "dir")
    return best.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("package_id", F.col("dir").alias("samples_root"))


def import_scan(sources: DataFrame, library: str, language: str, max_lines: int = MAX_LINES, max_files: int = MAX_SCANNED) -> DataFrame:
    """(package_id, dir, n_files, n_imports): in each folder the files, and those whose first lines import the library."""
    place = F.row_number().over(Window.partitionBy("package_id", folder("rel_path")).orderBy("rel_path"))
    lines = F.slice(F.split("content", "\r?\n"), 1, max_lines)
    hit = F.exists(lines, lambda line: imports_library(line, library, language))
    rows = sources.withColumn("_n", place).where(F.col("_n") <= max_files)
    return rows.groupBy("package_id", folder("rel_path").alias("dir")).agg(F.count("*").alias("n_files"), F.count_if(hit).alias("n_imports"))


def rank_samples(scan: DataFrame) -> DataFrame:
    """The folder with the most imports, or without any the most files."""
    order = Window.partitionBy("package_id").orderBy(F.col("n_imports").desc(), F.col("n_files").desc(), "dir")
    return scan.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def monorepo_packages(files: DataFrame) -> DataFrame:
    """(package_id, package_dir): folders of project files below sdk, packages or libs (else src, else the root), without tests and samples."""
    names = ("package.json", "*.csproj", "*.fsproj", "pyproject.toml", "setup.py", "pom.xml", "build.gradle", "build.gradle.kts", "go.mod", "tsconfig.json")
    name = F.substring_index("rel_path", "/", -1)
    hit = F.lit(False)
    for pattern in names:
        hit = hit | name.rlike(glob_to_regex(pattern))
    top = F.substring_index("rel_path", "/", 1)
    rank = F.when(top.isin("sdk", "packages", "libs"), 0).when(top == "src", 1).otherwise(2)
    rows = files.withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(Window.partitionBy("package_id"))).where("_rank = _best")
    dirs = rows.where(hit & ~is_test_path(F.col("rel_path"))).select("package_id", folder("rel_path").alias("package_dir")).where("package_dir <> ''")
    nested = dirs.where(~F.col("package_dir").isin("sdk", "packages", "libs", "src"))
    return nested.withColumn("_low", F.lower("package_dir")).groupBy("package_id", "_low").agg(F.min("package_dir").alias("package_dir")).drop("_low")


def workspace_only(manifests: DataFrame) -> DataFrame:
    """package.json rows that only bind a workspace: workspaces, or private without any entry field."""
    has = lambda k: F.get_json_object("content", f"$.{k}").isNotNull()
    entry = has("main") | has("exports") | has("types") | has("typings") | has("module")
    return manifests.where(has("workspaces") | ((F.get_json_object("content", "$.private") == "true") & ~entry))


def solution_only(configs: DataFrame) -> DataFrame:
    """tsconfig rows that only list references."""
    part = lambda k: F.get_json_object("content", f"$.{k}")
    return configs.where(part("references[0]").isNotNull() & part("files").isNotNull() & part("files[0]").isNull() & part("include").isNull())


def count_files(files: DataFrame, cap: int = MAX_FILES) -> DataFrame:
    """(package_id, n_files): how many files, told up to ``cap``."""
    return files.groupBy("package_id").agg(F.least(F.count("*"), F.lit(cap)).alias("n_files"))


def quick_language(files: DataFrame, max_depth: int = 1) -> DataFrame:
    """(package_id, language) by the first language, in order of detection, with a build file near the root."""
    near = build_markers(files.where(depth("rel_path") <= max_depth))
    return near.groupBy("package_id").agg(F.min_by("language", "rank").alias("language"))


#: Where each language keeps its sources, in order; ``*`` is any folder, ``.`` the project's own.
CONVENTIONS = {
    "dotnet": ("src", "."),
    "python": ("src/*", "lib/*", "*/*/*", "*/*", "*", "."),
    "java": ("src/main/java", "src", "*/src/main/java"),
    "typescript": ("src", "lib", "."),
    "javascript": ("src", "lib", "."),
    "go": (".", "pkg", "pkg/*", "*"),
}
FIRST_MATCH = ("go", "dotnet")


def conventional_source(files: DataFrame, language: str, extension: str) -> DataFrame:
    """(package_id, source_root, n_files): the folder that conventions give to the sources of a package.

    files(package_id, rel_path, ext), paths from the project's root.  A folder counts the files
    below it; in Go, and for the root itself except in .NET, only those directly in it.  Go and
    .NET take the first convention with files, others the one whose best folder has the most
    (of equal ones the first; of its folders the first by name).  No files give no row.
    """
    dirs = F.split(folder("rel_path"), "/")
    dirs = F.when(folder("rel_path") == "", F.array().cast("array<string>")).otherwise(dirs)
    found = []
    for rank, pattern in enumerate(CONVENTIONS[language]):
        parts = [] if pattern == "." else pattern.split("/")
        shallow = language == "go" or (not parts and language != "dotnet")
        fits = F.size("_dirs") == len(parts) if shallow else F.size("_dirs") >= len(parts)
        for k, part in enumerate(parts):
            name = F.get("_dirs", F.lit(k))
            fits = fits & (~F.lower(name).isin(*EXCLUDED) if part == "*" else name == part)
        place = F.array_join(F.slice("_dirs", 1, len(parts)), "/") if parts else F.lit("")
        found.append(F.when(fits, F.struct(F.lit(rank).alias("rank"), place.alias("source_root"))))
    own = files.where(F.lower("ext") == extension).withColumn("_dirs", dirs)
    rows = own.select("package_id", F.explode(F.array_compact(F.array(*found))).alias("c")).select("package_id", "c.*")
    counts = rows.groupBy("package_id", "rank", "source_root").agg(F.count("*").alias("n_files"))
    first = [F.col("rank"), F.col("n_files").desc()] if language in FIRST_MATCH else [F.col("n_files").desc(), F.col("rank")]
    order = Window.partitionBy("package_id").orderBy(*first, "source_root")
    return counts.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("package_id", "source_root", "n_files")


def script_language(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(package_id, language): TypeScript with a tsconfig.json at the root or one folder below, else JavaScript with a package.json at
    the root that is no private bundle of tools.

    manifests(package_id, content) are the root's package.json; a broken one counts as a library.
    """
    name, level = F.substring_index("rel_path", "/", -1), depth("rel_path")
    near = (name == "tsconfig.json") & ((level == 0) | ((level == 1) & ~F.lower(folder("rel_path")).isin(*EXCLUDED)))
    flags = files.groupBy("package_id").agg(F.max(near).alias("_ts"), F.max(F.col("rel_path") == "package.json").alias("_js"))
    has = lambda k: F.get_json_object("content", f"$.{k}").isNotNull()
    tools = (F.get_json_object("content", "$.private") == "true") & ~(has("main") | has("exports") | has("module") | has("types") | has("typings"))
    private = manifests.groupBy("package_id").agg(F.max(F.coalesce(tools, F.lit(False))).alias("_tools"))
    language = F.when(F.col("_ts"), "typescript").when(F.col("_js") & ~F.coalesce("_tools", F.lit(False)), "javascript")
    return flags.join(private, "package_id", "left").select("package_id", language.alias("language")).where("language is not null")
