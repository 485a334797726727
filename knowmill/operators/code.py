"""Languages of source files, and edges between files from their imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: names of test files.
TEST_NAME = r"\.(test|spec)\.|^test_|_test\."
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "rs": "rust"}


def language_of(path: Column) -> Column:
    """By extension; null for others."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return known[F.regexp_extract(path, r"\.([^./]+)$", 1)]


def _folder(path: Column) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), "/")


def _climbed(folder: Column, levels: Column) -> Column:
    """The folder so many levels up."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - levels)), "/")


def _joined(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).when(rest == "", folder).otherwise(F.concat(folder, F.lit("/"), rest))


def import_candidates(imports: DataFrame) -> DataFrame:
    """(file_path, language, import) -> with (candidate, choice): the paths that an import may mean, best first.

    TypeScript: relative imports only, as they are, with .ts, .tsx, /index.ts, /index.tsx. Python: dots climb, else from the
    package's root; .py or /__init__.py. Rust: crate:: from src, self:: and super:: from here; the longest
    module path first.
    """
    here, what = _folder(F.replace(F.col("file_path"), F.lit("\\"), F.lit("/"))), F.col("import")
    # TypeScript
    up = F.size(F.regexp_extract_all(what, F.lit(r"(\.\./)"))).cast("int")
    relative = _joined(_climbed(here, up), F.regexp_replace(what, r"^(\.{1,2}/)+", ""))
    ts = F.when(what.startswith("."), F.transform(F.array(*map(F.lit, ["", ".ts", ".tsx", "/index.ts", "/index.tsx"])), lambda e: F.concat(relative, e)))
    # Python
    dots = F.char_length(F.regexp_extract(what, r"^(\.*)", 1))
    module = F.replace(F.regexp_replace(what, r"^\.+", ""), F.lit("."), F.lit("/"))
    py_base = F.when(dots > 0, _joined(_climbed(here, dots - 1), module)).otherwise(module)
    py = F.transform(F.array(F.lit(".py"), F.lit("/__init__.py")), lambda e: F.concat(py_base, e))
    # Rust
    bare = F.regexp_replace(F.regexp_replace(what, r"(::)?\{.*$", ""), r"^(crate|self|(super::)*super)(::|$)", "")
    supers = F.size(F.regexp_extract_all(what, F.lit(r"(super(?:::|$))")))
    source = F.regexp_extract(F.col("file_path"), r"^((?:.*/)?src)/", 1)
    rs_folder = F.when(what.startswith("crate"), source).when(what.startswith("super"), _climbed(here, supers - 1)).otherwise(here)
    steps = F.filter(F.split(bare, "::"), lambda x: x != "")
    longest = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(steps) - 1)), lambda i: F.array_join(F.slice(steps, 1, F.size(steps) - i), "/"))
    rs = F.when(F.size(steps) > 0, F.flatten(F.transform(longest, lambda m: F.array(F.concat(_joined(rs_folder, m), F.lit(".rs")), F.concat(_joined(rs_folder, m), F.lit("/mod.rs"))))))
    ways = F.when(F.col("language") == "typescript", ts).when(F.col("language") == "python", py).when(F.col("language") == "rust", rs)
    return imports.select("project_id", "file_path", "import", F.posexplode(ways).alias("choice", "candidate"))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, from_path, to_path): one edge for each pair of files, of each import the best candidate that exists.

    imports: (project_id, file_path, language, import); files: (project_id, path).
    """
    there = files.select("project_id", F.col("path").alias("candidate")).distinct()
    found = import_candidates(imports.distinct()).join(there, ["project_id", "candidate"])
    best = found.groupBy("project_id", "file_path", "import").agg(F.min_by("candidate", "choice").alias("to_path"))
    return best.where("to_path <> file_path").select("project_id", F.col("file_path").alias("from_path"), "to_path").distinct()
