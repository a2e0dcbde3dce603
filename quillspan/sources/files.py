"""Source files of a folder: which of them a scan passes over, which it cannot read, and what it keeps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.lexers import EXTENSIONS

# Folders that a scan passes over, and endings of files that are no text.
IGNORED = "node_modules .git dist build venv .venv __pycache__ .pytest_cache target vendor .next .turbo .cache .output out coverage .idea .vscode".split()
BINARY = "gguf bin exe dll so dylib wasm zip tar gz 7z iso png jpg jpeg gif webp ico mp4 mp3 wav pdf docx xlsx parquet arrow pkl h5 onnx pt pth db sqlite pyc class o a".split()
IGNORED_PATH = "(?:^|/)(?:" + "|".join(n.replace(".", "[.]") for n in IGNORED) + ")/|[.]min[.]js$"
HEAD = 8192


def extension(path: Column) -> Column:
    """The lower-cased ending of a path, '' without one."""
    return F.lower(F.regexp_extract(path, r"[.]([\w+]+)$", 1))


def language_of(path: Column) -> Column:
    """The language of a path by its ending, null if it is none of those known."""
    names = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(names, extension(path))


def glob_regex(glob: str) -> str:
    """An ignore rule as a regular expression over a path relative to the rule's folder; '' for blank lines and comments.

    A leading or inner slash ties the rule to its folder, a trailing one to folders; ``*`` and ``?`` stay within a name,
    ``**`` does not. What a rule names is matched with all below it. A leading ``!`` is left out here.
    """
    rule = glob.strip().removeprefix("!")
    if not rule or rule.startswith("#"):
        return ""
    folder, rule = rule.endswith("/"), rule.rstrip("/")
    tied, rule = "/" in rule, rule.lstrip("/")
    out = ""
    for part in re.split(r"(\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]*\])", rule):
        out += {"**/": "(?:[^/]+/)*", "/**": "/.+", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^") if part.startswith("[") else re.escape(part))
    return ("^" if tied else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def by_globs(path: Column, globs: list[str]) -> Column:
    """Whether any of the globs excludes a path; one that begins with ``!`` excludes as well."""
    forms = [f for f in map(glob_regex, globs) if f]
    return path.rlike("|".join(forms)) if forms else F.lit(False)


def ignored_by_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` (repo, path, ...) with ``ignored``: what the rules in the folders around a path say of it.

    ``rules`` has repo, folder ('' for the root), n (the line's number) and pattern. The last rule of the deepest folder
    that matches decides; one with ``!`` takes the path back in. Every path asks for the rules of its own folders only;
    the answers are partial maxima per path. Null patterns and folders are no rules, null paths are not ignored.
    """
    turn = F.pandas_udf(lambda s: s.map(glob_regex), "string")
    held = rules.where("pattern is not null and folder is not null").select("repo", F.rtrim(F.col("folder"), F.lit("/")).alias("folder"), "n", "pattern")
    forms = held.withColumns({"form": turn("pattern"), "back": F.startswith(F.trim("pattern"), F.lit("!"))}).where("form <> ''")
    parts = F.split("path", "/")
    paths = files.where("path is not null").select("repo", "path").distinct()
    above = paths.select("repo", "path", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("depth"), parts.alias("parts"))
    asked = above.select("repo", "path", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("folder"), F.array_join(F.slice("parts", F.col("depth") + 1, F.size("parts")), "/").alias("inner"))
    met = asked.join(forms, ["repo", "folder"]).where(F.rlike("inner", F.col("form")))
    told = met.groupBy(F.col("repo").alias("_repo"), F.col("path").alias("_path")).agg((~F.max_by("back", F.struct("depth", "n"))).alias("_ignored"))
    same = (F.col("repo") == F.col("_repo")) & (F.col("path") == F.col("_path"))
    return files.join(told, same, "left").withColumn("ignored", F.coalesce("_ignored", F.lit(False))).drop("_repo", "_path", "_ignored")


def is_binary(path: Column, content: Column) -> Column:
    """A known ending, a model file's magic, or a zero byte among the first 8192; null content is not binary by its bytes."""
    head = F.decode(F.substring(content, 1, HEAD), "ISO-8859-1")
    return extension(path).isin(BINARY) | F.coalesce(F.startswith(head, F.lit("GGUF")) | F.contains(head, F.lit("\u0000")), F.lit(False))


def outcomes(files: DataFrame, globs: list[str]) -> DataFrame:
    """``files`` (path, content binary, ...) with ``outcome``: ignored, binary, unread (no known language, or no UTF-8) or kept."""
    path, content = F.col("path"), F.col("content")
    unread = language_of(path).isNull() | ~F.coalesce(F.is_valid_utf8(content.cast("string")), F.lit(True))
    told = F.when(path.rlike(IGNORED_PATH) | by_globs(path, globs), "ignored").when(is_binary(path, content), "binary").when(unread, "unread").otherwise("kept")
    return files.withColumn("outcome", told)


def scan_statistics(files: DataFrame, globs: list[str] = [], samples: int = 5) -> DataFrame:  # noqa: B006
    """Per repo: files ignored, binary, unread and kept, the bytes of binary ones, and the first few paths passed over.

    Rows of one (repo, path) count once, with their greatest size. Null paths are dropped, null contents have no bytes.
    The samples, a limit by intent, are the least paths, found by partial minima.
    """
    told = outcomes(files.where("path is not null"), globs).groupBy("repo", "path", "outcome").agg(F.max(F.coalesce(F.octet_length("content"), F.lit(0))).alias("bytes"))
    count = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    sums = told.groupBy("repo").agg(count("ignored"), count("binary"), count("unread"), count("kept"), F.sum(F.when(F.col("outcome") == "binary", F.col("bytes")).otherwise(0)).alias("binary_bytes"))
    first = told.where("outcome in ('ignored', 'binary')").groupBy("repo").agg(F.slice(F.array_sort(F.collect_set("path")), 1, samples).alias("samples"))
    return sums.join(first, sums["repo"].eqNullSafe(first["repo"]), "left").select(sums["repo"], "ignored", "binary", "unread", "kept", "binary_bytes", F.array_join(F.coalesce("samples", F.array()), ",").alias("samples"))


def read_sources(spark: SparkSession, root: str, globs: list[str] = [], rules: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """repo, file, content of the text files under ``root`` that a scan keeps; ``rules`` as in ``ignored_by_rules``.

    Paths are told from metadata before contents are read, as far as the reader pushes them down. Spark's readers pass
    over hidden files; files that are no UTF-8 are dropped.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    path = F.replace(F.regexp_replace("path", r"^\w+:/*", "/"), F.lit(base), F.lit(""))
    files = raw.select(F.lit(root).alias("repo"), path.alias("path"), "content").where(language_of(F.col("path")).isNotNull())
    kept = outcomes(files, globs).where("outcome = 'kept'")
    if rules is not None:
        kept = ignored_by_rules(kept, rules).where("not ignored")
    return kept.select("repo", F.col("path").alias("file"), F.col("content").cast("string").alias("content"))
