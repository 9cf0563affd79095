"""Repository files, commits and histories as tables, each row under its repository."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions import paths, text, urls
from loamline.operators import python_source, typescript_source

MOST_BYTES = 1 << 20
HISTORY_VERSION = 1
HISTORY = "task_id string, created_at double, schema_version int, repo string, commit_sha string, finding_count int, _corrupt_record string"

PARSED = (
    "repo_id string, path string, language string, status string, reason string,"
    " symbols array<struct<name:string,kind:string,start_line:int,end_line:int,parent:string>>,"
    " imports array<struct<line:int,target:string,kind:string,scope:string,names:array<string>>>,"
    " definitions array<struct<start_line:int,end_line:int,name:string,parent:string,kind:string,statements:array<int>,first_method:int>>"
)

NESTED = {
    "symbols": ["name", "kind", "start_line", "end_line", "parent"],
    "imports": ["line", "target", "kind", "scope", "names"],
    "definitions": ["start_line", "end_line", "name", "parent", "kind", "statements", "first_method"],
}


def read_files(spark: SparkSession, root: str, skipped: list[str] = paths.SKIPPED_IN_PARSE) -> DataFrame:
    """All files under ``root/<repo_id>/``: ``repo_id``, ``path``, ``size``, ``text`` (null if not UTF-8), ``modified``.

    Files without a byte are not listed: Spark plans no split for them. The
    lister doesn't follow links out of the root; paths that leave it after
    normalisation are dropped.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.col("path"), "^.*?" + _literal(root.rstrip("/")) + "/", "")
    out = raw.select(F.substring_index(rel, "/", 1).alias("repo_id"), F.regexp_replace(rel, "^[^/]+/", "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    out = out.where(~paths.under_any(F.col("path"), skipped) & (paths.normalise(F.col("path")) != ""))
    return out.select("repo_id", "path", "size", "modified", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("text"))


def _literal(s: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in s)


def described(files: DataFrame) -> DataFrame:
    """Add directory, name, suffix, language and the two line counts."""
    p = F.col("path")
    return files.withColumns({"dir": paths.parent(p), "name": paths.file_name(p), "suffix": paths.suffix(p), "language": paths.language(p), "n_lines_py": F.size(text.lines(F.col("text"))), "n_lines_nl": text.n_lines_nl(F.col("text"))})


def language_profile(files: DataFrame) -> DataFrame:
    """Files, share and parseability by language in each repository."""
    own = files.where(~paths.under_any(F.col("path"), paths.SKIPPED_IN_PROFILE)).select("repo_id", paths.language(F.col("path")).alias("language"), F.lower(paths.suffix(F.col("path"))).isin(paths.PARSED_SUFFIXES).alias("parseable"))
    by = own.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("n"), F.count_if("parseable").alias("parseable"))
    total = own.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"))
    return by.join(total, "repo_id").withColumn("share", F.col("n") / F.col("total"))


def inventory(files: DataFrame) -> DataFrame:
    """What admission looks at: total and parseable files and kilobytes of each repository."""
    parseable = F.lower(paths.suffix(F.col("path"))).isin(paths.PARSED_SUFFIXES)
    out = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_files"), F.count_if(parseable).alias("parseable_files"), (F.sum("size") / 1024).cast("long").alias("size_kb"))
    return out.withColumn("admit_reason", urls.admission(F.lit(False), F.col("parseable_files"), F.col("size_kb")))


def disk_usage(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(F.sum("size").alias("size"), F.max("modified").alias("last_used"))


def parse(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row for every file with a parsed suffix; a failure is a row with its reason."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for repo, path, size, content in zip(part["repo_id"], part["path"], part["size"], part["text"]):
                python = path.endswith((".py", ".pyi"))
                out = python_source.Source()
                if size > most_bytes:
                    out.reason = f"too large: {size} bytes"
                elif content is None:
                    out.reason = "not UTF-8"
                else:
                    out = (python_source if python else typescript_source).read(content)
                rows.append((repo, path, "python" if python else "typescript", "unparsed" if out.reason else "parsed", out.reason or None, out.symbols, out.imports, out.definitions))
            table = pd.DataFrame(rows, columns=["repo_id", "path", "language", "status", "reason", *NESTED])
            for name, names in NESTED.items():
                table[name] = [[dict(zip(names, r)) for r in v] for v in table[name]]
            yield table

    own = files.where(F.lower(paths.suffix(F.col("path"))).isin(paths.PARSED_SUFFIXES)).select("repo_id", "path", "size", "text")
    return own.mapInPandas(run, PARSED)


def symbols(parsed: DataFrame) -> DataFrame:
    s = parsed.select("repo_id", "path", F.explode("symbols").alias("s")).select("repo_id", "path", "s.*")
    return s.dropDuplicates(["repo_id", "path", "name", "start_line"]).withColumn("qualified_name", F.coalesce(F.concat("parent", F.lit("."), "name"), "name"))


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo_id", "path", "language", F.explode("imports").alias("i")).select("repo_id", "path", "language", "i.*")


def unparsed_reasons(parsed: DataFrame) -> DataFrame:
    """Numbers of unparsed files by reason, up to the colon."""
    return parsed.where("status = 'unparsed'").groupBy(F.regexp_extract("reason", "^([^:：]*)", 1).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def churn(commits: DataFrame, last: int = 500) -> DataFrame:
    """Commits touching each path among the last ``last`` of a repository (``repo_id``, ``commit_id``, ``seq``, ``path``)."""
    recent = commits.select("repo_id", "commit_id", "seq").distinct()
    from loamline.operators.ranking import top_per

    kept = top_per(recent, last, ["repo_id"], F.desc("seq"), name="__nth").select("repo_id", "commit_id")
    return commits.join(kept, ["repo_id", "commit_id"], "left_semi").groupBy("repo_id", "path").agg(F.countDistinct("commit_id").alias("n"))


def save_history(entries: DataFrame, folder: str) -> None:
    """One JSON line per analysis; Spark's committer makes each file appear whole or not at all."""
    entries.withColumn("schema_version", F.lit(HISTORY_VERSION)).write.mode("append").json(folder)


def read_history(spark: SparkSession, folder: str, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """The newest ``most`` entries, and the numbers of corrupt and of other-version rows."""
    raw = spark.read.schema(HISTORY).option("mode", "PERMISSIVE").json(folder)
    corrupt, other = F.col("_corrupt_record").isNotNull(), F.coalesce(F.col("schema_version") != HISTORY_VERSION, F.lit(True))
    marked = raw.select("*", corrupt.alias("__corrupt"), other.alias("__other"))
    skipped = marked.agg(F.count_if("__corrupt").alias("corrupt"), F.count_if(~F.col("__corrupt") & F.col("__other")).alias("other_version"))
    good = marked.where("not __corrupt and not __other").drop("__corrupt", "__other", "_corrupt_record")
    return good.orderBy(F.desc("created_at"), "task_id").limit(most), skipped


def write_vectors(vectors: DataFrame, folder: str) -> None:
    """Vectors by digest of their index; writing a digest again replaces only it."""
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("digest").parquet(folder)
