"""Rows as other parts of the system want them: task messages, planner and judge payloads, API shapes, status rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions import urls
from loamline.functions.joins import exchanged

# Caps of payloads.
PLANNER_FILES = 12
TASK_FILES, NEIGHBOUR_FILES, NEIGHBOUR_TARGETS, SYMBOL_FILES, SYMBOL_NAMES = 40, 20, 6, 20, 10


def _capped(df: DataFrame, by: list[str], item: Column, most: int, name: str) -> DataFrame:
    """First ``most`` items of each group, sorted, and how many there are."""
    own = df.select(*by, item.alias("__item")).distinct()
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("__item"))
    first = own.withColumn("__n", nth).where(F.col("__n") <= most).groupBy(*by).agg(F.sort_array(F.collect_list("__item")).alias(name))
    return first.join(exchanged(own.groupBy(*by).agg(F.count(F.lit(1)).alias(f"n_{name}"))), by)


def planner_payload(scored: DataFrame, module_files: DataFrame) -> DataFrame:
    """Per module its score to four decimals, the first twelve files and how many are left out."""
    files = _capped(module_files, ["name"], F.col("path"), PLANNER_FILES, "files")
    return scored.select("name", "score").join(files, "name").select("name", F.round("score", 4).alias("score"), "files", F.greatest(F.col("n_files") - PLANNER_FILES, F.lit(0)).alias("left_out"))


def task_payload(module_files: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """What a module's analysis starts from: 40 files, 20 neighbouring files with 6 targets each, 20 files with 10 symbols each."""
    files = _capped(module_files, ["name"], F.col("path"), TASK_FILES, "files")
    out = edges.join(exchanged(module_files.select(F.col("path").alias("src"), "name")), "src")
    targets = _capped(out, ["name", "src"], F.col("dst"), NEIGHBOUR_TARGETS, "targets")
    nth = F.row_number().over(Window.partitionBy("name").orderBy("src"))
    near = targets.withColumn("__n", nth).where(F.col("__n") <= NEIGHBOUR_FILES).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("src", "targets"))).alias("neighbours"))
    named = _capped(symbols.join(exchanged(module_files), "path").select(F.col("name"), "path", "qualified_name") if "name" not in symbols.columns else symbols.drop("name").join(exchanged(module_files), "path"), ["name", "path"], F.col("qualified_name"), SYMBOL_NAMES, "names")
    nth = F.row_number().over(Window.partitionBy("name").orderBy("path"))
    known = named.withColumn("__n", nth).where(F.col("__n") <= SYMBOL_FILES).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("path", "names"))).alias("symbols"))
    return files.join(exchanged(near), "name", "left").join(exchanged(known), "name", "left")


def module_rows(modules: DataFrame, analyses: DataFrame) -> DataFrame:
    """Modules with their analyses; those without one stay, with empty text."""
    out = modules.join(analyses.select("name", "summary", F.lit(True).alias("analysed")), "name", "left")
    return out.withColumns({"summary": F.coalesce("summary", F.lit("")), "analysed": F.coalesce("analysed", F.lit(False))})


def edge_lists(edges: DataFrame) -> DataFrame:
    """Targets of each source, sorted."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("targets"))


def file_states(files: DataFrame, targets: DataFrame, findings: DataFrame) -> DataFrame:
    """``files`` with their findings and ``state``: not reviewed, reviewed without a finding, or with findings. A row per file at least."""
    keys = [c for c in ("repo_id", "path") if c in files.columns]
    out = files.select(*keys).distinct().join(targets.select(*keys).distinct().withColumn("reviewed", F.lit(True)), keys, "left").join(findings, keys, "left")
    return out.withColumn("state", F.when(F.col("kind").isNotNull(), "findings").when(F.col("reviewed"), "clean").otherwise("not_reviewed")).drop("reviewed")


def file_findings(findings: DataFrame, targets: DataFrame, path: str) -> DataFrame:
    """``file_states`` of one file."""
    one = targets.sparkSession.range(1).select(F.lit(path).alias("path"))
    return file_states(one, targets.where(F.col("path") == path), findings.where(F.col("path") == path).drop("repo_id"))


def repo_slug(url: Column) -> Column:
    """owner/name of a repository URL, else the URL."""
    r = urls.repository(url)
    return F.coalesce(F.concat(r["owner"], F.lit("/"), r["name"]), url)


def running_repos(tasks: DataFrame) -> DataFrame:
    """Working copies of unfinished tasks: exempt from the quota."""
    return tasks.where(~F.col("status").isin("completed", "failed")).select("repo").distinct()


def touched(copies: DataFrame, used: DataFrame) -> DataFrame:
    """Copies with the time of last use renewed by successful uses (``repo``, ``at``)."""
    last = used.groupBy("repo").agg(F.max("at").alias("__at"))
    return copies.join(last, "repo", "left").withColumn("last_used", F.greatest("last_used", F.coalesce("__at", "last_used"))).drop("__at")


def history_rows(tasks: DataFrame, findings: DataFrame) -> DataFrame:
    """A row per finished task with its number of findings, counted from the findings themselves."""
    n = findings.groupBy("task_id").agg(F.count(F.lit(1)).cast("int").alias("finding_count"))
    return tasks.join(n, "task_id", "left").select("task_id", "created_at", "repo", "commit_sha", F.coalesce("finding_count", F.lit(0)).alias("finding_count"))


def delta_events(deltas: DataFrame) -> DataFrame:
    """Progress rows of state deltas: failed if the event says so or the delta brings failures; a failed end has no percent."""
    failed = F.coalesce(F.col("event_failed"), F.lit(False)) | (F.coalesce(F.size("failures"), F.lit(0)) > 0)
    return deltas.withColumn("failed", failed).withColumn("percent", F.when(~(F.col("terminal") & failed), F.when(F.col("terminal"), F.lit(100)).otherwise(F.col("percent"))))


def node_rows(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``failures`` and ``events`` of node runs (``node``, ``scope``, ``duration_ms``, ``summary``, ``error``): every run is an event, a failed one a failure as well."""
    events = runs.select("node", "duration_ms", "summary", F.col("error").isNotNull().alias("failed"))
    return runs.where("error is not null").select("node", "scope", "error"), events


def output_summary(output: Column, most: int = 40) -> Column:
    """A node's output for a log line: keys in order (``output``: name -> JSON), numbers of items of lists and objects, lengths of strings over ``most`` characters."""

    def shown(entry: Column) -> Column:
        value = entry["value"]
        items = F.coalesce(F.json_array_length(value), F.size(F.json_object_keys(value)))
        bare = F.regexp_replace(value, r'^"|"$', "")
        size = F.when(value.startswith("[") | value.startswith("{"), F.concat(F.lit("["), items.cast("string"), F.lit("]")))
        size = size.when(value.startswith('"') & (F.length(bare) > most), F.concat(F.lit("<"), F.length(bare).cast("string"), F.lit(" chars>"))).otherwise(bare)
        return F.concat(entry["key"], F.lit("="), size)

    return F.array_join(F.transform(F.array_sort(F.map_entries(output)), shown), " ")


def findings_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("category", F.format_string("%s: %d candidates, %d reported", "category", "n", "hits").alias("text"))


def skeleton(modules: DataFrame, entries: DataFrame, edges: DataFrame, findings: DataFrame) -> dict[str, DataFrame]:
    """What a report is written from, each part cut to its cap; ``module_count`` is the number of all modules, one row ``n``."""
    from loamline.operators.report import SKELETON_CAPS as caps

    return {
        "module_count": modules.agg(F.count(F.lit(1)).alias("n")),
        "modules": modules.orderBy(F.desc("n_files"), "name").limit(caps["modules"]),
        "entry_points": entries.orderBy("strength", "path").limit(caps["entry_points"]),
        "edges": edges.orderBy("src_module", "dst_module").limit(caps["edges"]),
        "findings": findings.orderBy("severity", "path", "line").limit(caps["findings"]),
    }
