"""Code review: secrets, candidates, targets, judgement and outcomes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions import paths, text
from loamline.functions.joins import exchanged
from loamline.operators import syntax
from loamline.operators.ranking import file_rank, top_per
from loamline.providers import Judge

# Formats of secrets, by name.
SECRETS = {
    "aws_access_key_id": r"\b(AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "openai_key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b",
    "private_key_block": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
ASSIGNED = (
    r"(?i)(?P<name>[A-Za-z0-9_.-]*(?:password|passwd|secret|api[_-]?key|apikey|token|access[_-]?key|private[_-]?key|client[_-]?secret))"
    r"\s*[:=]\s*(?:(?P<quote>['\"])(?P<value>[^'\"\n]{8,})(?P=quote)|(?P<bare>[^\s#'\"][^\s#]{7,}))"
)
REVIEW_TARGETS, RADIUS, JUDGED_AT_ONCE = 10, 2, 8
DEFAULT_SEVERITY = {("security", "certain"): "high", ("security", "contextual"): "medium", ("error_handling", "certain"): "medium", ("error_handling", "contextual"): "low"}

CANDIDATE = "repo_id string, path string, category string, kind string, line int, snippet string, evidence string, confidence string, enclosing string"


def secret_formats(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Matches of the fixed formats in a text column: ``keep``, ``pattern``, ``match``, each match once a place. JVM only."""
    found = F.array(*[F.transform(F.regexp_extract_all(F.col(column), F.lit(p), 0), lambda m, n=n: F.struct(F.lit(n).alias("pattern"), m.alias("match"))) for n, p in SECRETS.items()])
    return df.select(*keep, F.explode(F.flatten(found)).alias("m")).select(*keep, "m.pattern", "m.match")


def secret_matches(files: DataFrame) -> DataFrame:
    """``repo_id``, ``path``, ``line``, ``pattern``, ``name``, ``value`` of everything in the texts that has the form of a secret; a match may span lines."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for repo, path, content in zip(part["repo_id"], part["path"], part["text"]):
                found = [(m.start(), n, "", m.group(0)) for n, p in SECRETS.items() for m in re.finditer(p, content or "")]
                found += [(m.start(), "assigned_credential", m.group("name"), m.group("value") or m.group("bare") or "") for m in re.finditer(ASSIGNED, content or "")]
                rows += [(repo, path, content.count("\n", 0, at) + 1, *what) for at, *what in found]
            yield pd.DataFrame(rows, columns=["repo_id", "path", "line", "pattern", "name", "value"])

    return files.select("repo_id", "path", "text").mapInPandas(run, "repo_id string, path string, line int, pattern string, name string, value string")


def secret_candidates(files: DataFrame, least_entropy: float = text.LEAST_ENTROPY) -> DataFrame:
    """Secrets in all texts given (``repo_id``, ``path``, ``text``), hidden in evidence and in the lines around, those of neighbours too.

    An assigned value counts unless it is a placeholder, repeats its name or is too regular.
    """
    value, assigned = F.col("value"), F.col("pattern") == "assigned_credential"
    real = (value != "") & ~text.is_placeholder(value) & ~text.mirrors_name(F.col("name"), value) & (text.entropy(value) >= least_entropy)
    found = secret_matches(files).where(~assigned | real)
    evidence = F.when(assigned, F.format_string("assigned_credential: %s = %s (entropy %.1f)", "name", text.redact(value), text.entropy(value))).otherwise(F.concat("pattern", F.lit(": "), text.redact(value)))
    per_file = found.groupBy("repo_id", "path").agg(F.collect_set("value").alias("values"), F.collect_list(F.struct("line", evidence.alias("evidence"), F.when(assigned, "contextual").otherwise("certain").alias("confidence"))).alias("found"))  # a file's
    lines = files.select("repo_id", "path", F.split("text", "\n").alias("lines"))
    rows = per_file.join(lines, ["repo_id", "path"]).select("repo_id", "path", "values", "lines", F.explode("found").alias("f")).select("repo_id", "path", "values", "lines", "f.*")
    first = F.greatest(F.col("line") - RADIUS, F.lit(1))
    near = F.array_join(F.slice("lines", first, F.col("line") + RADIUS - first + 1), "\n")
    longest = F.expr("array_sort(values, (a, b) -> case when length(a) <> length(b) then length(b) - length(a) when a < b then -1 when a > b then 1 else 0 end)")
    hidden = F.aggregate(longest, near, lambda acc, v: F.replace(acc, v, text.redact(v)))
    return rows.select("repo_id", "path", F.lit("security").alias("category"), F.lit("hardcoded_secret").alias("kind"), "line", hidden.alias("snippet"), "evidence", "confidence", F.lit("").alias("enclosing"))


def code_candidates(table: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates of the detectors with their snippets; ``table`` holds the files' syntax nodes, stored or persisted."""
    lines = files.select("repo_id", "path", text.lines(F.col("text")).alias("lines"))
    first = F.greatest(F.col("line") - RADIUS, F.lit(1))
    snippet = F.array_join(F.slice("lines", first, F.col("line") + RADIUS - first + 1), "\n")
    return syntax.candidates(table).join(exchanged(lines), ["repo_id", "path"]).select("repo_id", "path", "category", "kind", "line", snippet.alias("snippet"), "evidence", "confidence", "enclosing")


def collect_candidates(files: DataFrame, parsed: DataFrame, targets: DataFrame) -> DataFrame:
    """All candidates of the target files: detectors and secrets where a file parses, secrets alone in secret-shaped files, nothing else."""
    own = files.join(targets.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    good = parsed.where("status = 'parsed'").select("repo_id", "path")
    readable = own.join(good, ["repo_id", "path"], "left_semi")
    shaped = own.where(paths.secret_shaped(F.col("path"))).join(good, ["repo_id", "path"], "left_anti")
    return code_candidates(syntax.nodes(readable).persist(), readable).unionByName(secret_candidates(readable.unionByName(shaped)))


def review_targets(files: DataFrame, centrality: DataFrame, churn: DataFrame, n: int = REVIEW_TARGETS, with_secret_files: bool = False) -> DataFrame:
    """The ``n`` files of each repository worth a review, with the basis; optionally all secret-shaped files as well."""
    own = files.select("repo_id", "path").join(centrality.select("repo_id", "path", F.col("score").alias("centrality")), ["repo_id", "path"]).join(churn.select("repo_id", "path", F.col("n").alias("churn")), ["repo_id", "path"], "left")
    ranked = top_per(file_rank(own, ["repo_id"]), n, ["repo_id"], F.desc("score"), "path")
    out = ranked.select("repo_id", "path", F.format_string("centrality %.4f, churn %d", "centrality", "churn").alias("basis"))
    if with_secret_files:
        extra = files.where(paths.secret_shaped(F.col("path"))).select("repo_id", "path", F.lit("shaped like a secret").alias("basis"))
        out = out.unionByName(extra.join(out, ["repo_id", "path"], "left_anti"))
    return out


def judge_candidates(candidates: DataFrame, judge: Judge | None) -> DataFrame:
    """Candidates with ``verdict`` (report, suppress, unjudged) and ``reason``; without a judge all are unjudged.

    A judge sees eight at a time by their numbers in the batch. What it leaves
    out or answers oddly stays unjudged and is never suppressed.
    """
    if judge is None:
        return candidates.withColumns({"verdict": F.lit("unjudged"), "reason": F.lit("no judge")})
    names = candidates.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), JUDGED_AT_ONCE):
                rows = part.iloc[i : i + JUDGED_AT_ONCE]
                asked = [{"id": j, **r} for j, r in enumerate(rows.to_dict("records"))]
                try:
                    said = {v.get("id"): v for v in judge.judge(asked)}
                except Exception as e:  # a failing service leaves its batch unjudged
                    said = {j: {"reason": f"{type(e).__name__}: {e}"} for j in range(len(rows))}
                verdicts = [said.get(j, {}).get("verdict") for j in range(len(rows))]
                yield rows.assign(verdict=[v if v in ("report", "suppress") else "unjudged" for v in verdicts], reason=[str(said.get(j, {}).get("reason", "")) for j in range(len(rows))])[[*names, "verdict", "reason"]]

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema)
    return candidates.mapInPandas(run, ddl + ", verdict string, reason string")


def default_severity(category: Column, confidence: Column) -> Column:
    out = F.when(F.lit(False), "")
    for (a, b), s in DEFAULT_SEVERITY.items():
        out = out.when((category == a) & (confidence == b), s)
    return out.otherwise("medium")


def findings(judged: DataFrame) -> DataFrame:
    """Reported candidates as findings."""
    return judged.where("verdict = 'report'").select("repo_id", "category", "kind", "path", "line", F.col("reason").alias("message"), F.concat("evidence", F.lit(" [judged]")).alias("evidence"), default_severity(F.col("category"), F.col("confidence")).alias("severity"))


def outcomes(judged: DataFrame, categories: DataFrame, judge: bool = True) -> DataFrame:
    """State of each category: skipped without a judge, failed if nothing could be judged, else executed with its hits; none is not the same as not run."""
    n = judged.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "report").alias("hits"), F.count_if(F.col("verdict") == "unjudged").alias("unjudged"))
    out = categories.select("category").distinct().join(n, "category", "left").fillna(0, ["n", "hits", "unjudged"])
    status = F.when(F.lit(not judge), "skipped").when((F.col("n") > 0) & (F.col("unjudged") == F.col("n")), "failed").otherwise("executed")
    out = out.withColumn("status", status)
    words = F.when(F.col("status") != "executed", F.concat(F.lit("not executed: "), F.col("status"))).when(F.col("hits") > 0, F.concat(F.col("hits").cast("string"), F.lit(" found"))).otherwise("executed, nothing found")
    return out.withColumn("description", words)


def scope_texts() -> dict[str, str]:
    """What each category looked for, for a report's reader."""
    calls = ", ".join(sorted({*syntax.SQL_EXECUTORS, *syntax.SHELL_CALLS, *syntax.SUBPROCESS_CALLS, *syntax.UNSAFE_EVAL}))
    return {"security": f"secrets: {', '.join([*SECRETS, 'assigned_credential'])}; calls: {calls}", "error_handling": f"handlers and calls outside try: {', '.join(sorted({*syntax.IO_CALLS, *syntax.IO_BUILTINS}))}"}


def structural_outcome(n_nodes: int, n_edges: int, degraded: bool) -> str:
    """Structure can't be judged on an empty or degraded graph."""
    return "skipped" if degraded or not n_nodes or not n_edges else "executed"


def severity_tally(found: DataFrame) -> DataFrame:
    low = F.lower("severity")
    return found.groupBy(F.when(low.isin("high", "medium", "low"), low).otherwise("other").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def batch_ids(candidates: DataFrame, size: int = JUDGED_AT_ONCE) -> DataFrame:
    """Number of the batch and place in it, per repository."""
    n = F.row_number().over(Window.partitionBy("repo_id").orderBy("path", "line", "kind")) - 1
    return candidates.withColumns({"batch": F.floor(n / size).cast("int"), "id": (n % size).cast("int")})
