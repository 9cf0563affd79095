"""Reports: mechanical checks of citations, salvage, missing parts, rendering."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions.json_reply import json_values

# Caps of what a report shows.
SKELETON_CAPS = {"modules": 40, "entry_points": 15, "edges": 30, "findings": 10}
REASONS_SHOWN = 5
SECTIONS = ["overview", "tech_stack", "architecture", "modules", "data_flow", "review"]


#: Sections of a written report's JSON.
WRITTEN_SECTIONS = ["module_breakdown", "dependencies", "entrypoints", "key_flows", "tech_stack"]


def _string(v: Column, path: str) -> Column:
    """A string inside a variant; null for what isn't one (a number is no string)."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _whole(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def _citations(claim: Column) -> Column:
    """Citations of a claim: bare paths, or objects with a path and perhaps lines; what is neither is left out."""
    listed = F.coalesce(F.try_variant_get(claim, "$.citations", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(listed, lambda c: F.struct(F.coalesce(_string(c, "$"), _string(c, "$.path")).alias("path"), _whole(c, "$.line").alias("line"), _whole(c, "$.end_line").alias("end_line"))), lambda c: c["path"].isNotNull())


def parsed_reports(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports in the text of replies (``report_id``, ``reply``), and their claims.

    Of all JSON objects of a reply the one with most claims counts, the first
    of equals; a reply without an object is no report. Reports: ``report_id``,
    ``summary`` ('' if missing), ``n_claims``. Claims: ``report_id``,
    ``section``, ``nth`` (place in its section), ``text``, ``citations``
    (array of path, line, end_line). A missing section or one that is no list
    has no claims; a claim without a text that is a string is none.
    """
    found = replies.select("report_id", F.posexplode(json_values("reply")).alias("candidate", "value")).select("report_id", "candidate", F.try_parse_json("value").alias("v"))
    found = found.where(F.schema_of_variant("v").startswith("OBJECT"))
    sections = F.array(*[F.struct(F.lit(name).alias("section"), F.coalesce(F.try_variant_get("v", f"$.{name}", "array<variant>"), F.array().cast("array<variant>")).alias("items")) for name in WRITTEN_SECTIONS])
    listed = F.flatten(F.transform(sections, lambda s: F.transform(s["items"], lambda item, nth: F.struct(s["section"].alias("section"), nth.alias("nth"), F.trim(_string(item, "$.text")).alias("text"), _citations(item).alias("citations")))))
    claims = F.filter(listed, lambda c: F.coalesce(c["text"], F.lit("")) != "")
    told = found.select("report_id", "candidate", F.trim(F.coalesce(_string(F.col("v"), "$.summary"), F.lit(""))).alias("summary"), claims.alias("claims"))
    best = told.groupBy("report_id").agg(F.max_by(F.struct("summary", "claims"), F.struct(F.size("claims"), -F.col("candidate"))).alias("best"))
    reports = best.select("report_id", "best.summary", F.size("best.claims").alias("n_claims"))
    return reports, best.select("report_id", F.explode("best.claims").alias("c")).select("report_id", "c.*")


def citation_problem(known: Column, line: Column, end_line: Column, n_lines: Column) -> Column:
    """Why a citation is wrong, null if it isn't: unknown path, line under 1, inverted, beyond the end."""
    upper = F.coalesce(end_line, line)
    return (
        F.when(~known, "unknown_path")
        .when(line.isNull() & end_line.isNull(), F.lit(None))
        .when(F.coalesce(line, F.lit(0)) < 1, "bad_line")
        .when(upper < line, "inverted")
        .when(n_lines.isNull(), "unreadable")
        .when(upper > n_lines, "beyond_end")
    )


def check_citations(citations: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``problem`` to citations (``path``, ``line``, ``end_line``) by joining the known files' line counts (``path``, ``n_lines``)."""
    known = files.select(F.col("path").alias("__path"), F.col("n_lines").alias("__n"), F.lit(True).alias("__known"))
    met = citations.join(known, citations.path == F.col("__path"), "left")
    return met.withColumn("problem", citation_problem(F.coalesce("__known", F.lit(False)), F.col("line"), F.col("end_line"), F.col("__n"))).drop("__path", "__n", "__known")


def judge_claims(claims: DataFrame, checked: DataFrame, key: str = "claim_id") -> DataFrame:
    """Verdict of each claim: valid, no_citation or invalid_citation, with its counts; salvageable if at least one citation is valid."""
    n = checked.groupBy(key).agg(F.count(F.lit(1)).alias("n_citations"), F.count_if(F.col("problem").isNull()).alias("n_valid"))
    out = claims.join(n, key, "left").fillna(0, ["n_citations", "n_valid"])
    verdict = F.when(F.col("n_citations") == 0, "no_citation").when(F.col("n_valid") == F.col("n_citations"), "valid").otherwise("invalid_citation")
    return out.withColumn("verdict", verdict).withColumn("salvageable", (verdict == "invalid_citation") & (F.col("n_valid") > 0))


def salvage(judged: DataFrame, checked: DataFrame, key: str = "claim_id") -> DataFrame:
    """Claims that stay with the citations that stay: invalid citations go, and claims without a valid one."""
    kept = judged.where("verdict = 'valid' or salvageable").select(key, "verdict")
    return checked.where("problem is null").join(kept, key)


def summary(judged: DataFrame) -> DataFrame:
    return judged.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("valid", "no_citation", "invalid_citation")], F.count_if("salvageable").alias("salvaged"))


def flat_claims(reports: DataFrame) -> DataFrame:
    """Claims of ``reports`` (``report_id``, ``sections`` of ``key``, ``title``, ``claims``) in section order, numbered."""
    order = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    s = reports.select("report_id", F.explode("sections").alias("s")).select("report_id", F.col("s.key").alias("section"), F.posexplode("s.claims").alias("nth", "claim"))
    return s.select("report_id", order.alias("section_order"), "section", "nth", F.concat_ws("/", "report_id", "section", F.col("nth").cast("string")).alias("claim_id"), "claim.text", "claim.citations")


def missing_modules(planned: DataFrame, analysed: DataFrame, failed: DataFrame, name: str = "name") -> DataFrame:
    """Planned modules that neither gave an analysis nor a failure, and those that failed, with the reason."""
    silent = planned.select(name).join(analysed.select(name), name, "left_anti").join(failed.select(name), name, "left_anti")
    return silent.select(name, F.lit("no result").alias("reason")).union(failed.select(name, "reason"))


def top_reasons(reasons: DataFrame) -> DataFrame:
    return reasons.orderBy(F.desc("n"), "reason").limit(REASONS_SHOWN)


def merged_state(deltas: DataFrame, added: list[str]) -> DataFrame:
    """State of each task from its deltas (``task_id``, ``seq``, ``key``, ``value``): lists of ``added`` keys grow, of others the last counts."""
    grows = F.col("key").isin(added)
    lists = deltas.where(grows).groupBy("task_id", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias("values"))
    last = deltas.where(~grows).groupBy("task_id", "key").agg(F.array(F.max_by("value", "seq")).alias("values"))
    return lists.union(last)


def rejected_notes(judged: DataFrame, checked: DataFrame, key: str = "claim_id") -> DataFrame:
    """Dropped claims: their first 60 characters and first three problems."""
    why = checked.where("problem is not null").groupBy(key).agg(F.slice(F.sort_array(F.collect_set("problem")), 1, 3).alias("problems"))
    return judged.where("verdict <> 'valid' and not salvageable").join(why, key, "left").select(key, F.substring("text", 1, 60).alias("text"), F.coalesce("problems", F.array(F.lit("no citation"))).alias("problems"))


def best_reading(candidates: DataFrame, key: str, nth: str, items: str) -> DataFrame:
    """Of the readings of each reply (``key``) the one with the most ``items``, the first by ``nth`` of equals; a reading that gave none at all (null) is no candidate."""
    best = F.max_by(F.struct(nth, items), F.struct(F.size(items), -F.col(nth)))
    return candidates.where(F.col(items).isNotNull()).groupBy(key).agg(best.alias("__best")).select(key, "__best.*")


def file_name(owner: str, name: str, sha: str, suffix: str) -> str:
    return f"{owner}__{name}-{sha[:12]}.{suffix}"


def _cite(c) -> str:
    end = f"-{c['end_line']}" if c["end_line"] and c["end_line"] != c["line"] else ""
    return f"{c['path']}:{c['line']}{end}" if c["line"] else c["path"]


def markdown(title: str, sections: list, missing: list[str]) -> str:
    """A report of one repository; empty sections are left out, what is missing always stands at the end."""
    out = [f"# {title}"]
    for s in sections:
        if s["claims"]:
            out += ["", f"## {s['title']}", ""]
            out += [f"- {c['text']} ({', '.join(_cite(x) for x in c['citations'])})" for c in s["claims"]]
    return "\n".join([*out, "", "## Not covered", "", *(f"- {m}" for m in missing or ["nothing"]), ""])


def as_html(title: str, sections: list, missing: list[str]) -> str:
    """The same as HTML, everything escaped."""
    e = html.escape
    out = [f"<h1>{e(title)}</h1>"]
    for s in sections:
        if s["claims"]:
            items = "".join(f"<li>{e(c['text'])} <code>{e(', '.join(_cite(x) for x in c['citations']))}</code></li>" for c in s["claims"])
            out.append(f"<h2>{e(s['title'])}</h2><ul>{items}</ul>")
    out.append("<h2>Not covered</h2><ul>" + "".join(f"<li>{e(m)}</li>" for m in missing or ["nothing"]) + "</ul>")
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body>{''.join(out)}</body></html>"
