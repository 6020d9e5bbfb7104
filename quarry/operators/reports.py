"""Reports over facts: counts, scores, file rollups, fix suggestions, the job queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import text as T

# Severities in order.
SEVERITIES = ["critical", "high", "medium", "low"]


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def smell_order(smells: DataFrame) -> DataFrame:
    """Smells by severity, file and line."""
    return smells.orderBy(severity_rank(F.col("severity")), "path", "line", "kind", "code")


def counts(findings: DataFrame, *by: str) -> DataFrame:
    """The count for each value of each column and in all, in one pass."""
    return findings.groupingSets([*[[b] for b in by], []], *by).agg(F.count("*").alias("n"))


def coverage(part: Column, total: Column, empty: float = 0.0) -> Column:
    """Percentage of *total*; *empty* where there is none."""
    return F.when(total > 0, part * 100.0 / total).otherwise(F.lit(empty))


def bucket(n: Column, limits: list[tuple[int, str]], least: str) -> Column:
    """The label of the first limit that *n* exceeds."""
    out = F.lit(least)
    for limit, label in sorted(limits):
        out = F.when(n > limit, F.lit(label)).otherwise(out)
    return out


def hotspots(metrics: DataFrame, smells: DataFrame, references: DataFrame) -> DataFrame:
    """Files with a god function, five smells or a singleton: each side is aggregated before the join."""
    f = metrics.groupBy("path").agg(F.count_if("is_god").alias("n_god"), F.sum("complexity").alias("complexity"))
    s = smells.groupBy("path").agg(F.count("*").alias("n_smells"))
    r = references.groupBy("path").agg(F.count_if(F.col("kind") == "globalSingleton").alias("n_singletons"))
    return f.join(s, "path", "full").join(r, "path", "full").na.fill(0).filter("n_god > 0 or n_smells >= 5 or n_singletons > 0")


def protocol_clusters(types: DataFrame) -> DataFrame:
    """Protocols with two or more conforming types in two or more files."""
    rows = types.filter("kind <> 'protocol'").select(F.explode("conformances").alias("protocol"), "name", "path")
    found = rows.groupBy("protocol").agg(F.array_sort(F.collect_set("name")).alias("conformers"), F.count_distinct("path").alias("n_files"))
    return found.filter((F.size("conformers") >= 2) & (F.col("n_files") >= 2))


def symbols_used(nodes: DataFrame) -> DataFrame:
    """(name): every name that code mentions: references, types, members and what members are taken of, parents."""
    own = F.when(F.col("kind").isin("TypeReference", "DeclReferenceExpr"), F.array("name")).when(F.col("kind") == "MemberAccessExpr", F.array("member", "base"))
    none = F.array().cast("array<string>")
    return nodes.select(F.explode(F.concat(F.coalesce(own, none), F.coalesce("inherits", none))).alias("name")).filter("name is not null").distinct()


def unused_types(types: DataFrame, nodes: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Types that nothing names, but for views, cells, controllers and delegates; *named* are the symbols used, if they are at hand."""
    return types.filter(~F.col("name").rlike("(ViewController|Cell|View|Delegate)$") & (F.col("kind") != "extension")).join(symbols_used(nodes) if named is None else named, "name", "left_anti")


def rescan(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row with the numbers of new, updated, unchanged and deleted files between two (path, content_hash) tables."""
    both = old.select("path", F.col("content_hash").alias("o")).join(new.select("path", F.col("content_hash").alias("n")), "path", "full")
    o, n = F.col("o"), F.col("n")
    return both.agg(F.count_if(o.isNull()).alias("n_new"), F.count_if(o != n).alias("n_updated"), F.count_if(o == n).alias("n_unchanged"), F.count_if(n.isNull()).alias("n_deleted"))


def queue(jobs: DataFrame, worker: str = "worker") -> DataFrame:
    """Queued jobs with their position and the chunks ahead of them, the rest of the active job included.

    *jobs* has job_id, state, submitted, total and done, and the worker that owns the queue.
    """
    waiting = F.col("state") == "queued"
    w = Window.partitionBy(worker).orderBy("submitted", "job_id")
    left = F.when(F.col("state").isin("queued", "active"), F.col("total") - F.col("done")).otherwise(0)
    live = jobs.filter("state in ('queued', 'active')").withColumn("_first", F.when(F.col("state") == "active", 0).otherwise(1))
    order = Window.partitionBy(worker).orderBy("_first", "submitted", "job_id").rowsBetween(Window.unboundedPreceding, -1)
    return live.withColumn("chunks_ahead", F.coalesce(F.sum(left).over(order), F.lit(0))).filter(waiting).withColumn("position", F.row_number().over(w)).select(worker, "job_id", "position", "chunks_ahead")


def failing_tests(lines: DataFrame, opens: str = r"^\s*(?:✗|FAIL:?)\s+(\S+)", closes: str = r"^\s*$|^\s*(?:✓|PASS)") -> DataFrame:
    """(path, test, message): the lines after a failing test until a blank line or the next mark."""
    name = F.nullif(F.regexp_extract("line", opens, 1), F.lit(""))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_start", name).withColumn("_stop", F.col("line").rlike(closes))
    rows = rows.withColumn("_state", F.last(F.when(F.col("_start").isNotNull(), F.struct(F.col("line_no").alias("at"), F.col("_start").alias("test"))).when(F.col("_stop"), F.struct(F.col("line_no").alias("at"), F.lit(None).cast("string").alias("test"))), ignorenulls=True).over(w))
    inside = rows.filter("_state.test is not null")
    body = F.array_sort(F.collect_list(F.when(F.col("_start").isNull(), F.struct("line_no", "line"))))
    return inside.groupBy("path", "_state").agg(body.alias("b")).select("path", F.col("_state.test").alias("test"), F.array_join(F.transform("b", lambda x: x["line"]), "\n").alias("message"))


def checklist(items: DataFrame, phase: str, title: str) -> DataFrame:
    """One Markdown text for each phase: a heading and a box for each distinct item, in order."""
    boxes = F.array_sort(F.collect_set(F.concat(F.lit("- [ ] "), F.col(title))))
    return items.groupBy(phase).agg(F.concat_ws("\n", F.concat(F.lit("## "), F.first(phase)), F.array_join(boxes, "\n")).alias("text"))


def file_of(symbols: DataFrame, name: str, path: str) -> DataFrame:
    """The file name that defines each symbol; the last path where several do."""
    return symbols.groupBy(name).agg(T.last_part(F.max(path)).alias("file_name"))
