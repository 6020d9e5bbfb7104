"""Health of files and projects, rankings, recommendations and the difference from an earlier summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import facts, frameworks, refactoring, reports
from quarry.session import cut

#: Differences of the average complexity up to this are none.
DEAD_BAND = 0.1
#: Packages with newer alternatives, and HTTP clients.
OUTDATED, CLIENTS = ["AFNetworking", "SDWebImage", "MBProgressHUD", "SVProgressHUD"], ["Alamofire", "AFNetworking", "Moya"]


def file_metrics(files: DataFrame, nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    """(path, line_count, n_functions, n_classes, avg_length), longest file first."""
    m = metrics.groupBy("path").agg(F.count("*").alias("n_functions"), F.avg("line_count").alias("avg_length"))
    c = nodes.groupBy("path").agg(F.count_if(F.col("kind") == "ClassDecl").alias("n_classes"))
    d = files.select("path", "line_count").join(m, "path", "left").join(c, "path", "left").na.fill(0, ["n_functions", "n_classes", "avg_length"])
    return d.orderBy(F.desc("line_count"), "path")


def god_functions(metrics: DataFrame, min_lines: int = 50, min_complexity: int = 10) -> DataFrame:
    """Long or complex functions, worst first; the limits can only narrow."""
    kept = metrics.filter("is_god").filter((F.col("line_count") >= min_lines) | (F.col("complexity") >= min_complexity))
    return kept.orderBy(F.desc(F.col("line_count") + 5 * F.col("complexity")), "path", "line")


def averages(metrics: DataFrame) -> DataFrame:
    """One row: functions, god functions, the average length and complexity (0 where there are none), the greatest complexity."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return metrics.agg(F.count("*").alias("n_functions"), F.count_if("is_god").alias("n_god"), zero(F.avg("line_count")).alias("avg_lines"), zero(F.avg("complexity")).alias("avg_complexity"), zero(F.max("complexity")).alias("max_complexity"))


def debt_report(debt: DataFrame) -> dict[str, DataFrame]:
    """Markers in order, their number by kind, and the ten files with the most."""
    files = debt.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(10)
    return {"markers": debt.orderBy("path", "line"), "by_kind": debt.groupBy("kind").agg(F.count("*").alias("n")), "files": files}


def unused_functions(nodes: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(path, name, line, visibility) of private functions whose name nothing mentions; *named* are the symbols used, if they are at hand."""
    named = reports.symbols_used(nodes) if named is None else named
    rows = nodes.filter((F.col("kind") == "FunctionDecl") & F.col("visibility").isin("private", "fileprivate")).select("path", "name", F.col("pos_line").alias("line"), "visibility")
    return rows.join(named, "name", "left_anti")


def unused_reasons(unused: DataFrame, built: DataFrame | None = None) -> DataFrame:
    """*unused* with the reason: also in no target where the files of targets (file_name) are known."""
    if built is None:
        return unused.withColumn("reason", F.lit("No references found in codebase"))
    known = built.select(F.col("file_name").alias("_f")).distinct().withColumn("_in", F.lit(True))
    d = unused.join(known, F.substring_index("path", "/", -1) == F.col("_f"), "left")
    return d.withColumn("reason", F.when(F.col("_in").isNull(), "Not in any build target and not referenced").otherwise("No references found in codebase")).drop("_f", "_in")


def dead_lines(types: DataFrame, functions: DataFrame) -> DataFrame:
    """One row: unused types and functions and a rough number of their lines."""
    t, f = types.agg(F.count("*").alias("n_types")), functions.agg(F.count("*").alias("n_functions"))
    return t.crossJoin(f).withColumn("dead_lines", F.col("n_types") * 50 + F.col("n_functions") * 10)  # one row each


def health(smells: Column, gods: Column, risk: Column, complexity: Column) -> Column:
    """100 less four penalties, each with a limit."""
    extra = F.greatest(F.lit(0), F.floor(complexity).cast("long") - 5)
    penalties = F.least(F.lit(30), smells * 2) + F.least(F.lit(30), gods * 10) + F.least(F.lit(20), F.floor(risk / 5).cast("long")) + F.least(F.lit(20), extra)
    return F.greatest(F.lit(0), 100 - penalties)


def file_health(files: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """A row for each file: line_count, n_smells, n_functions, n_god, avg_complexity, max_complexity, retain_risk, n_extractions, score.

    The counts of a file are one aggregation over its nodes.
    """
    function = F.when((F.col("kind") == "FunctionDecl") & F.col("func_id").isNull(), F.col("complexity"))
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in frameworks.retain_counters(nodes).items()]
    m = nodes.groupBy("path").agg(
        F.count(facts.smell()).alias("n_smells"), F.count(function).alias("n_functions"), F.count_if(function.isNotNull() & facts.is_god()).alias("n_god"), F.avg(function).alias("avg_complexity"), F.max(function).alias("max_complexity"), *counts
    ).select("path", "n_smells", "n_functions", "n_god", "avg_complexity", "max_complexity", frameworks.retain_risk().alias("retain_risk"))
    e = refactoring.opportunities(refactoring.extractions(refactoring.long_functions(nodes), lines)).groupBy("path").agg(F.count("*").alias("n_extractions"))
    d = files.select("path", "line_count")
    for part in (m, e):
        d = d.join(part, "path", "left")
    d = d.na.fill(0, [c for c in d.columns if c != "path"])
    return d.withColumn("score", health(F.col("n_smells"), F.col("n_god"), F.col("retain_risk"), F.col("avg_complexity")))


def project_summary(files: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """One row with the health of a project and what to mend first (issues).

    The nodes are read three times: for all counts, for the names that code mentions, and for the declarations, whose bodies are kept where they are long.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = facts.n_lines()
    function = F.when((F.col("kind") == "FunctionDecl") & F.col("func_id").isNull(), F.struct(n.alias("n"), F.col("complexity").alias("c")))
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in frameworks.retain_counters(nodes).items()]
    averaged = ["n_smells", "n_functions", "n_god", "avg_lines", "avg_complexity", "max_complexity"]
    counted = nodes.agg(
        F.count(facts.smell()).alias("n_smells"), F.count(function).alias("n_functions"), F.count_if(function.isNotNull() & facts.is_god()).alias("n_god"),
        zero(F.avg(function["n"])).alias("avg_lines"), zero(F.avg(function["c"])).alias("avg_complexity"), zero(F.max(function["c"])).alias("max_complexity"), *counts,
    ).select(*averaged, frameworks.retain_risk().alias("retain_risk"))
    named = cut(reports.symbols_used(nodes))
    body = F.when(n > refactoring.LONG, F.col("body")).alias("body")
    declared = cut(nodes.filter(F.col("kind").isin(*facts.TYPE_KINDS, "FunctionDecl")).select("path", "kind", "name", "pos_line", "end_line", "func_id", "visibility", "inherits", body))
    types = reports.unused_types(facts.type_definitions(declared), declared, named)
    found = refactoring.opportunities(refactoring.extractions(refactoring.long_functions(declared), lines))
    parts = [
        counted, found.agg(F.count("*").alias("n_extractions"), F.coalesce(F.sum("reduction"), F.lit(0)).alias("reduction")), types.agg(F.count("*").alias("n_unused_types")),
        unused_functions(declared, named).agg(F.count("*").alias("n_unused_functions")),
    ]
    d = files.agg(F.count("*").alias("n_files"))
    for p in parts:
        d = d.crossJoin(p)  # every part is one row
    c = F.col
    issues = F.array_compact(F.array(
        F.when(c("n_god") > 0, F.concat(c("n_god"), F.lit(" god functions need refactoring"))), F.when(c("n_smells") > 50, F.concat(c("n_smells"), F.lit(" code smells detected"))),
        F.when(c("retain_risk") > 50, F.concat(F.lit("High retain cycle risk: "), c("retain_risk"), F.lit("/100"))), F.when(c("n_unused_types") > 5, F.concat(c("n_unused_types"), F.lit(" potentially unused types"))),
    ))
    return d.withColumn("issues", issues)


def compared(summary: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: the differences of two one-row summaries, and what improved and what regressed as text."""
    keys = ["n_files", "n_smells", "n_god", "avg_complexity"]
    d = summary.select(*keys).crossJoin(baseline.select(*[F.col(k).alias(f"old_{k}") for k in keys]))  # one row each
    change = {k: F.col(k) - F.col(f"old_{k}") for k in keys}
    named = [("n_smells", "Smells", 0.0, "%d"), ("n_god", "God functions", 0.0, "%d"), ("avg_complexity", "Avg complexity", DEAD_BAND, "%.1f")]

    def told(better: bool) -> Column:
        out = []
        for k, label, band, form in named:
            hit = change[k] < -band if better else change[k] > band
            sign = form if better else "+" + form
            out.append(F.when(hit, F.format_string(f"{label}: {form} → {form} ({sign})", F.col(f"old_{k}"), F.col(k), change[k])))
        return F.array_compact(F.array(*out))

    return d.select(*[change[k].alias(f"delta_{k}") for k in keys], told(True).alias("improved"), told(False).alias("regressed"))


def comparison_text(delta: DataFrame) -> DataFrame:
    """One row with the comparison as lines."""
    part = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(head + "\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("  "), x)), "\n")))
    return delta.select(F.concat_ws("\n", part("Improved:", F.col("improved")), part("Regressed:", F.col("regressed"))).alias("text"))


def dependency_advice(pods: DataFrame) -> DataFrame:
    """(advice) for a list of pods (name)."""
    n = pods.select("name").distinct()
    names = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("name"))))
    one = n.agg(F.count("*").alias("n"), names(F.col("name").isin(OUTDATED)).alias("old"), names(F.col("name").startswith("AWS")).alias("aws"), names(F.col("name").contains("Rx")).alias("rx"), names(F.col("name").isin(CLIENTS)).alias("http"))
    joined = lambda head, c: F.concat(F.lit(head), F.array_join(c, ", "))
    return frameworks.advice(one, [
        (F.col("n") > 30, F.concat(F.lit("High pod count ("), "n", F.lit(") - consider consolidating or removing unused dependencies"))), (F.size("old") > 0, joined("Consider modern alternatives for: ", "old")),
        (F.size("aws") > 0, joined("AWS SDK pods found: ", "aws")), (F.size("rx") > 0, joined("RxSwift ecosystem: ", "rx")), (F.size("http") > 1, "Multiple HTTP clients detected - consider standardizing on one"),
    ])


def documentation_coverage(documented: DataFrame) -> DataFrame:
    """(kind, n, n_documented, coverage), with a row for all kinds."""
    n = documented.rollup("kind").agg(F.count("*").alias("n"), F.count_if("documented").alias("n_documented"))
    return n.withColumn("coverage", reports.coverage(F.col("n_documented"), F.col("n")))


def documentation_advice(documented: DataFrame) -> DataFrame:
    d, k = F.col("documented"), F.col("kind")
    one = documented.agg(F.count("*").alias("n"), F.count_if(d).alias("nd"), F.count_if(k == "ProtocolDecl").alias("p"), F.count_if((k == "ProtocolDecl") & d).alias("pd"), F.count_if(k == "FunctionDecl").alias("f"), F.count_if((k == "FunctionDecl") & d).alias("fd"), F.count_if(d & F.col("has_params")).alias("fp"))
    share = reports.coverage(F.col("nd"), F.col("n"))
    return frameworks.advice(one, [
        (share < 50, F.format_string("Low documentation coverage (%.1f%%) - prioritize public API documentation", share)), ((F.col("p") > 0) & (reports.coverage(F.col("pd"), F.col("p")) < 80), "Protocols should be well-documented as they define contracts"),
        ((F.col("f") > 0) & (F.try_divide(F.col("fp"), F.col("fd")) < 0.5), "Many documented functions missing parameter documentation"),
    ])


def test_advice(coverage: DataFrame, tested: DataFrame, has_targets: bool | None = None) -> DataFrame:
    """(advice) from the one row of test coverage and the rows of tested files; critical files are the first five by name."""
    n = tested.agg(F.coalesce(F.sum("n_async_tests"), F.lit(0)).alias("n_async"), F.coalesce(F.sum("n_expectations"), F.lit(0)).alias("n_expect"), F.coalesce(F.sum("n_mocking"), F.lit(0)).alias("n_mock"))
    one = coverage.crossJoin(n)  # one row each
    c = F.col
    first = F.slice(F.array_sort("critical_untested"), 1, 5)
    return frameworks.advice(one, [
        (c("coverage") < 30, F.format_string("Low test coverage (%.1f%%) - prioritize critical path testing", c("coverage"))), ((c("n_async") == 0) & (c("n_expect") > 0), "Consider using async/await tests instead of expectations"),
        ((c("n_mock") == 0) & (c("n_test_files") > 10), "No mocking detected - consider adding mocks for better isolation"), (c("n_orphaned") > 0, F.concat("n_orphaned", F.lit(" test files not in any test target - these won't run!"))),
        (F.lit(has_targets is False), "No test targets found in Xcode project - tests may not be configured"), (F.size(first) > 0, F.concat(F.lit("Critical untested files: "), F.array_join(first, ", "))),
    ])


def api_types(nodes: DataFrame) -> DataFrame:
    """(path, name, kind, visibility, superclass, conforms, methods, properties) of the types that stand in no other type; a first parent that is no protocol is the superclass."""
    first = F.get("inherits", F.lit(0))
    parent = F.when((F.col("kind") == "ClassDecl") & ~frameworks.protocol_like(first), first)
    types = nodes.filter(F.col("kind").isin(facts.TYPE_KINDS) & F.col("ctx_type").isNull()).select(
        "path", "name", F.lower(F.replace("kind", F.lit("Decl"), F.lit(""))).alias("kind"), "visibility", parent.alias("superclass"), F.when(parent.isNotNull(), F.slice("inherits", F.lit(2), F.greatest(F.size("inherits") - 1, F.lit(0)))).otherwise(F.coalesce("inherits", F.array().cast("array<string>"))).alias("conforms")
    )
    m = facts.api_symbols(nodes).filter("ctx_type is not null").groupBy("path", F.col("ctx_type").alias("_t")).agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "FunctionDecl", F.struct("name", "visibility", "signature")))).alias("methods"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "VariableDecl", F.struct("name", "visibility", "type", "is_mutable", "is_static", "is_computed")))).alias("properties"),
    ).withColumnRenamed("_t", "name")
    return types.join(m, ["path", "name"], "left")


def api_text(types: DataFrame) -> DataFrame:
    """(name, text): a type's properties and methods as prose for a reader."""
    prop = F.transform(F.coalesce("properties", F.from_json(F.lit("[]"), types.schema["properties"].dataType)), lambda p: F.concat(F.lit("  "), F.when(p["is_mutable"], "var ").otherwise("let "), p["name"], F.lit(": "), p["type"]))
    method = F.transform(F.coalesce("methods", F.from_json(F.lit("[]"), types.schema["methods"].dataType)), lambda m: F.concat(F.lit("  "), m["signature"]))
    part = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n{head}:\n"), F.array_join(c, "\n")))
    return types.select("name", F.concat_ws("\n", F.concat(F.lit("## "), "kind", F.lit(" "), "name"), F.concat(F.lit("File: "), "path"), part("Properties", prop), part("Methods", method)).alias("text"))


def api_advice(types: DataFrame) -> DataFrame:
    n = F.coalesce(F.size("methods"), F.lit(0))
    one = types.agg(F.array_sort(F.collect_list(F.when(n > 15, F.concat("name", F.lit("("), n, F.lit(")"))))).alias("large"), F.count_if(F.col("name").endswith("Analyzer")).alias("analyzers"))
    return frameworks.advice(one, [(F.size("large") > 0, F.concat(F.lit("Large types (>15 methods): "), F.array_join("large", ", "))), (F.col("analyzers") > 0, F.concat(F.lit("Found "), "analyzers", F.lit(" Analyzer types - see their analyze() methods for API")))])


def throughput(requests: DataFrame) -> DataFrame:
    """One row over requests (total_ms, batch, queue_ms, gpu_ms): texts a second, share of the time that the device worked, average batch."""
    total, texts = F.sum("total_ms"), F.sum("batch")
    return requests.agg(F.count("*").alias("n"), F.round(F.coalesce(F.try_divide(texts, total / 1000), F.lit(0.0)), 1).alias("texts_per_second"), F.round(F.coalesce(F.try_divide(F.sum("gpu_ms") * 100, total), F.lit(0.0)), 1).alias("utilization_pct"), F.round(F.coalesce(F.avg("batch"), F.lit(0.0)), 1).alias("avg_batch"))


def batch_size(total_mb: Column, reserved_mb: Column, margin: int = 8000, item: int = 47, least: int = 8, most: int = 64) -> Column:
    """Texts that fit into what is left of a device's memory, within limits."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor((total_mb - reserved_mb - margin) / item))).cast("int")
