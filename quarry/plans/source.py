"""Queries over source code: one generated file for each part, its facts by the front-end, and the same facts by SQL from the rule that made the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunking, facts, fixing, frameworks, graph, refactoring, reports, summary
from quarry.operators.reads import reads
from quarry.plans.catalog import register
from quarry.session import table
from quarry.sources import files as sources

#: Folders by part key, with the layer that they tell.
FOLDERS = ["Network", "View", "Storage", "Model"]
LAYERS = ["network", "ui", "persistence", "domain"]

#: The lines of a file of part key k, as SQL that both engines read. Every construct depends on k alone.
_LINES = [
    "'import Foundation'", "CASE WHEN k % 3 = 0 THEN 'import UIKit' ELSE 'import RxSwift' END", "''", "CASE WHEN k % 5 = 0 THEN '// TODO: mend ' || k ELSE '// a note' END",
    "'public class Service' || k || ': Base' || (k % 7) || ', Codable {'", "CASE WHEN k % 2 = 0 THEN '    weak var delegate: Delegate?' ELSE '    var delegate: Delegate?' END", "'    var label: UILabel!'",
    "'    func run' || k || '(a: Int, b: Int) {'", "CASE WHEN k % 4 = 0 THEN '        let value = make(a)!' ELSE '        let value = make(a)' END", "CASE WHEN k % 6 = 0 THEN '        let thing = value as! Thing' ELSE '        let thing = value as? Thing' END",
    "CASE WHEN k % 8 = 0 THEN '        try! save(value)' ELSE '        try? save(value)' END", "'        if a > b { print(a) }'", "CASE WHEN k % 3 = 0 THEN '        Account.sharedInstance().email' ELSE '        other.email' END", "'        client.get(\"/api/user/' || k || '\")'",
    "'        helper.step' || (k % 10) || '(42)'", "CASE WHEN k % 9 = 0 THEN '        stream.subscribe { self.go() }' ELSE '        go()' END", "CASE WHEN k % 7 = 0 THEN '        Task { self.go() }' ELSE '        done()' END", "'    }'", "'}'",
]
_CODE = " || chr(10) || ".join(_LINES)
_FOLDER = "CASE k % 4 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FOLDERS)) + " END"
_PATH = f"'App/' || ({_FOLDER}) || '/Unit' || k || '.swift'"
#: The parts as k and path, for the SQL.
_P = f"(SELECT p_partkey AS k, {_PATH} AS path FROM (SELECT p_partkey, p_partkey AS k FROM part))"
#: The kinds of smells with when and on which line a file has them. What begins a line counts to where the code before it ends, so `try!` is on line 10, which holds no such pattern.
_SMELLS = [("force_unwrap", "k % 4 = 0", 9), ("force_cast", "k % 6 = 0", 10), ("force_try", "k % 8 = 0", 10), ("implicitly_unwrapped", "true", 7), ("print_statement", "true", 12), ("magic_number", "true", 15)]
_N_SMELLS = " + ".join(f"({c})::INT" for _, c, _ in _SMELLS)


def code_files(spark: SparkSession, d: str) -> DataFrame:
    """The source files of all parts."""
    # parsing costs far more than a shuffle of the keys, so they are dealt out to all cores
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k")).repartition(2 * spark.sparkContext.defaultParallelism, "k")
    return sources.described(rows.select(F.expr(_PATH).alias("path"), F.expr(_CODE).alias("text")))


def code_nodes(spark: SparkSession, d: str, *operators: str) -> DataFrame:
    """The nodes of all parts; with *operators* only what these read."""
    return nodes_of(code_files(spark, d), *operators)


def nodes_of(files: DataFrame, *operators: str) -> DataFrame:
    return sources.nodes(files, **(reads(*operators) if operators else {}))


@register("src_smells", " UNION ALL ".join(f"SELECT path, '{kind}' AS kind, '{facts.SEVERITY[kind]}' AS severity, {line} AS line FROM {_P} WHERE {when}" for kind, when, line in _SMELLS))
def src_smells(spark: SparkSession, d: str) -> DataFrame:
    return facts.smells(code_nodes(spark, d, "smells")).select("path", "kind", "severity", "line")


@register("src_smell_counts", "SELECT kind, count(*)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT '{kind}' AS kind FROM {_P} WHERE {when}" for kind, when, _ in _SMELLS) + ") GROUP BY kind")
def src_smell_counts(spark: SparkSession, d: str) -> DataFrame:
    return facts.smells(code_nodes(spark, d, "smells")).groupBy("kind").agg(F.count("*").alias("n"))


@register("src_worst_files", f"SELECT path, ({_N_SMELLS})::BIGINT AS n FROM {_P} ORDER BY n DESC, path LIMIT 15")
def src_worst_files(spark: SparkSession, d: str) -> DataFrame:
    return facts.smells(code_nodes(spark, d, "smells")).groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(15)


@register("src_debt", f"SELECT path, 4 AS line, 'TODO' AS kind, 'mend ' || k AS message FROM {_P} WHERE k % 5 = 0")
def src_debt(spark: SparkSession, d: str) -> DataFrame:
    return facts.debt(sources.read_lines(code_files(spark, d))).select("path", "line", "kind", "message")


@register("src_imports", f"SELECT path, 'Foundation' AS module FROM {_P} UNION ALL SELECT path, CASE WHEN k % 3 = 0 THEN 'UIKit' ELSE 'RxSwift' END FROM {_P}")
def src_imports(spark: SparkSession, d: str) -> DataFrame:
    return facts.imports(code_nodes(spark, d, "imports"))


@register("src_types", f"SELECT path, 'Service' || k AS name, 'class' AS kind, 'public' AS visibility, 'Base' || (k % 7) AS superclass FROM {_P}")
def src_types(spark: SparkSession, d: str) -> DataFrame:
    return facts.type_definitions(code_nodes(spark, d, "type_definitions")).select("path", "name", "kind", "visibility", "superclass")


@register("src_functions", f"SELECT path, 'run' || k AS name, 7 AS line, 12 AS line_count, 2 AS complexity, 2 AS n_params, false AS is_god FROM {_P}")
def src_functions(spark: SparkSession, d: str) -> DataFrame:
    return facts.function_metrics(code_nodes(spark, d, "function_metrics")).select("path", "name", "line", "line_count", "complexity", "n_params", "is_god")


@register("src_endpoints", f"SELECT path, 14 AS line, '/api/user/' || k AS endpoint, 'GET' AS verb, 'run' || k AS context FROM {_P}")
def src_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return facts.endpoints(code_nodes(spark, d, "endpoints"))


@register("src_delegates", f"SELECT path, 'strong_delegate_reference' AS issue, 'delegate' AS detail FROM {_P} WHERE k % 2 = 1")
def src_delegates(spark: SparkSession, d: str) -> DataFrame:
    n = code_nodes(spark, d, "delegates", "wirings")
    return frameworks.delegate_issues(facts.delegates(n), frameworks.wirings(n)).select("path", "issue", "detail")


@register("src_singletons", f"SELECT 'Account.sharedInstance()' AS symbol, 3 * count(*)::BIGINT AS n FROM {_P} WHERE k % 3 = 0")
def src_singletons(spark: SparkSession, d: str) -> DataFrame:
    return frameworks.singleton_usage(facts.references(code_nodes(spark, d, "references")))


@register("src_calls", f"SELECT path, 14 AS line, 'helper.step3' AS callee, 'run' || k AS context FROM {_P} WHERE k % 10 = 3")
def src_calls(spark: SparkSession, d: str) -> DataFrame:
    return facts.calls_to(code_nodes(spark, d), "helper.step3").select("path", "line", "callee", "context")


@register("src_impact", "SELECT count(*)::BIGINT AS n_files, true AS inherited, 'Critical' AS impact, false AS is_safe FROM part WHERE p_partkey % 7 = 3")
def src_impact(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(facts.usages(code_nodes(spark, d, "usages"), "Base3"))[1]


@register("src_call_edges", f"""SELECT src, dst FROM (SELECT 'Service' || k || '.run' || k AS src, unnest(list_concat(['make', 'save', 'print', 'get', 'step' || (k % 10)], list_concat(
  CASE WHEN k % 3 = 0 THEN ['sharedInstance'] ELSE [] END, list_concat(CASE WHEN k % 9 = 0 THEN ['subscribe', 'go'] ELSE ['go'] END, CASE WHEN k % 7 = 0 THEN ['Task'] ELSE ['done'] END)))) AS dst FROM {_P}) GROUP BY ALL""")
def src_call_edges(spark: SparkSession, d: str) -> DataFrame:
    f = code_files(spark, d)
    return graph.call_edges(facts.chunks(f, nodes_of(f, "chunks")))


@register("src_chunks", f"SELECT path || ':7' AS id, 'method' AS kind, 'run' || k AS name, 'Service' || k AS parent_type, 'App/' || ({_FOLDER}) AS module_path, CASE k % 4 {' '.join(f'WHEN {i} THEN {chr(39)}{x}{chr(39)}' for i, x in enumerate(LAYERS))} END AS layer, 12 AS line_count FROM {_P} UNION ALL SELECT path || ':2', 'class', 'Service' || k, NULL, 'App/' || ({_FOLDER}), CASE k % 4 {' '.join(f'WHEN {i} THEN {chr(39)}{x}{chr(39)}' for i, x in enumerate(LAYERS))} END, 18 FROM {_P}")
def src_chunks(spark: SparkSession, d: str) -> DataFrame:
    f = code_files(spark, d)
    return chunking.file_chunks(f, nodes_of(f, "chunks", "finding_lines")).select("id", "kind", "name", "parent_type", "module_path", "layer", "line_count")


@register("src_file_summaries", f"SELECT 'summary:' || path AS id, 19 AS line_count, '1 types: Service' || k || ', 1 methods, conforms to Base' || (k % 7) || ', Codable' || CASE WHEN k % 9 = 0 THEN ', reactive' ELSE '' END AS purpose FROM {_P}")
def src_file_summaries(spark: SparkSession, d: str) -> DataFrame:
    f = code_files(spark, d)
    return chunking.file_summaries(chunking.file_chunks(f, nodes_of(f, "chunks", "finding_lines")), f).select("id", "line_count", "purpose")


@register("src_clusters", "SELECT 'cluster:dir:App/' || folder AS id, n AS line_count FROM (SELECT " + _FOLDER.replace("k % 4", "p_partkey % 4") + " AS folder, count(*)::INT AS n FROM part GROUP BY 1 HAVING count(*) >= 2) UNION ALL SELECT 'cluster:protocol:' || x, n FROM (SELECT 'Base' || (p_partkey % 7) AS x, count(*)::INT AS n FROM part GROUP BY 1 HAVING count(*) >= 2 UNION ALL SELECT 'Codable', count(*)::INT FROM part)")
def src_clusters(spark: SparkSession, d: str) -> DataFrame:
    f = code_files(spark, d)
    n = nodes_of(f, "chunks", "finding_lines")
    return chunking.clusters(facts.type_definitions(nodes_of(f, "type_definitions")), chunking.file_summaries(chunking.file_chunks(f, n), f)).select("id", "line_count")


@register("src_type_summaries", f"SELECT 'typeSummary:Service' || k AS id, 1 AS line_count, '1 methods (0 public). Conforms to: Base' || (k % 7) || ', Codable' AS purpose FROM {_P}")
def src_type_summaries(spark: SparkSession, d: str) -> DataFrame:
    f = code_files(spark, d)
    n = nodes_of(f, "chunks", "finding_lines")
    return chunking.type_summaries(chunking.file_chunks(f, n), facts.type_definitions(nodes_of(f, "type_definitions"))).select("id", "line_count", "purpose")


@register("src_hotspots", f"SELECT 'hotspot:' || path AS id, 2 AS complexity, (k % 5 = 0) AS has_todo FROM {_P} WHERE {_N_SMELLS} >= 5")
def src_hotspots(spark: SparkSession, d: str) -> DataFrame:
    f = code_files(spark, d)
    n = nodes_of(f, "chunks", "finding_lines")
    return chunking.hotspots(chunking.file_chunks(f, n), f, facts.smells(nodes_of(f, "smells")), facts.function_metrics(nodes_of(f, "function_metrics"))).select("id", "complexity", "has_todo")


@register("src_fixes", f"""SELECT path, 'force_unwrap' AS kind, '        guard let value = make(a) else {{ return }}' AS fixed, 'medium' AS confidence FROM {_P} WHERE k % 4 = 0
UNION ALL SELECT path, 'force_cast', '        guard let thing = value as? Thing else {{ return }}', 'medium' FROM {_P} WHERE k % 6 = 0
UNION ALL SELECT path, 'force_try', NULL, NULL FROM {_P} WHERE k % 8 = 0
UNION ALL SELECT path, 'implicitly_unwrapped', '    var label: UILabel?', 'medium' FROM {_P}
UNION ALL SELECT path, unnest(['print_statement', 'magic_number']), NULL, NULL FROM {_P}""")
def src_fixes(spark: SparkSession, d: str) -> DataFrame:
    f = code_files(spark, d)
    return fixing.suggestions(facts.smells(nodes_of(f, "smells")), f).select("path", "kind", "fixed", "confidence")


_RISK = "least(100, (CASE WHEN k % 2 = 1 THEN 10 ELSE 0 END) + 2 * ((CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END)))"


@register("src_health", f"SELECT path, ({_N_SMELLS})::BIGINT AS n_smells, ({_RISK})::BIGINT AS retain_risk, (100 - least(30, 2 * ({_N_SMELLS})) - least(20, {_RISK} // 5))::BIGINT AS score FROM {_P}")
def src_health(spark: SparkSession, d: str) -> DataFrame:
    f = code_files(spark, d)
    return summary.file_health(f, nodes_of(f, "file_health"), sources.read_lines(f)).select("path", F.col("n_smells").cast("long"), F.col("retain_risk").cast("long"), F.col("score").cast("long"))


@register("src_summary", f"SELECT count(*)::BIGINT AS n_files, sum({_N_SMELLS})::BIGINT AS n_smells, count(*)::BIGINT AS n_functions, 0::BIGINT AS n_god, 2.0::DOUBLE AS avg_complexity, least(100, sum((k % 2 = 1)::INT * 10 + 2 * ((k % 9 = 0)::INT + (k % 7 = 0)::INT)))::BIGINT AS retain_risk, count(*)::BIGINT AS n_unused_types FROM {_P}")
def src_summary(spark: SparkSession, d: str) -> DataFrame:
    f = code_files(spark, d)
    return summary.project_summary(f, nodes_of(f, "project_summary"), sources.read_lines(f)).select("n_files", "n_smells", "n_functions", "n_god", F.col("avg_complexity").cast("double"), F.col("retain_risk").cast("long"), "n_unused_types")


@register("src_retain", f"SELECT path, 6 - 1 AS line, 'strong_delegate_property' AS issue, 'high' AS severity FROM {_P} WHERE k % 2 = 1")
def src_retain(spark: SparkSession, d: str) -> DataFrame:
    return frameworks.retain_cycles(code_nodes(spark, d, "retain_cycles")).select("path", "line", "issue", "severity")


@register("src_threads", f"SELECT path, 'actor_isolation' AS issue, 'warning' AS severity FROM {_P} WHERE k % 7 = 0")
def src_threads(spark: SparkSession, d: str) -> DataFrame:
    return frameworks.thread_issues(code_nodes(spark, d, "thread_issues")).select("path", "issue", "severity")


@register("src_reactive", f"SELECT path, unnest(['subscribe_without_disposal', 'strong_self_in_closure']) AS issue FROM {_P} WHERE k % 9 = 0")
def src_reactive(spark: SparkSession, d: str) -> DataFrame:
    return frameworks.reactive_leaks(code_nodes(spark, d, "reactive_leaks")).select("path", "issue")


@register("src_auth", f"SELECT 'Account.email' AS property, count(*)::BIGINT AS n_accesses, count(*)::BIGINT AS n_files, 'MEDIUM: Read from AuthManager.currentProfile or Keychain' AS advice FROM {_P} WHERE k % 3 = 0")
def src_auth(spark: SparkSession, d: str) -> DataFrame:
    return frameworks.migration_priority(frameworks.auth_accesses(code_nodes(spark, d, "auth_accesses")))


@register("src_properties", f"SELECT 'email' AS property, count(*)::BIGINT AS n_reads, 0::BIGINT AS n_writes, 0::BIGINT AS n_calls, count(*)::BIGINT AS n_files FROM {_P} WHERE k % 3 <> 0")
def src_properties(spark: SparkSession, d: str) -> DataFrame:
    return frameworks.property_summary(frameworks.property_accesses(code_nodes(spark, d, "property_accesses"), "other.*"))


@register("src_unused", f"SELECT path, 'Service' || k AS name FROM {_P}")
def src_unused(spark: SparkSession, d: str) -> DataFrame:
    n = code_nodes(spark, d)
    return reports.unused_types(facts.type_definitions(n), n).select("path", "name")


@register("src_ui_mix", f"SELECT 0::BIGINT AS swiftui_files, count(*)::BIGINT AS uikit_files, 0::BIGINT AS mixed_files, false AS is_swiftui_project FROM {_P} WHERE k % 3 = 0")
def src_ui_mix(spark: SparkSession, d: str) -> DataFrame:
    return frameworks.ui_mix(code_nodes(spark, d, "ui_mix"))


@register("src_file_graph", f"SELECT path, 2::BIGINT AS out_degree, 0::BIGINT AS in_degree, false AS is_hub, false AS is_orphan FROM {_P}")
def src_file_graph(spark: SparkSession, d: str) -> DataFrame:
    f = code_files(spark, d)
    return graph.file_graph(f, facts.imports(nodes_of(f, "imports")))


@register("src_detail", f"SELECT path, 3 AS line_count, ['make', 'save'] AS functions, ['Thing'] AS types, 'func extractedFunction()' AS signature FROM {_P}".replace("['make', 'save'] AS functions, ['Thing'] AS types", "'make,save' AS functions, 'Thing' AS types"))
def src_detail(spark: SparkSession, d: str) -> DataFrame:
    r = refactoring.detail(code_files(spark, d), 9, 11)
    return r.select("path", "line_count", F.array_join("functions", ",").alias("functions"), F.array_join("types", ",").alias("types"), "signature")
