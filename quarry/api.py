"""A project and its calls: tools and modes by name, results kept for each snapshot, and requests as lines of JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import index as vectors
from quarry.operators import audits, chunking, facts, fixing, frameworks, graph, refactoring, reports, summary
from quarry.session import cut
from quarry.sources import files as sources
from quarry.sources import xcode

VERSION = "2"
#: Rows of a table that a report as text holds; tables themselves are whole.
SHOWN = 1000

Result = DataFrame | dict[str, DataFrame] | dict | str


class Project:
    """The facts of a source tree and everything that can be asked of them.

    Facts are materialised once for each scan. A result is kept under its call, its arguments and the scan, so a
    rescan never gives an old one.
    """

    def __init__(self, spark: SparkSession, root: str, include_tests: bool = True, provider: vectors.Provider | None = None, index_root: str | None = None):
        self.spark, self.include_tests, self.provider, self.index_root = spark, include_tests, provider or vectors.HashingProvider(), index_root
        self.scan_id, self.results, self.indexing = 0, {}, False
        self.set_project(root)

    def set_project(self, root: str) -> dict:
        """Turns to another folder; it must be there."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(root)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            raise FileNotFoundError(root)
        self.root = root
        return self.rescan()

    @classmethod
    def of(cls, files: DataFrame, provider: vectors.Provider | None = None, index_root: str | None = None) -> Project:
        """A project over a table of files (path, text) instead of a folder."""
        p = cls.__new__(cls)
        p.spark, p.include_tests, p.provider, p.index_root, p.root = files.sparkSession, True, provider or vectors.HashingProvider(), index_root, ""
        p.scan_id, p.results, p.indexing = 1, {}, False
        p.files = sources.described(files).persist()
        return p

    def rescan(self) -> dict:
        """Reads the tree again; the numbers of new, updated, unchanged and deleted files."""
        old = self.__dict__.get("hashes")
        if "files" in self.__dict__:
            self.files.unpersist(blocking=True)  # or Spark would take the kept rows for the tree as it is now
        self.files = sources.source_files(self.spark, self.root, self.include_tests).persist()
        self.hashes = cut(self.files.select("path", "content_hash"))
        counts = reports.rescan(old if old is not None else self.hashes.limit(0), self.hashes).first().asDict()
        self.invalidate()
        return counts

    def invalidate(self) -> dict:
        """Forgets parsed facts and results; the next call makes them anew."""
        for name in ("nodes", "lines"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()
        for name in ("chunks", "file_chunks", "built"):
            self.__dict__.pop(name, None)
        self.results.clear()
        self.scan_id += 1
        return {"scan": self.scan_id}

    @cached_property
    def nodes(self) -> DataFrame:
        return sources.nodes(self.files).persist()

    @cached_property
    def lines(self) -> DataFrame:
        return sources.read_lines(self.files).persist()

    @cached_property
    def file_chunks(self) -> DataFrame:
        return chunking.file_chunks(self.files, self.nodes).persist()

    @cached_property
    def chunks(self) -> DataFrame:
        return self.file_chunks.unionByName(chunking.virtual_chunks(self.file_chunks, self.files, self.nodes)).persist()

    @cached_property
    def built(self) -> DataFrame | None:
        """The files of Xcode targets, where the folder has a project file."""
        if not self.root:
            return None
        rows = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pbxproj").load(self.root).select("path", F.decode("content", "UTF-8").alias("text"))
        return xcode.target_files(rows) if rows.take(1) else None

    def stats(self) -> dict:
        """Files, and how many of them are parsed."""
        n = self.files.count()
        return {"files": n, "parsed": n if "nodes" in self.__dict__ else 0, "results": len(self.results), "scan": self.scan_id}

    def of_path(self, path: str | None, nodes: bool = True) -> DataFrame:
        """The nodes (or files) of a path, or all; files are chosen before they are parsed."""
        if path is None:
            return self.nodes if nodes else self.files
        chosen = sources.matching(self.files, path)
        return sources.nodes(chosen) if nodes else chosen

    def folder(self) -> str:
        if not self.index_root:
            raise ValueError("an index needs index_root, a folder that driver and executors share")
        return vectors.location(self.index_root, self.root)

    def call(self, tool: str, **args: Any) -> Result:
        """The result of a tool; of an unknown one, KeyError."""
        if tool not in TOOLS:
            raise KeyError(f"unknown tool {tool}")
        if tool in CHANGING:
            return TOOLS[tool](self, **args)
        key = (tool, json.dumps(args, sort_keys=True, default=str), self.scan_id)
        if key not in self.results:
            self.results[key] = TOOLS[tool](self, **args)
        return self.results[key]

    def mode(self, flag: str, *values: str) -> Result:
        """The result of a mode of the command line, with the values that follow it."""
        name, names = MODES[flag]
        return self.call(name, **dict(zip(names, values, strict=False))) if not callable(name) else name(self, *values)


def document(result: Result, shown: int = SHOWN) -> Any:
    """A result as plain data: each table as a list of its first rows."""
    if isinstance(result, DataFrame):
        return [json.loads(r) for r in result.limit(shown).toJSON().collect()]
    if isinstance(result, dict):
        return {k: document(v, shown) for k, v in result.items()}
    return result


def serve(project: Project, lines: Iterable[str]) -> Iterator[str]:
    """The answers to requests, one JSON object a line: {"id", "method": "tools/list" or "tools/call", "params": {"name", "arguments"}}."""
    for line in lines:
        request: dict = {}
        try:
            request = json.loads(line)
            method, params = request.get("method"), request.get("params") or {}
            if method == "tools/list":
                answer: Any = {"tools": sorted(TOOLS)}
            elif method == "tools/call":
                answer = document(project.call(params["name"], **params.get("arguments", {})))
            else:
                raise KeyError(f"unknown method {method}")
            yield json.dumps({"id": request.get("id"), "result": answer}, sort_keys=True, ensure_ascii=False)
        except (KeyError, ValueError, TypeError, FileNotFoundError) as e:
            yield json.dumps({"id": request.get("id") if isinstance(request, dict) else None, "error": str(e)}, sort_keys=True, ensure_ascii=False)


# The tools


def _smells(p: Project, path: str | None = None) -> Result:
    s = facts.smells(p.of_path(path))
    return {"smells": reports.smell_order(s), "counts": reports.counts(s, "kind", "severity"), "files": s.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(15)}


def _impact(p: Project, symbol: str) -> Result:
    u = facts.usages(p.nodes, symbol)
    files, row = graph.impact(u)
    return {"impact": row, "files": files, "usages": u}


def _refactoring(p: Project, path: str | None = None) -> Result:
    n = p.of_path(path)
    f = refactoring.long_functions(n)
    found = refactoring.extractions(f, p.lines)
    return {"functions": f, "sections": refactoring.sections(f, p.lines), "blocks": refactoring.blocks(f, n), "variables": refactoring.shared_variables(f, n), "extractions": found, "opportunities": refactoring.opportunities(found), "analyzers": refactoring.signature_table(f)}


def _fix(p: Project, path: str, line: int | None = None, kind: str | None = None) -> Result:
    chosen = sources.unique_file(p.files, path)
    s = facts.smells(sources.nodes(chosen))
    s = s.filter(F.col("line") == line) if line is not None else s
    s = s.filter(F.col("kind") == kind) if kind else s
    return fixing.suggestions(s, chosen)


def _property(p: Project, pattern: str, filterProperty: str | None = None) -> Result:  # noqa: N803
    a = frameworks.property_accesses(p.nodes, pattern, filterProperty)
    return {"accesses": a, "properties": frameworks.property_summary(a)}


def _singletons(p: Project, path: str | None = None) -> Result:
    r = facts.references(p.of_path(path))
    return {"references": r, "usage": frameworks.singleton_usage(r), "files": r.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(10), "imports": facts.imports(p.of_path(path))}


def _types(p: Project, path: str | None = None) -> Result:
    m = chunking.type_map(facts.type_definitions(p.of_path(path)))
    return m | {"chains": graph.ancestors(m["parents"])}


def _delegates(p: Project, path: str | None = None) -> Result:
    n = p.of_path(path)
    w = frameworks.wirings(n)
    conformers = chunking.type_map(facts.type_definitions(n))["conformers"]
    return {"wirings": w, "issues": frameworks.delegate_issues(facts.delegates(n), w), "protocols": frameworks.delegate_protocols(conformers, w)}


def _unused(p: Project, path: str | None = None) -> Result:
    n = p.of_path(path)
    t, f = reports.unused_types(facts.type_definitions(n), n), summary.unused_functions(n)
    return {"types": summary.unused_reasons(t, p.built), "functions": f, "summary": summary.dead_lines(t, f)}


def _network(p: Project, path: str | None = None) -> Result:
    n = p.of_path(path)
    e = facts.endpoints(n)
    first = e.groupBy("endpoint", "path").agg(F.min_by(F.struct("line", "verb", "context"), "line").alias("f")).select("endpoint", "path", "f.*").orderBy("endpoint", "path")
    return {"endpoints": first, "patterns": frameworks.network_patterns(n)}


def _reactive(p: Project, path: str | None = None) -> Result:
    n = p.of_path(path)
    return {"subscriptions": frameworks.subscriptions(n).drop("node_id", "func_id"), "leaks": frameworks.reactive_leaks(n), "counters": frameworks.counted(n, frameworks.reactive_counters(n)), "framework": frameworks.reactive_framework(n)}


def _literals(p: Project, path: str | None = None) -> Result:
    s = frameworks.string_literals(p.of_path(path))
    return {"literals": s, "coverage": frameworks.localization_coverage(s)}


def _accessibility(p: Project, path: str | None = None) -> Result:
    n = p.of_path(path)
    f = frameworks.accessibility_by_file(n)
    total = f.agg(F.coalesce(F.sum("n_elements"), F.lit(0)).alias("n_elements"), F.coalesce(F.sum("n_set"), F.lit(0)).alias("n_set"))
    return {"issues": frameworks.accessibility_issues(n), "files": f, "uses": frameworks.accessibility_uses(n).groupBy("api").agg(F.count("*").alias("n")), "coverage": total.withColumn("coverage", reports.coverage(F.col("n_set"), F.col("n_elements")))}


def _threads(p: Project, path: str | None = None) -> Result:
    n = p.of_path(path)
    c, i = frameworks.counted(n, frameworks.concurrency(n), None), frameworks.thread_issues(n)
    return {"issues": i.orderBy("severity", "path", "line"), "counters": c, "advice": frameworks.thread_advice(c, i)}


def _swiftui(p: Project, path: str | None = None) -> Result:
    n = p.of_path(path)
    v, c = frameworks.swiftui_views(n), frameworks.counted(n, frameworks.ui_patterns(n))
    return {"views": v, "issues": frameworks.swiftui_issues(v), "patterns": frameworks.patterns(c.toDF(*[x.replace(" ", "_") for x in c.columns]), *[x.replace(" ", "_") for x in c.columns if x != "path"]), "mix": frameworks.ui_mix(n)}


def _uikit(p: Project, path: str | None = None) -> Result:
    n = p.of_path(path)
    c, k = frameworks.counted(n, frameworks.uikit_counters(), None), frameworks.uikit_classes(n)
    score = c.crossJoin(k.agg(F.count_if("massive").alias("n_massive"))).withColumn("score", frameworks.modernization())  # one row each
    return {"classes": k, "counters": score}


def _tests(p: Project) -> Result:
    t = audits.tested_files(p.files, p.nodes, p.built)
    c = audits.test_coverage(t)
    return {"files": t, "coverage": c, "untested": audits.untested(t), "advice": summary.test_advice(c, t)}


def _dependencies(p: Project) -> Result:
    def named(glob: str) -> DataFrame:
        rows = p.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(p.root)
        return rows.select("path", F.decode("content", "UTF-8").alias("text"))

    pods = sources.podfile(named("Podfile"))
    return {"pods": pods, "packages": sources.package_manifest(named("Package.swift")), "cartfile": sources.cartfile(named("Cartfile")), "advice": summary.dependency_advice(pods)}


def _core_data(p: Project, path: str | None = None) -> Result:
    n = p.of_path(path)
    e, r = frameworks.entities(n), frameworks.fetch_requests(n)
    c = frameworks.counted(n, frameworks.core_data_counters(), None).crossJoin(e.agg(F.count("*").alias("n_entities"))).crossJoin(r.agg(F.count_if(~F.col("has_predicate")).alias("n_open")))  # one row each
    return {"entities": e, "requests": r, "counters": c, "advice": frameworks.core_data_advice(c, F.col("n_entities"), F.col("n_open"))}


def _docs(p: Project, path: str | None = None) -> Result:
    d = facts.documentation(p.of_path(path))
    return {"symbols": d, "coverage": summary.documentation_coverage(d), "advice": summary.documentation_advice(d)}


def _retain(p: Project, path: str | None = None) -> Result:
    n = p.of_path(path)
    c = frameworks.counted(n, frameworks.retain_counters(n), None)
    return {"cycles": frameworks.retain_cycles(n), "captures": facts.captures(n), "counters": c.withColumn("risk", frameworks.retain_risk()), "advice": frameworks.retain_advice(c)}


def _api(p: Project, path: str | None = None) -> Result:
    t = summary.api_types(p.of_path(path))
    return {"types": t, "functions": facts.api_symbols(p.of_path(path)).filter("ctx_type is null and kind = 'FunctionDecl'"), "text": summary.api_text(t), "advice": summary.api_advice(t)}


def _auth(p: Project, path: str | None = None) -> Result:
    a = frameworks.auth_accesses(p.of_path(path))
    return {"accesses": a, "priority": frameworks.migration_priority(a)}


def _checklist(p: Project) -> Result:
    a = frameworks.auth_accesses(p.nodes)
    phases = frameworks.migration_phases(frameworks.migration_priority(a), a)
    return {"phases": frameworks.migration_checklist(phases), "places": phases}


def _diagram(p: Project, type: str = "full", maxNodes: int = graph.MAX_NODES) -> Result:  # noqa: A002, N803
    used = frameworks.singleton_usage(facts.references(p.nodes)) if type == "singletons" else None
    return graph.diagram(facts.type_definitions(p.nodes), type, maxNodes, used)


def _build_index(p: Project) -> Result:
    p.indexing = True
    try:
        folder = p.folder()
        newest = vectors.latest(p.spark, folder)
        if newest is not None and vectors.read(p.spark, folder, p.provider).meta["is_complete"]:
            version = vectors.reindex(p.files, p.nodes, folder, p.provider) or newest
        else:
            start = vectors.load(p.spark, folder, p.files, p.provider)[0].index if newest is not None else None
            version = vectors.build(p.chunks, p.files, folder, p.provider, start)
    finally:
        p.indexing = False
    return {"version": version} | vectors.status(p.spark, folder)


def _snapshot(p: Project) -> vectors.Snapshot:
    return vectors.read(p.spark, p.folder(), p.provider)


def _similar(p: Project, chunk_id: str, top_k: int = 10) -> Result:
    from quarry.operators import search

    s = _snapshot(p)
    near = search.similar_to(s.index, "chunk_id", "embedding", chunk_id, top_k)
    return s.chunks.join(F.broadcast(near), s.chunks.id == near.chunk_id).drop("chunk_id").orderBy(F.desc("score"), "id")


def _analyze_file(p: Project, path: str) -> Result:
    chosen = sources.unique_file(p.files, path)
    return {"health": summary.file_health(chosen, sources.nodes(chosen), sources.read_lines(chosen)), "counts": reports.counts(facts.smells(sources.nodes(chosen)), "kind")}


def _build_log(p: Project, text: str) -> Result:
    d = sources.build_log(p.spark.createDataFrame([("log", text)], "path string, text string"))
    return d.withColumn("advice", fixing.message_advice(F.col("message")))


def _test_log(p: Project, text: str) -> Result:
    log = p.spark.createDataFrame([("log", text)], "path string, text string")
    r = sources.test_log(log)
    return {"tests": r, "summary": summary_of(r), "messages": reports.failing_tests(sources.read_lines(log), r"^\s*✘\s+(\S+)", r"^\s*$|^\s*[✔✘]")}


def summary_of(results: DataFrame) -> DataFrame:
    return sources.test_summary(results)


def _server(p: Project, requests: list[dict] | None = None) -> Result:
    """What a server would tell of itself, from its own log of requests: a remote one is not asked."""
    if not requests:
        return {"provider": p.provider.name, "dimensions": p.provider.dimensions}
    d = p.spark.createDataFrame([(float(r["total_ms"]), int(r["batch"]), float(r["queue_ms"]), float(r["gpu_ms"])) for r in requests], "total_ms double, batch long, queue_ms double, gpu_ms double")
    return {"throughput": summary.throughput(d)}


TOOLS: dict[str, Callable[..., Result]] = {
    "get_version": lambda p: {"version": VERSION, "tools": len(TOOLS)}, "get_summary": lambda p: {"summary": summary.project_summary(p.files, p.nodes, p.lines), "worst": refactoring.long_functions(p.nodes).limit(5), "counts": reports.counts(facts.smells(p.nodes), "kind")},
    "get_architecture_diagram": _diagram, "analyze_file": _analyze_file, "find_smells": _smells, "check_impact": _impact,
    "find_god_functions": lambda p, minLines=50, minComplexity=10, path=None: {"functions": summary.god_functions(facts.function_metrics(p.of_path(path)), minLines, minComplexity), "averages": summary.averages(facts.function_metrics(p.of_path(path))), "files": summary.file_metrics(p.of_path(path, False), p.of_path(path), facts.function_metrics(p.of_path(path)))},
    "trace_calls": lambda p, symbol, direction="forward", depth=5: graph.trace(p.file_chunks, symbol, depth, direction == "backward"), "find_call_paths": lambda p, start, target, max_paths=5, max_depth=10: {"paths": graph.call_paths(p.file_chunks, start, target, max_paths, max_depth), "graph": graph.call_stats(p.file_chunks)},
    "suggest_refactoring": _refactoring, "suggest_fix": _fix, "track_property": _property, "find_calls": lambda p, pattern: facts.calls_to(p.nodes, pattern),
    "list_files": lambda p: p.files.select("path", "line_count").orderBy("path"), "read_source": lambda p, path, start=None, end=None: sources.read_lines(sources.unique_file(p.files, path), start, end).orderBy("line_no"),
    "invalidate_cache": lambda p: p.invalidate(), "rescan_project": lambda p: p.rescan(), "set_project": lambda p, path: p.set_project(path),
    "find_singletons": _singletons, "find_types": _types, "find_tech_debt": lambda p, path=None: summary.debt_report(facts.debt(sources.read_lines(p.of_path(path, False)))), "find_delegates": _delegates, "find_unused_code": _unused, "find_network_calls": _network,
    "find_reactive": _reactive, "find_viewcontrollers": lambda p, path=None: {"controllers": audits.view_controllers(p.of_path(path)), "issues": audits.lifecycle_issues(p.of_path(path))}, "find_localization_issues": _literals,
    "find_accessibility_issues": _accessibility, "find_threading_issues": _threads, "extract_chunks": lambda p, path=None, kind=None: chunking.chunk_report(p.chunks if path is None else chunking.all_chunks(p.of_path(path, False), p.of_path(path)), kind),
    "build_search_index": _build_index, "semantic_search": lambda p, query, top_k=10: vectors.search_text(_snapshot(p), query, p.provider, top_k), "similar_to": _similar,
    "hybrid_search": lambda p, query=None, pattern=None, top_k=10, require_pattern=True: vectors.search_hybrid(_snapshot(p), p.files, p.provider, query, pattern, top_k, require_pattern), "analyze_swiftui": _swiftui, "analyze_uikit": _uikit,
    "analyze_tests": _tests, "analyze_dependencies": _dependencies, "analyze_coredata": _core_data, "analyze_docs": _docs, "find_retain_cycles": _retain,
    "get_refactor_detail": lambda p, path, start, end: refactoring.detail(sources.unique_file(p.files, path), start, end), "analyze_api_surface": _api, "generate_migration_checklist": _checklist, "analyze_auth_migration": _auth,
    "dgx_health": _server, "dgx_stats": _server, "indexing_status": lambda p: vectors.status(p.spark, p.folder(), p.indexing), "build_and_check": _build_log, "run_tests": _test_log,
}
#: Tools whose results change though the scan stays.
CHANGING = {"invalidate_cache", "rescan_project", "set_project", "build_search_index", "indexing_status", "semantic_search", "similar_to", "hybrid_search"}


def _targets(p: Project) -> Result:
    b = p.built
    if b is None:
        raise ValueError("no project file")
    return {"targets": b, "files": xcode.targets_of_files(b), "orphans": xcode.orphans(p.files, b)}


def _detail(p: Project, place: str) -> Result:
    path, _, lines = place.rpartition(":")
    first, _, last = lines.partition("-")
    return p.call("get_refactor_detail", path=path, start=int(first), end=int(last))


def _summary(p: Project, baseline: str | None = None) -> Result:
    s = summary.project_summary(p.files, p.nodes, p.lines)
    if baseline is None:
        return s
    d = summary.compared(s, sources.baseline(p.spark, baseline, "n_files long, n_smells long, n_god long, avg_complexity double"))
    return {"delta": d, "text": summary.comparison_text(d)}


def _all(p: Project) -> Result:
    names = ["find_singletons", "find_types", "find_tech_debt", "find_god_functions", "find_delegates", "find_unused_code", "find_network_calls", "find_reactive", "find_viewcontrollers", "find_smells", "find_localization_issues", "find_accessibility_issues", "find_threading_issues", "analyze_swiftui", "analyze_uikit", "analyze_tests", "analyze_coredata", "analyze_docs", "find_retain_cycles", "suggest_refactoring", "analyze_api_surface", "analyze_auth_migration"]
    return {f"{n}.{k}": v for n in names for k, v in p.call(n).items()}


#: The modes of the command line: a tool with the names of its values, or a function.
MODES: dict[str, tuple] = {
    "--singletons": ("find_singletons", ()), "--targets-only": (_targets, ()), "--auth-migration": ("analyze_auth_migration", ()), "--types": ("find_types", ()), "--tech-debt": ("find_tech_debt", ()), "--functions": ("find_god_functions", ()),
    "--delegates": ("find_delegates", ()), "--unused": ("find_unused_code", ()), "--network": ("find_network_calls", ()), "--reactive": ("find_reactive", ()), "--viewcontrollers": ("find_viewcontrollers", ()), "--smells": ("find_smells", ()),
    "--localization": ("find_localization_issues", ()), "--accessibility": ("find_accessibility_issues", ()), "--threading": ("find_threading_issues", ()), "--swiftui": ("analyze_swiftui", ()), "--uikit": ("analyze_uikit", ()), "--tests": ("analyze_tests", ()),
    "--deps": ("analyze_dependencies", ()), "--coredata": ("analyze_coredata", ()), "--docs": ("analyze_docs", ()), "--retain-cycles": ("find_retain_cycles", ()), "--refactor": ("suggest_refactoring", ()), "--refactor-detail": (_detail, ()),
    "--api": ("analyze_api_surface", ()), "--graph": ("get_architecture_diagram", ("type",)), "--summary": (_summary, ()), "--property": ("track_property", ("pattern", "filterProperty")), "--calls": ("find_calls", ("pattern",)),
    "--impact": ("check_impact", ("symbol",)), "--checklist": ("generate_migration_checklist", ()), "--all": (_all, ()), "--health": ("analyze_file", ("path",)), "--compare": (_summary, ()),
}


def main(arguments: list[str]) -> int:
    """`python -m quarry PATH --mode [value ...]`, or `--serve` with requests on the standard input."""
    import sys

    from quarry.session import session

    if len(arguments) < 2 or (arguments[1] not in MODES and arguments[1] != "--serve"):
        print("usage: python -m quarry PATH MODE [VALUE ...]\nmodes: --serve " + " ".join(MODES), file=sys.stderr)
        return 2
    project = Project(session(), arguments[0])
    if arguments[1] == "--serve":
        for answer in serve(project, sys.stdin):
            print(answer, flush=True)
    else:
        print(json.dumps(document(project.mode(arguments[1], *arguments[2:])), indent=2, sort_keys=True, ensure_ascii=False))
    return 0
