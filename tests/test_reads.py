"""Operators over pruned nodes give the rows that they give over all nodes; the node table agrees with itself whatever is asked for."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions.syntax import COLUMNS, Source
from quarry.operators import chunking, facts, frameworks, refactoring, summary
from quarry.operators.reads import READS, reads
from quarry.plans import catalog
from quarry.sources import files
from tests.test_source import PATHS, SERVICE

EXTRA = """import UIKit
import SwiftUI
@MainActor class Quiet { func load() async { UserDefaults.standard.set(1) } }
class Loud: UIViewController {
    @IBOutlet var field: UITextField!
    var onDone: (() -> Void)?
    var dataSource: DataSource?
    init(a: Int) { self.delegate = a; cell.dataSource = self }
    func load() async {
        URLSession.shared.data("/v1/x"); UserDefaults.standard.x = 1
        stream.subscribe { self.go() }
        let bag = DisposeBag()
        stream.subscribe { self.go() }
        Task { self.go() }
        DispatchQueue.main.sync { performSelector(x) }
        Timer.scheduledTimer(target: self)
    }
    func outer() { func inner() { call(Thing.self) }; other() }
    private func nobody() { Account.sharedInstance().email = 5; user.signOut(); other.email = 7; other.email += 2 }
}
extension Loud: Codable {}
enum Kind: String { case a }
"""
TEXTS = {**PATHS, "service": SERVICE, "extra": EXTRA, "empty": "", "null": None}
OPERATORS = {
    "smells": facts.smells, "function_metrics": facts.function_metrics, "imports": facts.imports, "ui_mix": frameworks.ui_mix, "references": facts.references, "type_definitions": facts.type_definitions, "endpoints": facts.endpoints,
    "delegates": facts.delegates, "wirings": frameworks.wirings, "usages": lambda n: facts.usages(n, "delegate").union(facts.usages(n, "Codable")), "finding_lines": chunking.finding_lines, "retain_cycles": frameworks.retain_cycles,
    "thread_issues": frameworks.thread_issues, "reactive_leaks": frameworks.reactive_leaks, "auth_accesses": frameworks.auth_accesses, "property_accesses": lambda n: frameworks.property_accesses(n, "other.*"),
}


@pytest.fixture(scope="module")
def code(spark):
    return files.described(spark.createDataFrame([*TEXTS.items()], "path string, text string").repartition(3))


def rows(df):
    return Counter(map(str, df.select(*sorted(df.columns)).collect()))


def with_files(name, f, n):
    if name == "chunks":
        return facts.chunks(f, n)
    return getattr(summary, name)(f, n, files.read_lines(f))


@pytest.mark.parametrize("name", sorted(READS))
def test_pruned_nodes(code, name):
    kept, every = files.nodes(code, **reads(name)), files.nodes(code)
    assert len(kept.columns) < len(every.columns)
    run = OPERATORS.get(name) or (lambda n: with_files(name, code, n))
    got = rows(run(kept))
    assert got == rows(run(every)) and got


def test_unknown_column(code):
    with pytest.raises(ValueError):
        files.nodes(code, columns=["colour"])


def test_table_is_nodes():
    for text in (SERVICE, EXTRA):
        every = Source(text).nodes()
        for kinds in ({"FunctionDecl", "FunctionCallExpr"}, {"ImportDecl", "ClassDecl", "FunctionDecl", "VariableDecl"}):
            kept = [r for r in every if r["kind"] in kinds]
            for c in COLUMNS:
                assert Source(text).table([c], kinds) == {c: [r[c] for r in kept]}


def test_calls_of_functions(code):
    n = files.nodes(code.filter("path = 'extra'"))
    found = n.filter("kind in ('FunctionDecl', 'InitializerDecl')").select("name", "calls", "types", "imports").collect()
    # a plain loop over the nodes: what stands in a function belongs to the innermost one
    every = {r.node_id: r for r in n.collect()}
    for f in n.filter("kind in ('FunctionDecl', 'InitializerDecl')").collect():
        inside = [r for r in every.values() if r.func_id == f.node_id]
        assert f.calls == sorted({r.member for r in inside if r.kind == "FunctionCallExpr"}) and f.types == sorted({r.name for r in inside if r.kind == "TypeReference"})
    assert {r.name: r.calls for r in found}["outer"] == ["other"] and all(r.imports == ["SwiftUI", "UIKit"] for r in found)


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_one_parse(code):
    """A source text is parsed once for each of these, however many rules they have."""
    n = files.nodes(code)
    for df in (frameworks.thread_issues(n), frameworks.reactive_leaks(n), frameworks.auth_accesses(n), frameworks.property_accesses(n, "a.*"), chunking.finding_lines(n), facts.chunks(code, n), summary.file_health(code, n, files.read_lines(code)).select("path", "score")):
        assert scans(df) == 1


def test_tags_of_chunks(code):
    c = chunking.file_chunks(code, files.nodes(code)).filter("file = 'extra'")
    got = {(r.name, r.line): r.patterns for r in c.select("name", "line", "patterns").collect()}
    loud = next(v for (n, _), v in got.items() if n == "Loud")
    assert loud == ["delegate", "reactive", "uses-singleton", "network-call"]
    assert next(v for (n, _), v in got.items() if n == "outer") == []
    at = files.nodes(code).filter("path = 'extra'")
    assert c.count() == at.filter(F.col("kind").isin(facts.CHUNK_KINDS)).count() and refactoring.LONG == 50


def test_chunks_join_nothing(spark, tmp_path):
    """Chunks come from the nodes alone: no side of a join goes to the driver, and a file given twice counts twice, as in SQL."""
    p = str(tmp_path / "part.parquet")
    spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 4, 3, 3)], "p_partkey long").write.parquet(p)
    got = catalog.queries()["src_chunks"](spark, str(tmp_path))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{p}/*.parquet'")
    want = con.sql(catalog.oracle_sql()["src_chunks"])
    assert Counter(map(tuple, got.collect())) == Counter(want.project(", ".join(got.columns)).fetchall())
