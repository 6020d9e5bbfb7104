"""Project files, lifecycle and test audits on small inputs."""

import pytest

from quarry.operators import audits
from quarry.sources import files, xcode

A, B, C, D, P, Q, X, Y = (c * 24 for c in "ABCDEF01")
PROJECT = f"""
/* Begin PBXBuildFile section */
\t{A} /* Main.swift in Sources */ = {{isa = PBXBuildFile; fileRef = {B} /* Main.swift */; }};
/* End PBXBuildFile section */
/* Begin PBXFileReference section */
\t{B} /* Main.swift */ = {{isa = PBXFileReference; name = Main.swift; path = "App/Main.swift"; sourceTree = "<group>"; }};
/* End PBXFileReference section */
/* Begin PBXNativeTarget section */
\t{X} /* App */ = {{
\t\tisa = PBXNativeTarget;
\t\tbuildPhases = (
\t\t\t{P} /* Sources */,
\t\t);
\t}};
\t{Y} /* AppTests */ = {{
\t\tisa = PBXNativeTarget;
\t\tbuildPhases = (
\t\t\t{Q} /* Sources */,
\t\t);
\t}};
/* End PBXNativeTarget section */
/* Begin PBXSourcesBuildPhase section */
\t{P} /* Sources */ = {{ isa = PBXSourcesBuildPhase; files = (
\t\t{A} /* Main.swift in Sources */,
\t\t{C} /* Lost.swift in Sources */,
\t); }};
\t{Q} /* Sources */ = {{ isa = PBXSourcesBuildPhase; files = (
\t\t{A} /* Main.swift in Sources */,
\t); }};
/* End PBXSourcesBuildPhase section */
"""
CONTROLLER = """class HomeViewController: BaseViewController {
    var a = 1
    override func viewDidLoad() {
        super.viewDidLoad()
        let t = URLSession.shared
    }
    override func viewWillAppear(_ animated: Bool) { }
    func loadView() { }
    func other() { }
}
class Plain { func viewDidLoad() { } }
"""
TESTS = """import XCTest
class MainTests: XCTestCase {
    func testOne() { XCTAssertEqual(1, 1) }
    func testTwo() async { let m = MockClient(); URLSession.shared.go() }
    func helper() { XCTFail() }
}
"""


def test_targets(spark):
    projects = spark.createDataFrame([("p", PROJECT), ("empty", ""), ("null", None), ("p2", "/* Begin PBXNativeTarget section */")], "path string, text string")
    built = xcode.target_files(projects)
    assert {tuple(r) for r in built.collect()} == {("p", "App", "App/Main.swift", "Main.swift"), ("p", "App", "Lost.swift", "Lost.swift"), ("p", "AppTests", "App/Main.swift", "Main.swift")}
    assert {r.file: r.targets for r in xcode.targets_of_files(built).collect()} == {"App/Main.swift": ["App", "AppTests"], "Lost.swift": ["App"]}
    found = files.described(spark.createDataFrame([("App/Main.swift", ""), ("App/Other.swift", "")], "path string, text string"))
    assert [r.path for r in xcode.orphans(found, built).collect()] == ["App/Other.swift"]


def test_lifecycle(spark):
    n = files.nodes(spark.createDataFrame([("h.swift", CONTROLLER), ("none.swift", None)], "path string, text string"))
    assert [tuple(r) for r in audits.view_controllers(n).drop("line").collect()] == [("h.swift", "HomeViewController", "BaseViewController", 9, 2, 4, ["viewDidLoad", "viewWillAppear"])]
    assert {(r.method, r.issue) for r in audits.lifecycle_issues(n).collect()} == {("viewDidLoad", "network"), ("viewWillAppear", "missing_super")}
    long = "class V: UIViewController {\n    func viewDidLoad() {\n" + "        a()\n" * 31 + "        super.viewDidLoad()\n    }\n}\n"
    n = files.nodes(spark.createDataFrame([("l.swift", long)], "path string, text string"))
    assert [(r.method, r.issue) for r in audits.lifecycle_issues(n).collect()] == [("viewDidLoad", "heavy")]


@pytest.mark.parametrize("with_targets", [False, True])
def test_tests(spark, with_targets):
    f = files.described(spark.createDataFrame([("a/Main.swift", "class Main {}"), ("a/UserService.swift", "class UserService {}"), ("t/MainTests.swift", TESTS), ("Tests/Util.swift", ""), ("t/TestHelper.swift", None)], "path string, text string"))
    built = spark.createDataFrame([("AppTests", "MainTests.swift")], "target string, file_name string") if with_targets else None
    t = audits.tested_files(f, files.nodes(f), built)
    rows = {r.path: r for r in t.collect()}
    assert {p for p, r in rows.items() if r.is_test} == {"t/MainTests.swift", "Tests/Util.swift"}
    r = rows["t/MainTests.swift"]
    assert (r.production_file, r.is_active, r.test_names, r.test_types) == ("Main.swift", with_targets, ["testOne", "testTwo"], ["integration", "unit"])
    assert (r.n_assertions, r.n_mocking, r.n_async_tests, r.n_xctest, r.n_tests) == (2, 1, 1, 1, 2)
    c = audits.test_coverage(t).first()
    assert (c.n_production, c.n_with_tests, c.n_test_files, c.n_active, c.n_tests) == (3, 1, 2, int(with_targets), 2)
    assert c.critical_untested == ["UserService.swift"] and c.coverage == pytest.approx(100 / 3)
    assert {r.file_name for r in audits.untested(t).collect()} == {"UserService.swift", "TestHelper.swift"}
