"""The source front-end on snippets."""

import pytest

from quarry.functions.syntax import Source
from quarry.operators import facts
from quarry.sources import files

PATHS = {
    "unwrap_1": "let value = optional!",
    "unwrap_3": "let a = x!\nlet b = y!\nlet c = z!",
    "cast_bang": "func f() {\n    let view = anyObject as! UIView\n}",
    "cast_safe": "func f() {\n    let view = anyObject as? UIView\n}",
    "try_bang": "let data = try! loadData()",
    "try_safe": "let a = try? load()\ndo { try load() } catch { print(error) }",
    "catch_empty": "do { try something() } catch { }",
    "nest_5": "func f() { if a { if b { if c { if d { if e { g() } } } } } }",
    "else_if_6": "func f() { if a { } else if b { } else if c { } else if d { } else if e { } else if g { } }",
    "params_6": "func f(a: Int, b: Int, c: Int, d: Int, e: Int, g: Int) {}",
    "params_3": "func f(a: Int, b: Int, c: Int) {}",
    "outlet": "class A {\n    @IBOutlet weak var label: UILabel!\n    var other: UILabel!\n}",
    "not_equal": "if a != b { c = !d }",
    "debug": "func f() {\n#if DEBUG\n    print(1)\n#endif\n    dump(2)\n}",
    "accessor": "class A { var x: Int { get { y! } set { z = newValue } } }",
    "string": 'let s = "wow! \\(a + "x!") TODO"  // y!',
}
COUNTS = {
    "unwrap_1": {"force_unwrap": 1}, "unwrap_3": {"force_unwrap": 3}, "cast_bang": {"force_cast": 1}, "cast_safe": {}, "try_bang": {"force_try": 1}, "try_safe": {"print_statement": 1}, "catch_empty": {"empty_catch": 1},
    "nest_5": {"deep_nesting": 1}, "else_if_6": {}, "params_6": {"long_parameter_list": 1}, "params_3": {}, "outlet": {"implicitly_unwrapped": 1}, "not_equal": {}, "string": {}, "debug": {"print_statement": 1}, "accessor": {"force_unwrap": 1},
}

SERVICE = """import Foundation
import UIKit.UIView

/// Loads users.
public class UserService: BaseService, Codable, LoadDelegate {
    @Published var names: [String] = []
    weak var delegate: LoadDelegate?
    var count: Int { 7 }

    init(store: Store) { self.store = store }

    // TODO: page the result */
    func fetchUser(id: Int, completion: (Int) -> Void) async throws -> User? {
        guard id > 0 else { return nil }
        let r = try await client.get("/api/user").parse()
        switch r { case .a: break
        case .b: parseResponse(r) }
        items.forEach { [weak self] x in self?.use(x) }
        Account.sharedInstance().touch()
        return NetworkManager.make(r)
    }
}
"""


@pytest.fixture(scope="module")
def snippet_nodes(spark):
    return files.nodes(spark.createDataFrame([*PATHS.items(), ("empty", ""), ("null", None)], "path string, text string"))


def test_smells(snippet_nodes):
    got = {k: {} for k in PATHS}
    for r in facts.smells(snippet_nodes).filter("kind <> 'magic_number'").groupBy("path", "kind").count().collect():
        got[r["path"]][r["kind"]] = r["count"]
    assert got == COUNTS


@pytest.fixture(scope="module")
def service(spark):
    return files.described(spark.createDataFrame([("App/Network/UserService.swift", SERVICE)], "path string, text string"))


def test_facts(service):
    n = files.nodes(service)
    assert {r.module for r in facts.imports(n).collect()} == {"Foundation", "UIKit"}
    t = facts.type_definitions(n).collect()
    assert [(r.name, r.kind, r.visibility, r.superclass, r.conformances) for r in t] == [("UserService", "class", "public", "BaseService", ["BaseService", "Codable", "LoadDelegate"])]
    f = facts.function_metrics(n).collect()
    assert [(r.name, r.complexity, r.n_params, r.is_async, r.throws) for r in f] == [("fetchUser", 4, 2, True, True)]
    assert [(r.name, r.is_weak) for r in facts.delegates(n).collect()] == [("delegate", True)]
    assert [r.endpoint for r in facts.endpoints(n).collect()] == ["/api/user"]
    assert {r.kind for r in facts.references(n).collect()} == {"globalSingleton"}
    assert [(r.uses_self, r.is_weak) for r in facts.captures(n).collect()] == [(True, True)]
    d = facts.debt(files.read_lines(service)).collect()
    assert [(r.kind, r.message, r.context) for r in d] == [("TODO", "page the result", None)]
    assert facts.counters(n).first().published == 1
    assert [r.line for r in facts.calls_to(n, "*.get").collect()] == [15]


def test_chunks(service):
    c = facts.called_by(facts.chunks(service, files.nodes(service)))
    rows = {r.name: r for r in c.collect()}
    assert set(rows) == {"UserService", "init", "fetchUser"}
    m = rows["fetchUser"]
    assert (m.kind, m.parent_type, m.layer, m.module_path, m.return_type, m.parameters) == ("method", "UserService", "network", "App/Network", "User?", ["id", "completion"])
    assert {"get", "parse", "parseResponse"} <= set(m.calls) and "NetworkManager" in m.uses_types
    assert {"async-await", "throws", "callback"} <= set(m.patterns)
    assert rows["UserService"].property_wrappers == ["@Published"] and rows["init"].kind == "initializer"
    text = c.filter("name = 'fetchUser'").select(facts.embedding_text(c).alias("t")).first().t
    assert "UserService.fetchUser" in text and "Signature: " in text and "Layer: network" in text


def test_intervals_nest():
    rows = Source(SERVICE).nodes()
    for r in rows:
        if r["parent_id"] is not None:
            p = rows[r["parent_id"]]
            assert p["node_id"] < r["node_id"] <= r["end_id"] <= p["end_id"]


@pytest.mark.parametrize("text", ["", "{", "}", ")(", '"open', "/* open", "func", "func (", "class", "a.", "!", "if", "switch x {", "let", '#"', '"\\(', "import", "é中."])
def test_broken_text(text):
    Source(text).nodes()


def test_readers(spark, tmp_path):
    for p, s in {"A/x.swift": "let a = 1\nlet b = 2", "Pods/y.swift": "", "ATests/z.swift": ""}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(s)
    root = str(tmp_path / "A")
    assert [r.path for r in files.source_files(spark, root).collect()] == ["x.swift"]
    f = spark.createDataFrame([("Podfile", "target 'App' do\n  pod 'Moya', '~> 15.0'\n  # pod 'No'\nend"), ("P", '.package(url: "https://h/x/Kit.git", from: "1.0.0")'), ("C", '# c\ngithub "a/b" ~> 1.0'), ("L", "/a/b.swift:3:5: error: bad thing\nok")], "path string, text string")
    assert [(r.target, r.name, r.version) for r in files.podfile(f).collect()] == [("App", "Moya", "~> 15.0")]
    assert [(r.name, r.url) for r in files.package_manifest(f).collect()] == [("Kit", "https://h/x/Kit.git")]
    assert [(r.origin, r.name, r.version) for r in files.cartfile(f.filter("path = 'C'")).collect()] == [("github", "b", "~> 1.0")]
    assert [(r.line, r.severity, r.message) for r in files.build_log(f).collect()] == [(3, "error", "bad thing")]
