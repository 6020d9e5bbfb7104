"""Reports over facts of small inputs."""

from quarry.operators import facts, fixing, reports
from quarry.sources import files

CODE = "protocol P {}\nclass A: P {\n    func f() { x!.y(); Account.sharedInstance().z() }\n}\n"


def test_files_and_smells(spark):
    f = files.described(spark.createDataFrame([("a.swift", CODE), ("b.swift", "struct B: P {}\nlet q = try! A()\n"), ("c.swift", "")], "path string, text string"))
    n = files.nodes(f)
    s, t = facts.smells(n), facts.type_definitions(n)
    assert [(r.path, r.n_god, r.n_smells, r.n_singletons) for r in reports.hotspots(facts.function_metrics(n), s, facts.references(n)).collect()] == [("a.swift", 0, 1, 4)]
    assert [(r.protocol, r.conformers) for r in reports.protocol_clusters(t).collect()] == [("P", ["A", "B"])]
    assert [r.name for r in reports.unused_types(t, n).collect()] == ["B"]
    assert {(r.kind, r.confidence) for r in fixing.suggestions(s, f).collect()} == {("force_unwrap", "low"), ("force_try", "medium")}
    assert [r.kind for r in reports.smell_order(s).collect()] == ["force_unwrap", "force_try"]
    assert {(r.kind, r.severity, r.n) for r in reports.counts(s, "kind", "severity").collect()} == {("force_unwrap", None, 1), ("force_try", None, 1), (None, "critical", 2), (None, None, 2)}


def test_rescan_and_queue(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4"), ("e", "5")], "path string, content_hash string")
    assert tuple(reports.rescan(old, new).first()) == (2, 1, 1, 1)
    jobs = spark.createDataFrame([(1, "w", "completed", 0, 9, 9), (2, "w", "active", 1, 10, 4), (3, "w", "queued", 2, 5, 0), (4, "w", "queued", 3, 7, 0)], "job_id int, worker string, state string, submitted int, total int, done int")
    assert [(r.job_id, r.position, r.chunks_ahead) for r in reports.queue(jobs).orderBy("job_id").collect()] == [(3, 1, 6), (4, 2, 11)]


def test_logs_and_checklist(spark):
    log = spark.createDataFrame([("l", "PASS a\nFAIL b\nexpected 1\ngot 2\n\nnoise\nFAIL c\nPASS d")], "path string, text string")
    assert {(r.test, r.message) for r in reports.failing_tests(files.read_lines(log)).collect()} == {("b", "expected 1\ngot 2"), ("c", "")}
    items = spark.createDataFrame([("one", "b"), ("one", "a"), ("one", "a")], "phase string, title string")
    assert reports.checklist(items, "phase", "title").first().text == "## one\n- [ ] a\n- [ ] b"
