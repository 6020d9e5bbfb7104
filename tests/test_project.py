"""Chunks, call graphs, diagrams, index, jobs and calls of a small project."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import api
from quarry import index as vectors
from quarry.operators import chunking, facts, graph, search
from quarry.sources import files
from quarry.streaming import jobs

A = """import Alpha
import Shared
/// Does it.
public class ServiceA: Base, Codable {
    // TODO: later
    static let shared = ServiceA()
    public func start() { doWork() }
    func doWork() { helper(); Account.sharedInstance().x() }
    init(store: Store) { self.store = store }
}
"""
B = """import Shared
struct Other: Codable {
    @State var a = 1
    func helper() throws { URLSession.shared.dataTask(); item.delegate = self }
}
extension ServiceA { public func more() { } }
protocol P { }
func free(completion: Int) async { await start() }
"""


@pytest.fixture(scope="module")
def project(spark):
    return files.described(spark.createDataFrame([("App/Network/A.swift", A), ("App/View/B.swift", B), ("Empty.swift", "")], "path string, text string")).cache()


@pytest.fixture(scope="module")
def nodes(project):
    return files.nodes(project).cache()


@pytest.fixture(scope="module")
def chunks(project, nodes):
    return chunking.all_chunks(project, nodes).cache()


def test_chunks(chunks):
    rows = {r.id if r.kind in chunking.VIRTUAL else (r.kind, r.name): r for r in chunks.collect()}
    assert chunks.columns == list(chunking.COLUMNS)
    a = rows["class", "ServiceA"]
    assert (a.visibility, a.layer, a.module_path, a.is_singleton, a.has_todo, a.conforms_to, a.imports) == ("public", "network", "App/Network", True, True, ["Base", "Codable"], ["Alpha", "Shared"])
    assert rows["method", "start"].calls == ["doWork"] and rows["method", "start"].parent_type == "ServiceA" and rows["method", "doWork"].called_by == ["ServiceA.start"]
    assert rows["method", "doWork"].patterns == ["uses-singleton"] and set(rows["method", "helper"].patterns) == {"throws", "delegate", "network-call"} and rows["function", "free"].patterns == ["async-await", "callback"]
    assert rows["struct", "Other"].property_wrappers == ["@State"] and rows["initializer", "init"].complexity == 1 and ("function", "more") in rows
    s = rows["summary:App/Network/A.swift"]
    assert s.purpose == "1 types: ServiceA, 2 methods, 1 public, conforms to Base, Codable" and s.line_count == 11
    assert rows["cluster:protocol:Codable"].purpose.startswith("2 files conform to Codable: A.swift, B.swift") and not any("dir:" in str(k) for k in rows)
    assert rows["typeSummary:ServiceA"].purpose == "2 files: A.swift, B.swift. 3 methods (1 public). Conforms to: Base, Codable. Key: start" and "typeSummary:P" not in rows
    assert rows["hotspot:App/Network/A.swift"].purpose.endswith("1 singletons, 1 TODOs")


def test_chunk_texts_and_report(chunks):
    text = {r.id: r.t for r in chunks.select("id", facts.embedding_text(chunks).alias("t")).collect()}
    t = next(v for k, v in text.items() if v.startswith("ServiceA.doWork in App/Network"))
    assert "\nSignature: func doWork()" in t and "\nCalled by: ServiceA.start" in t and "\nLayer: network" in t and t.endswith("Complexity: 1, Lines: 1") or "Lines: 2" in t
    r = chunking.chunk_report(chunks, "method")
    assert {x.kind: x.n for x in r["by_kind"].collect()} == {"method": 3} and r["samples"].count() == 3


def graph_of(spark, rows):
    return spark.createDataFrame([(n, p, c, f"f:{i}", "f", i) for i, (n, p, c) in enumerate(rows)], "name string, parent_type string, calls array<string>, id string, file string, line int")


BASIC = [("start", "ServiceA", ["doWork"]), ("doWork", "ServiceA", ["helper"]), ("helper", None, [])]


def test_traces(spark):
    g = graph_of(spark, BASIC)
    assert graph.resolve(graph.symbols(g), "start") == graph.resolve(graph.symbols(g), "start()") == "ServiceA.start" and graph.resolve(graph.symbols(g), "none") == "none"
    assert {(r.node, r.depth) for r in graph.trace(g, "start").collect()} == {("ServiceA.start", 0), ("doWork", 1)} and graph.trace(g, "start").filter("node = 'doWork'").first().id == "f:1"
    assert {r.node for r in graph.trace(g, "helper", backward=True).collect()} == {"helper", "ServiceA.doWork"}
    assert [r.path for r in graph.call_paths(g, "start", "doWork").collect()] == ["ServiceA.start>doWork"]
    chain = graph_of(spark, [(f"level{i}", None, [f"level{i + 1}"]) for i in range(4)] + [("level4", None, [])])
    assert max(r.depth for r in graph.trace(chain, "level0", 2).collect()) == 2 and graph.call_paths(chain, "level0", "level4").first().length == 4
    many = graph_of(spark, [("start", None, ["a", "b", "c"]), *[(x, None, ["end"]) for x in "abc"], ("end", None, [])])
    assert graph.call_paths(many, "start", "end", max_paths=2).count() == 2
    assert graph.call_paths(graph_of(spark, [("one", None, []), ("two", None, [])]), "one", "two").count() == 0
    cycle = graph_of(spark, [("call", "A", ["B.call"]), ("call", "B", ["C.call"]), ("call", "C", ["A.call"])])
    assert {r.node for r in graph.trace(cycle, "A.call", 9).collect()} == {"A.call", "B.call", "C.call"}
    assert graph.trace(graph_of(spark, BASIC).limit(0), "x").count() == 1 and tuple(graph.call_stats(g).first()) == (3, 2, 2)


def test_deep_chains_are_whole(spark):
    parents = spark.createDataFrame([(i, i + 1) for i in range(80)] + [(200, 201), (201, 200)], "child long, parent long")
    got = graph.ancestors(parents)
    assert got.filter("child = 0").agg(F.max("depth")).first()[0] == 80 and got.filter("child = 200").count() == 1


def test_diagrams(spark, nodes):
    types = facts.type_definitions(nodes)
    for kind, part in (("inheritance", "ServiceA[ServiceA] -->|extends| Base[Base]"), ("protocols", "Other[Other] -.->|conforms| Codable[Codable]"), ("full", "-->|extends|")):
        r = graph.diagram(types, kind).first()
        assert part in r.text and r.text.startswith("graph TD") and r.url.startswith("https://mermaid.live/edit#base64:") and r.n_nodes >= 2
    assert graph.diagram(types, "dependencies").first().n_edges == 0 and graph.diagram(types, "inheritance", 0).first().text == "graph TD"
    used = spark.createDataFrame([("X.sharedInstance()", 5), ("Y", 2)], "symbol string, n long")
    assert graph.diagram(types, "singletons", 1, used).first().text == 'graph LR\n    X_sharedInstance()(("X.sharedInstance()\\n(5 refs)"))'
    g = graph.file_graph(files.described(nodes.select("path", F.lit("").alias("text")).distinct()), facts.imports(nodes))
    assert [(r.out_degree, r.is_orphan) for r in g.collect()] == [(2, False), (1, False)] and graph.graph_metrics(g).first().n_edges == 3


def test_index_life(spark, project, nodes, chunks, tmp_path):
    p, folder = vectors.HashingProvider(512), vectors.location(str(tmp_path), "/some/project")
    assert vectors.status(spark, folder)["state"] == "not started"
    n = chunks.select("id").distinct().count()
    assert vectors.build(chunks, project, folder, p, checkpoint=5, stop_after=1) == 1 and vectors.status(spark, folder)["state"] == "checkpoint"
    start = vectors.load(spark, folder, project, p)[0].index
    assert 0 < start.count() < n
    version = vectors.build(chunks, project, folder, p, start, checkpoint=100)
    s = vectors.read(spark, folder, p)
    assert s.version == version == 2 and s.count() == n == s.ids().distinct().count() and s.meta["is_complete"] and vectors.status(spark, folder)["percent"] == 100
    assert vectors.search_text(s, "helper URLSession dataTask", p, 3).first().name in ("helper", "Other", "B.swift")
    one = s.index.orderBy("chunk_id").first()
    assert s.vector(one.chunk_id) == list(one.embedding) and s.vector("none") is None and s.chunk(one.chunk_id).count() >= 1
    h = vectors.search_hybrid(s, project, p, None, "doWork", 5).collect()
    assert h and all(r.score == 0.5 and r.n_matches >= 1 for r in h) and vectors.search_hybrid(s, project, p, None, "doWork", 500, False).agg(F.max("score")).first()[0] == 0.7
    assert vectors.reindex(project, nodes, folder, p) is None
    changed = files.described(spark.createDataFrame([("App/Network/A.swift", A), ("App/View/B.swift", B.replace("helper", "rescue")), ("New.swift", "func brand() { }")], "path string, text string"))
    assert vectors.reindex(changed, files.nodes(changed), folder, p) == 3
    names = {r.name for r in vectors.read(spark, folder, p).chunks.collect()}
    assert {"rescue", "brand"} <= names and "helper" not in names and vectors.reloaded(spark, folder, 2, False, p).version == 3 and vectors.reloaded(spark, folder, 3, False) is None
    new = vectors.read(spark, folder, p)
    assert new.count() == new.chunks.select("id").distinct().count() and vectors.missing(new.chunks, new.index).count() == 0
    assert vectors.without_virtual(new.index).count() < new.count() and vectors.cleared(new.index).count() == 0 and vectors.without_files(new.index, spark.createDataFrame([("New.swift",)], "path string")).filter("file = 'New.swift'").count() == 0
    with pytest.raises(vectors.Mismatch):
        vectors.read(spark, folder, vectors.HashingProvider(32))


def test_remote_provider():
    calls, waits = [], []

    def post(url, body, timeout):
        calls.append(body)
        if len(calls) < 3:
            raise vectors.Busy("later")
        return {"embeddings": [[1.0, 0.0]] * len(body["inputs"])}

    p = vectors.RemoteProvider("http://x", 2, post=post, wait=waits.append)
    assert p.embed(["a"] * 70, True).shape == (70, 2) and waits == [1, 2] and [len(c["inputs"]) for c in calls] == [64, 64, 64, 6] and calls[0]["is_query"]
    with pytest.raises(vectors.Busy):
        vectors.RemoteProvider("http://x", 2, post=lambda *a: (_ for _ in ()).throw(vectors.Busy("no")), wait=waits.append).embed(["a"])
    with pytest.raises(ValueError):
        vectors.RemoteProvider("http://x", 3, post=lambda u, b, t: {"embeddings": [[1.0]]}).embed(["a"])


def test_search_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [-1.0, 0.0]), (100, [0.0, 2.0])]
    index = spark.createDataFrame(rows, "id long, v array<float>")
    for block in (1, 10):
        got = {}
        for r in search.knn_many(index, index.filter("id % 100 = 0"), "id", "v", 3, block=block).orderBy("query", F.desc("score"), "id").collect():
            got.setdefault(r.query, []).append((r.id, r.score))
        assert got == {0: [(0, 1.0), (1, 1.0), (2, 0.0)], 100: [(100, 1.0), (0, 0.0), (1, 0.0)]}
    assert search.knn_many(index, index.limit(0), "id", "v", 3).count() == 0
    text = spark.createDataFrame([("a foo\n" + "x" * 130 + " foo\nfoo foo",), ("none",)], "t string")
    assert [r.c for r in text.select(search.match_context(F.col("t"), "fo+").alias("c")).collect()] == ["a foo | foo | foo foo (+1 more)", None]


JOB_LOG = [("register", "a", 10), ("register", "b", 20), ("register", "c", 5), ("progress", "a", 4), ("progress", "b", 4), ("cancel", "c", None), ("complete", "a", None), ("register", "d", 7), ("fail", "b", None), ("complete", "zz", None)]


def job_rows(log, worker="w"):
    return [(worker, i, float(i), op, job, "p", n if op == "register" else None, n if op == "progress" else None, "boom" if op == "fail" else None) for i, (op, job, n) in enumerate(log)]


def test_jobs(spark, tmp_path):
    more = job_rows([("register", f"j{i}", 1) for i in range(13)] + [("complete", f"j{i}", None) for i in range(12)], "v")
    events = spark.createDataFrame(job_rows(JOB_LOG[:6], "u") + job_rows(JOB_LOG) + more, jobs.EVENTS)
    got = {}
    for r in jobs.replay(events).orderBy("worker", "place").collect():
        got.setdefault(r.worker, []).append((r.job_id, r.status, r.current, r.position, r.chunks_ahead))
    assert got["u"] == [("a", "active", 4, 0, 0), ("b", "queued", 0, 1, 6)]
    assert got["w"] == [("d", "active", 0, 0, 0), ("b", "failed", 0, -1, 0), ("a", "completed", 10, -1, 0)]
    assert [x[0] for x in got["v"]] == ["j12"] + [f"j{i}" for i in range(11, 1, -1)]
    folder = tmp_path / "events"
    for i in range(0, 10, 4):  # a stream in several files gives the same end
        spark.createDataFrame(job_rows(JOB_LOG)[i : i + 4], jobs.EVENTS).coalesce(1).write.mode("append").json(str(folder))
        time.sleep(0.02)
    last: dict = {}

    def keep(batch, number):
        for r in batch.collect():
            last[number] = {**last.get(number, {}), r.job_id: (r.status, r.current, r.position)}

    q = jobs.stream_jobs(spark.readStream.schema(jobs.EVENTS).json(str(folder))).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert last[max(last)] == {"d": ("active", 0, 0), "b": ("failed", 0, -1), "a": ("completed", 10, -1)}
    p = jobs.progress(jobs.replay(events).filter("worker = 'u'"), 10.0).filter("job_id = 'a'").first()
    assert (p.elapsed, p.percent, p.rate, p.eta) == (10.0, 40, 0.4, 15.0)
    assert jobs.Queue({"jobs": {}, "queue": [], "active": [], "recent": [], "chunks": 10, "seconds": 5.0}).wait(4) == 2.0


def test_change_stream(spark, tmp_path):
    folder, seen = tmp_path / "changes", []
    folder.mkdir()
    rows = [("A.swift", "created", 1), ("A.swift", "modified", 2), ("Pods/B.swift", "created", 1), (".C.swift", "created", 1), ("d.txt", "created", 1), ("x/.build/E.swift", "modified", 3), ("F.swift", "deleted", 4)]
    (folder / "1.json").write_text("\n".join(json.dumps(dict(zip(("path", "kind", "at"), r))) for r in rows))
    jobs.watch(jobs.change_stream(spark, str(folder)), lambda found, n: seen.append(sorted(map(tuple, found.collect()))), str(tmp_path / "state")).awaitTermination()
    assert seen == [[("A.swift", "modified"), ("F.swift", "deleted")]]


def test_calls(spark, tmp_path):
    root = tmp_path / "src" / "App"
    root.mkdir(parents=True)
    (root / "A.swift").write_text(A)
    (root / "B.swift").write_text(B)
    p = api.Project(spark, str(tmp_path / "src"))
    assert len(api.TOOLS) == 50 and len(api.MODES) >= 32 and {"--all", "--graph"} <= set(api.MODES)
    first = p.call("find_smells")
    assert p.call("find_smells") is first and p.stats()["parsed"] == 2
    (root / "C.swift").write_text("let x = y!\n")
    assert p.call("rescan_project") == {"n_new": 1, "n_updated": 0, "n_unchanged": 2, "n_deleted": 0} and p.call("find_smells") is not first
    assert p.call("find_smells")["smells"].filter("path like '%C.swift'").count() == 1
    assert [r.line for r in p.call("read_source", path="C.swift", start=0, end=1).collect()] == ["let x = y!"] and p.mode("--calls", "*.dataTask").count() == 1
    assert p.mode("--health", "A.swift")["health"].first().score > 80 and p.mode("--summary").first().n_files == 3
    answers = list(map(json.loads, api.serve(p, ['{"id": 1, "method": "tools/list"}', '{"id": 2, "method": "tools/call", "params": {"name": "list_files"}}', '{"id": 3, "method": "tools/call", "params": {"name": "nope"}}', "no json"])))
    assert len(answers[0]["result"]["tools"]) == 50 and len(answers[1]["result"]) == 3 and "unknown tool" in answers[2]["error"] and "error" in answers[3]
    with pytest.raises(FileNotFoundError):
        p.call("set_project", path=str(tmp_path / "none"))
    with pytest.raises(ValueError):
        p.call("read_source", path="swift")


def test_readers(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "Podfile").write_text("")
    assert files.dependency_root(str(tmp_path / "a" / "b")) == str(tmp_path) and files.dependency_root("/proc/1", 0) is None
    log = spark.createDataFrame([("l", "Test Case 'A.b' passed (0.1 seconds)\n✘ c failed (1 s)\nd skipped\n3 tests failed\nnoise")], "path string, text string")
    r = files.test_log(log)
    assert [(x.test, x.status) for x in r.orderBy("line_no").collect()] == [("'A.b'", "passed"), ("c", "failed"), ("d skipped", "skipped")] and files.test_summary(r).first().n == 3
    f = files.described(spark.createDataFrame([("x/A.swift", "1\n2\n3"), ("y/A.swift", "")], "path string, text string"))
    assert files.file_at(f, "x/A.swift").count() == 1 and files.under(f, "x").count() == 1 and files.matching(f, "A.swift").count() == 2
    with pytest.raises(ValueError):
        files.unique_file(f, "A.swift")
    assert json.loads(files.to_json([{"b": 1, "a": "é"}])) == [{"a": "é", "b": 1}] and files.to_json([{"b": 1, "a": 2}]).startswith('[{"a"')
    assert np.allclose(np.linalg.norm(vectors.HashingProvider(16).embed(["a b", ""]), axis=1), [1, 0])
