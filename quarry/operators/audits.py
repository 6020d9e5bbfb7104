"""Audits over syntax nodes: view-controller lifecycle and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names and limits that the audits look for.
LIFECYCLE = ["viewDidLoad", "viewWillAppear", "viewDidAppear", "viewWillDisappear", "viewDidDisappear", "viewWillLayoutSubviews", "viewDidLayoutSubviews", "loadView", "viewWillTransition", "traitCollectionDidChange", "updateViewConstraints"]
NETWORK_CALLS = ["URLSession", "Alamofire", ".request(", "dataTask"]
HEAVY_LINES = 30
TEST_SUFFIXES = ["Tests", "Test", "Spec", "Specs"]
ASSERTIONS = ["XCTAssert", "XCTFail"]
IMPORTANT = ["Manager", "Service", "Controller", "ViewModel", "Repository"]


def _any(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def _controllers(nodes: DataFrame) -> DataFrame:
    of = F.filter("inherits", lambda x: x.contains("ViewController"))
    rows = nodes.filter((F.col("kind") == "ClassDecl") & (F.size(of) > 0))
    return rows.select("path", "name", F.col("pos_line").alias("line"), F.get(of, F.lit(0)).alias("superclass"), (F.col("end_line") - F.col("pos_line")).alias("line_count"))


def view_controllers(nodes: DataFrame) -> DataFrame:
    """(path, name, line, superclass, line_count, n_properties, n_methods, overrides) of each view controller.

    What stands directly in the class counts, local variables of its methods included; overrides are its
    lifecycle methods in order. Members are counted for each class before the join.
    """
    k = F.col("kind")
    overridden = (k == "FunctionDecl") & F.col("name").isin(LIFECYCLE) & F.array_contains("modifiers", "override")
    members = nodes.filter((F.col("ctx_type_kind") == "ClassDecl") & k.isin("VariableDecl", "FunctionDecl")).groupBy("path", "ctx_type").agg(
        F.count_if(k == "VariableDecl").alias("n_properties"), F.count_if(k == "FunctionDecl").alias("n_methods"),
        F.array_sort(F.collect_list(F.when(overridden, F.struct("node_id", "name")))).alias("_o"),
    ).withColumnRenamed("ctx_type", "name")
    rows = _controllers(nodes).join(members, ["path", "name"], "left").na.fill(0, ["n_properties", "n_methods"])
    names = F.coalesce(F.transform("_o", lambda x: x["name"]), F.array().cast("array<string>"))
    return rows.select("path", "name", "line", "superclass", "line_count", "n_properties", "n_methods", names.alias("overrides"))


def lifecycle_issues(nodes: DataFrame) -> DataFrame:
    """(path, controller, method, line, issue): long lifecycle methods, network calls in them, no call of super."""
    text = F.coalesce("text", F.lit(""))
    heavy = F.when(F.col("end_line") - F.col("pos_line") > HEAVY_LINES, "heavy")
    network = F.when(_any(text, NETWORK_CALLS), "network")
    no_super = F.when(~F.contains(text, F.concat(F.lit("super."), F.col("name"))) & (F.col("name") != "loadView"), "missing_super")
    methods = nodes.filter((F.col("kind") == "FunctionDecl") & (F.col("ctx_type_kind") == "ClassDecl") & F.col("name").isin(LIFECYCLE))
    rows = methods.select("path", F.col("ctx_type").alias("controller"), F.col("name").alias("method"), F.col("pos_line").alias("line"), F.explode(F.array_compact(F.array(heavy, network, no_super))).alias("issue"))
    return rows.join(_controllers(nodes).select("path", F.col("name").alias("controller")).distinct(), ["path", "controller"], "left_semi")


def tested_files(files: DataFrame, nodes: DataFrame, built: DataFrame | None = None) -> DataFrame:
    """A row for each file: is_test, production_file, n_tests, test_names, test_types, is_active and the pattern counters.

    A file is a test by its imports, classes, functions, folder or name. *built* (file_name, target) gives the
    files that some target builds; without it no file is active.
    """
    k, name = F.col("kind"), F.col("name")
    parents = F.coalesce("inherits", F.array().cast("array<string>"))
    case, ui = F.exists(parents, lambda x: x.contains("TestCase")), F.exists(parents, lambda x: x.contains("UITest"))
    test = (k == "FunctionDecl") & name.startswith("test")
    body = F.lower("text")
    type_of = F.when(_any(body, ["xcuiapplication", "launch()"]), "ui").when(_any(body, ["urlsession", "network"]), "integration").otherwise("unit")
    call, callee, module = k == "FunctionCallExpr", F.coalesce("callee", F.lit("")), k == "ImportDecl"
    counted = {
        "n_assertions": call & callee.rlike("^(" + "|".join(ASSERTIONS) + ")"), "n_mocking": call & _any(callee, ["Mock", "Stub", "Fake"]), "n_expectations": call & _any(callee, ["expectation", "fulfill", "wait(for:"]),
        "n_async_tests": test & F.col("is_async"), "n_xctest": module & (name == "XCTest"), "n_swift_testing": module & name.contains("Testing"), "n_quick": module & _any(name, ["Quick", "Nimble"]), "n_tests": test,
    }
    found = nodes.groupBy("path").agg(
        F.bool_or(F.coalesce(test | (module & (name == "XCTest")) | ((k == "ClassDecl") & (case | ui)), F.lit(False))).alias("_test"),
        F.array_sort(F.collect_list(F.when(test, F.struct("node_id", "name")))).alias("_names"),
        F.collect_set(F.when(test, type_of)).alias("_t"), F.collect_set(F.when((k == "ClassDecl") & case, "unit")).alias("_u"), F.collect_set(F.when((k == "ClassDecl") & ui, "ui")).alias("_i"),
        *[F.count_if(c).alias(n) for n, c in counted.items()],
    )
    none = F.array().cast("array<string>")
    d = files.select("path", "file_name").join(found, "path", "left").na.fill(0, list(counted))
    stem = F.regexp_replace("file_name", r"\.swift$", "")
    is_test = F.coalesce("_test", F.lit(False)) | _any(F.col("path"), ["Tests/", "Test/"]) | stem.rlike("(" + "|".join(TEST_SUFFIXES) + ")$")
    bare = F.col("file_name")
    for suffix in TEST_SUFFIXES[:3]:
        bare = F.replace(bare, F.lit(suffix + ".swift"), F.lit(".swift"))
    if built is None:
        d = d.withColumn("is_active", F.lit(False))
    else:
        d = d.join(built.select("file_name").distinct().withColumn("_b", F.lit(True)), "file_name", "left").withColumn("is_active", F.coalesce("_b", F.lit(False)))
    types = F.array_sort(F.array_union(F.array_union(F.coalesce("_t", none), F.coalesce("_u", none)), F.coalesce("_i", none)))
    names = F.coalesce(F.transform("_names", lambda x: x["name"]), none)
    return d.select("path", "file_name", is_test.alias("is_test"), F.when(is_test & (bare != F.col("file_name")), bare).alias("production_file"), "is_active", names.alias("test_names"), types.alias("test_types"), *counted)


def test_coverage(tested: DataFrame) -> DataFrame:
    """One row: files, tests, active and orphaned tests, the covered share of production file names in percent."""
    production = tested.filter("not is_test").select(F.col("file_name").alias("f")).distinct()
    aims = tested.filter("is_test").select(F.col("production_file").alias("f")).filter("f is not null").distinct().withColumn("hit", F.lit(True))
    names = production.join(aims, "f", "left").agg(F.count("*").alias("n_production"), F.count("hit").alias("n_with_tests"), F.array_sort(F.collect_list(F.when(F.col("hit").isNull() & _any(F.col("f"), IMPORTANT), F.col("f")))).alias("critical_untested"))
    tests = tested.filter("is_test").agg(F.count("*").alias("n_test_files"), F.count_if("is_active").alias("n_active"), F.count_if(~F.col("is_active")).alias("n_orphaned"), F.coalesce(F.sum("n_tests"), F.lit(0)).alias("n_tests"))
    # both sides are one row
    return names.crossJoin(tests).withColumn("coverage", F.when(F.col("n_production") > 0, F.col("n_with_tests") * 100.0 / F.col("n_production")).otherwise(F.lit(0.0)))


def untested(tested: DataFrame) -> DataFrame:
    """Names of production files that no test file aims at."""
    aims = tested.filter("is_test").select(F.col("production_file").alias("file_name")).filter("file_name is not null").distinct()
    return tested.filter("not is_test").select("file_name").distinct().join(aims, "file_name", "left_anti")
