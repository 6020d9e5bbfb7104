"""Long functions: their sections and blocks, what could be taken out of them, and the signature of a part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import text as T

#: Words that count for the complexity of a text, marks of sections, limits in lines.
BRANCH_WORDS = ["if ", "else ", "for ", "while ", "switch ", "case ", "guard ", "catch ", "&&", "||", "?:"]
MARKS = ["// MARK:", "// ---", "// ==="]
LONG, LONG_BLOCK, LONG_MODE, LONG_SECTION, CLOSE = 50, 10, 15, 20, 5
#: What a block depends on, by words in it.
PROBES = [(["typeMap", "analyzeTypes"], "typeMap from DependencyGraphAnalyzer.analyzeTypes()"), (["targetFiles", "targetAnalysis"], "targetFiles from targetAnalysis"), (["parentURL", "deletingLastPathComponent"], "parentURL (analyzes parent directory)"), (["for (index, fileURL)", "for fileURL in"], "iterates over files directly")]
#: Analysers with the properties of their reports.
ANALYZERS = {
    "CodeSmellAnalyzer": "totalSmells,smellsByType,hotspotFiles", "NetworkAnalyzer": "endpoints,totalEndpoints,networkPatterns", "ReactiveAnalyzer": "totalSubscriptions,potentialLeaks,framework", "ViewControllerAnalyzer": "viewControllers,issues,heavyLifecycleMethods",
    "LocalizationAnalyzer": "hardcodedStrings,localizedStrings,localizationCoverage", "AccessibilityAnalyzer": "totalUIElements,accessibilityCoverage,issues", "ThreadSafetyAnalyzer": "totalIssues,concurrencyPatterns", "SwiftUIAnalyzer": "views,stateManagement,swiftUIFileCount",
    "UIKitAnalyzer": "viewControllers,patterns,modernizationScore", "CoreDataAnalyzer": "entities,patterns,hasCoreData", "DocumentationAnalyzer": "totalPublicSymbols,documentedSymbols,coveragePercentage", "RetainCycleAnalyzer": "potentialCycles,delegateIssues,riskScore",
    "RefactoringAnalyzer": "godFunctions,extractionOpportunities", "APIAnalyzer": "types,globalFunctions,totalPublicAPIs", "TechDebtAnalyzer": "totalMarkers,markersByType,hotspotFiles", "FunctionMetricsAnalyzer": "totalFunctions,godFunctions,averageComplexity",
    "AuthMigrationAnalyzer": "totalAccesses,accessesByProperty,migrationPriority", "DelegateAnalyzer": "totalDelegateAssignments,delegateProtocols,potentialIssues", "UnusedCodeAnalyzer": "potentiallyUnusedTypes,potentiallyUnusedFunctions",
    "TestCoverageAnalyzer": "totalTestFiles,coveragePercentage,testTargets", "DependencyManagerAnalyzer": "pods,totalDependencies,recommendations",
}
SIGNATURES = {"DelegateAnalyzer": "analyze(files: [URL], relativeTo: URL, typeMap: TypeMap)", "UnusedCodeAnalyzer": "analyze(files: [URL], relativeTo: URL, targetFiles: Set<String>?)", "TestCoverageAnalyzer": "analyze(files: [URL], relativeTo: URL, targetAnalysis: TargetAnalysis?)", "DependencyManagerAnalyzer": "analyze(projectRoot: URL)"}
USUAL_SIGNATURE = "analyze(files: [URL], relativeTo: URL)"
#: Parameters that a part may need, with their types, and words that are no variables.
PARAMETERS = {"ctx": "AnalysisContext", "outputFile": "String?", "rootPath": "String", "rootURL": "URL", "runAll": "Bool", "swiftFiles": "[URL]", "verbose": "Bool"}
WORDS = ["if", "else", "let", "var", "for", "in", "return", "guard", "true", "false", "nil", "self"]


def signature_table(df: DataFrame) -> DataFrame:
    """(analyzer, signature, properties): a constant table; *df* only lends its session."""
    rows = [F.struct(F.lit(a).alias("analyzer"), F.lit(SIGNATURES.get(a, USUAL_SIGNATURE)).alias("signature"), F.split(F.lit(p), ",").alias("properties")) for a, p in ANALYZERS.items()]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def text_complexity(text: Column) -> Column:
    """How many branching words stand in a text."""
    out = F.lit(0).cast("long")
    for w in BRANCH_WORDS:
        out = out + T.occurrences(text, w)
    return out


def signature(name: Column, parameters: Column, result: Column) -> Column:
    return F.concat(F.lit("func "), name, F.lit("("), F.array_join(parameters, ", "), F.lit(")"), F.when(result.isNotNull(), F.concat(F.lit(" -> "), result)).otherwise(""))


def long_functions(nodes: DataFrame) -> DataFrame:
    """(path, name, line, end_line, line_count, complexity, weight) of functions of over LONG lines outside other functions, heaviest first."""
    n = F.col("end_line") - F.col("pos_line") + 1
    rows = nodes.filter((F.col("kind") == "FunctionDecl") & F.col("func_id").isNull() & (n > LONG))
    rows = rows.select("path", "name", F.col("pos_line").alias("line"), "end_line", n.alias("line_count"), (1 + text_complexity(F.coalesce("body", F.lit("")))).alias("complexity"))
    return rows.withColumn("weight", F.col("line_count") * F.col("complexity")).orderBy(F.desc("weight"), "path", "line")


def _inside(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of each long function: an equi-join on the file with a range; a file is one group."""
    f = functions.select("path", F.col("name").alias("function"), F.col("line").alias("start"), F.col("end_line").alias("stop"))
    return f.join(lines, "path").filter(F.col("line_no").between(F.col("start"), F.col("stop")))


def sections(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, function, name, line, end_line, line_count): what lies between the marks in a long function; the last one ends with it."""
    d = _inside(functions, lines)
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.col("line").contains(m)
    mode = F.nullif(F.regexp_extract("line", r"if\s+(\w+Mode)", 1), F.lit(""))
    is_mode = ((F.col("line").contains("if ") & F.col("line").contains("Mode ||")) | F.col("line").contains("|| runAll")) & mode.isNotNull()
    bare = F.trim(F.replace(F.replace(F.replace("line", F.lit("// MARK:"), F.lit("")), F.lit("// ---"), F.lit("")), F.lit("-"), F.lit("")))
    rows = d.filter(marked | is_mode).select("path", "function", "start", "stop", "line_no", F.when(is_mode, mode).otherwise(bare).alias("name"))
    following = F.lead("line_no").over(Window.partitionBy("path", "function", "start").orderBy("line_no"))
    rows = rows.withColumn("end_line", F.coalesce(following - 1, F.col("stop")))
    return rows.select("path", "function", "name", F.col("line_no").alias("line"), "end_line", (F.col("end_line") - F.col("line_no") + 1).alias("line_count"))


def blocks(functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, function, name, line, end_line, line_count, complexity) of the long conditions that stand directly in a long function."""
    owner = nodes.filter("kind = 'FunctionDecl'").select("path", F.col("node_id").alias("func_id"), F.col("name").alias("function"), F.col("pos_line").alias("_line"))
    owner = owner.join(functions.select("path", F.col("name").alias("function"), F.col("line").alias("_line")), ["path", "function", "_line"], "left_semi")
    n = F.col("end_line") - F.col("pos_line") + 1
    ifs = nodes.filter((F.col("kind") == "IfExpr") & (F.col("parent_id") == F.col("func_id")) & (n > LONG_BLOCK)).join(owner.select("path", "func_id", "function"), ["path", "func_id"])
    return ifs.select("path", "function", F.concat(F.lit("if block at line "), "pos_line").alias("name"), F.col("pos_line").alias("line"), "end_line", n.alias("line_count"), text_complexity(F.col("text")).alias("complexity"))


def shared_variables(functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, function, name, line, is_mutated) of the variables that a long function declares at its top level."""
    owner = nodes.filter("kind = 'FunctionDecl'").select("path", F.col("node_id").alias("func_id"), F.col("name").alias("function"), F.col("pos_line").alias("_line"))
    owner = owner.join(functions.select("path", F.col("name").alias("function"), F.col("line").alias("_line")), ["path", "function", "_line"], "left_semi")
    rows = nodes.filter((F.col("kind") == "VariableDecl") & (F.col("parent_id") == F.col("func_id"))).join(owner.select("path", "func_id", "function"), ["path", "func_id"])
    return rows.select("path", "function", "name", F.col("pos_line").alias("line"), F.array_contains("modifiers", "var").alias("is_mutated"))


def _spoken(name: Column) -> Column:
    words = F.filter(F.split(name, "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.initcap(w)), "")


def extractions(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, function, suggested, line, end_line, line_count, parameters, returns, difficulty, reason, analyzers, dependencies, signature, preview, block_id).

    Blocks of a mode of over LONG_MODE lines, and marked sections of over LONG_SECTION lines that do not lie within
    CLOSE lines of such a block.
    """
    d = _inside(functions, lines)
    opened = F.when(F.col("line").contains("|| runAll {") & F.trim("line").startswith("if "), F.get(F.split(F.substring(F.trim("line"), 4, 1 << 20), " "), F.lit(0)))
    marks = d.withColumn("mode", opened).filter("mode is not null").select("path", "function", "start", "stop", "mode", F.col("line_no").alias("from"))
    following = F.lead("from").over(Window.partitionBy("path", "function", "start").orderBy("from"))
    modes = marks.withColumn("to", F.coalesce(following - 1, F.col("stop"))).filter(F.col("to") - F.col("from") + 1 > LONG_MODE)
    modes = modes.withColumn("suggested", F.concat(F.lit("run"), F.initcap(F.replace("mode", F.lit("Mode"), F.lit(""))), F.lit("Analysis")))
    s = sections(functions, lines).filter(F.col("line_count") > LONG_SECTION).select("path", "function", "name", F.col("line").alias("from"), F.col("end_line").alias("to"))
    near = modes.select("path", "function", F.col("from").alias("_f"), F.col("to").alias("_t"))
    same = (F.abs(F.col("from") - F.col("_f")) < CLOSE) & (F.abs(F.col("to") - F.col("_t")) < CLOSE)
    s = s.alias("s").join(near.alias("n"), (F.col("s.path") == F.col("n.path")) & (F.col("s.function") == F.col("n.function")) & same, "left_anti")
    clean = _spoken(F.col("name"))
    s = s.withColumn("suggested", F.when(clean == "", F.concat(F.lit("extractedSection"), "from")).otherwise(F.concat(F.lit("handle"), clean)))
    every = modes.select("path", "function", "suggested", "from", "to", F.lit(None).cast("string").alias("section")).unionByName(s.select("path", "function", "suggested", "from", "to", F.col("name").alias("section")))
    code = every.select("path", "from", "to").distinct().join(lines, "path").filter(F.col("line_no").between(F.col("from"), F.col("to")))
    code = code.groupBy("path", "from", "to").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("_code"))
    d = every.join(code, ["path", "from", "to"]).withColumn("_text", F.array_join("_code", "\n")).withColumn("line_count", F.col("to") - F.col("from") + 1)
    mode = F.col("section").isNull()
    found = F.when(mode, F.regexp_extract_all("_text", F.lit(r"let\s+\w+\s*=\s*(\w+Analyzer)\(\)"), 1)).otherwise(F.array().cast("array<string>"))
    probes = F.array_compact(F.array(*[F.when(mode & (F.col("_text").contains(a) | F.col("_text").contains(b)), F.lit(label)) for (a, b), label in PROBES]))
    d = d.withColumn("analyzers", found).withColumn("dependencies", probes)
    difficulty = F.when(~mode, "medium").when(F.size("dependencies") > 0, "hard").when(F.size("analyzers") > 0, "medium").otherwise("easy")
    reason = F.when(~mode, F.concat(F.lit("MARK section '"), "section", F.lit("' is "), "line_count", F.lit(" lines"))).when(F.size("dependencies") > 0, F.concat(F.lit("Has dependencies: "), F.array_join("dependencies", ", "))).otherwise("Standard analysis block")
    takes = F.when(mode, F.array(F.lit("ctx: AnalysisContext"), F.lit("isSpecificMode: Bool"), F.lit("runAll: Bool"))).otherwise(F.array().cast("array<string>"))
    gives = F.when(mode, "Bool")
    shown = F.when(F.col("line_count") > 50, 10).when(F.col("line_count") > 20, 5).otherwise(3)
    return d.select(
        "path", "function", "suggested", F.col("from").alias("line"), F.col("to").alias("end_line"), "line_count", takes.alias("parameters"), gives.alias("returns"), difficulty.alias("difficulty"), reason.alias("reason"), "analyzers", "dependencies",
        signature(F.col("suggested"), takes, gives).alias("signature"), F.array_join(F.slice("_code", F.lit(1), shown), "\n").alias("preview"), F.concat("path", F.lit(":"), "function", F.lit("#"), "suggested").alias("block_id"),
    )


def opportunities(found: DataFrame) -> DataFrame:
    """(path, function, n_extractions, reduction): a tenth of the lines that could go."""
    return found.groupBy("path", "function").agg(F.count("*").alias("n_extractions"), F.expr("sum(line_count) div 10").alias("reduction"))


def detail(files: DataFrame, first: int, last: int) -> DataFrame:
    """One row a file for lines *first* to *last*: the code, the names in it, a signature for it, the call in its place and the function."""
    lines = F.slice(F.split("text", "\n"), max(first, 1), max(last - max(first, 1) + 1, 0))
    d = files.select("path", lines.alias("_l")).withColumn("code", F.array_join("_l", "\n"))
    names = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all("code", F.lit(p), 1)))
    word = r"(?<![\w])({})(?![\w])"
    d = d.withColumn("variables", F.array_except(names(word.format("[a-z][a-zA-Z0-9]*")), F.array(*[F.lit(w) for w in WORDS])))
    d = d.withColumn("functions", names(r"(?<![\w])([a-zA-Z][a-zA-Z0-9]*)\s*\(")).withColumn("types", names(word.format("[A-Z][a-zA-Z0-9]*")))
    needed = F.filter(F.array(*[F.lit(p) for p in PARAMETERS]), lambda p: F.array_contains("variables", p))
    kinds = F.create_map(*[F.lit(x) for kv in PARAMETERS.items() for x in kv])
    returns = F.col("code").contains("return")
    d = d.withColumn("_p", needed).withColumn("signature", signature(F.lit("extractedFunction"), F.transform("_p", lambda p: F.concat(p, F.lit(": "), kinds[p])), F.when(returns, "Bool")))
    call = F.concat(F.lit("extractedFunction("), F.array_join("_p", ", "), F.lit(")"))
    body = F.array_join(F.transform("_l", lambda x: F.concat(F.lit("    "), x)), "\n")
    return d.select("path", F.lit(f"{first}-{last}").alias("range"), F.size("_l").alias("line_count"), "code", "variables", "functions", "types", "signature", F.when(returns, F.concat(F.lit("if "), call, F.lit(" { return }"))).otherwise(call).alias("replacement"), F.concat("signature", F.lit(" {\n"), body, F.lit("\n}")).alias("generated"))
