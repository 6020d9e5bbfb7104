"""Chunks that stand for files, types and clusters, and the pipelines that make all chunks of a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import facts, frameworks
from quarry.operators import text as T
from quarry.session import cut

#: Modules that say nothing about a cluster.
STANDARD = ["Foundation", "UIKit", "SwiftUI", "Combine", "Swift"]
#: A file with so many smells is a hotspot.
MANY_SMELLS = 5
VIRTUAL = ["hotspot", "fileSummary", "cluster", "typeSummary"]

#: The columns of a chunk with what a virtual chunk has by default.
COLUMNS = {
    "id": "string", "file": "string", "line": "int", "end_line": "int", "name": "string", "kind": "string", "parent_type": "string", "module_path": "string", "signature": "string", "parameters": "array<string>", "return_type": "string",
    "doc_comment": "string", "purpose": "string", "calls": "array<string>", "called_by": "array<string>", "uses_types": "array<string>", "conforms_to": "array<string>", "complexity": "int", "line_count": "int", "visibility": "string",
    "is_singleton": "boolean", "has_smells": "boolean", "has_todo": "boolean", "attributes": "array<string>", "property_wrappers": "array<string>", "keywords": "array<string>", "layer": "string", "imports": "array<string>", "patterns": "array<string>",
}
_DEFAULTS = {"line": 1, "end_line": 1, "visibility": "internal", "is_singleton": False, "has_smells": False, "has_todo": False, "layer": "unknown"}


def shaped(df: DataFrame) -> DataFrame:
    """*df* with all columns of a chunk, in order; what is missing gets its default."""

    def column(name: str, kind: str) -> Column:
        if name in df.columns:
            return F.col(name).cast(kind).alias(name)
        if kind.startswith("array"):
            return F.array().cast(kind).alias(name)
        return F.lit(_DEFAULTS.get(name)).cast(kind).alias(name)

    return df.select(*[column(n, k) for n, k in COLUMNS.items()])


def _joined(column: str) -> Column:
    """The distinct entries of an array column over a group, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column)))).alias(column)


def _first(column: str) -> Column:
    return F.min_by(column, F.struct("line", "id")).alias(column)


def _listed(names: Column, limit: int, ends: str = "...") -> Column:
    return F.when(F.size(names) > limit, F.concat(F.array_join(F.slice(names, 1, limit), ", "), F.lit(ends))).otherwise(F.array_join(names, ", "))


def finding_lines(nodes: DataFrame) -> DataFrame:
    """(path, tag, line): where code wires delegates, subscribes, uses singletons or calls the network, in one pass."""
    network = F.col("kind").isin("MemberAccessExpr", "FunctionCallExpr") & facts._has(F.coalesce("text", F.lit("")), ["URLSession", "URLRequest", "Alamofire", "dataTask"])
    rules = {"delegate": frameworks.is_wiring(), "reactive": frameworks.is_subscription(), "uses-singleton": facts.reference() == "globalSingleton", "network-call": facts.is_endpoint() | network}
    tags = F.array_compact(F.array(*[F.when(c, tag) for tag, c in rules.items()]))
    return nodes.select("path", F.explode(tags).alias("tag"), F.col("pos_line").alias("line")).distinct()


def tagged(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """*chunks* with the tags of the findings within their lines: the findings are gathered by file before the join."""
    at = lines.groupBy(F.col("path").alias("file")).agg(F.collect_set(F.struct("tag", F.col("line").alias("at"))).alias("_at"))
    order = F.array(*[F.lit(t) for t in ("delegate", "reactive", "uses-singleton", "network-call")])
    d = chunks.join(at, "file", "left")
    within = F.transform(F.filter("_at", lambda x: x["at"].between(F.col("line"), F.col("end_line"))), lambda x: x["tag"])
    tags = F.array_intersect(order, F.coalesce(within, F.array().cast("array<string>")))
    return d.withColumn("patterns", F.concat("patterns", tags)).select(*chunks.columns)


def file_chunks(files: DataFrame, nodes: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """The chunks of types, functions, methods and initialisers, of all files or of some, with their callers."""
    if paths is not None:
        files, nodes = files.filter(F.col("path").isin(paths)), nodes.filter(F.col("path").isin(paths))
    return shaped(facts.called_by(tagged(facts.chunks(files, nodes), finding_lines(nodes))))


def hotspots(chunks: DataFrame, files: DataFrame, smells: DataFrame, metrics: DataFrame) -> DataFrame:
    """A chunk for each file with a god function, many smells or a singleton."""
    god = F.when(F.col("is_god"), F.struct((-(F.col("line_count") + 5 * F.col("complexity"))).alias("o"), "line", "name"))
    g = metrics.groupBy("path").agg(F.array_sort(F.collect_list(god)).alias("_god"))
    s = smells.groupBy("path", "kind").agg(F.count("*").alias("n")).groupBy("path").agg(F.sum("n").alias("n_smells"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "kind", "n"))).alias("_kinds"))
    c = chunks.groupBy(F.col("file").alias("path")).agg(
        F.sum("complexity").alias("complexity"), F.count_if("has_todo").alias("n_todos"), F.count_if("is_singleton").alias("n_singletons"), _joined("attributes"), _joined("patterns"), _first("module_path"), _first("imports"), _first("layer"),
    )
    d = files.select("path", "file_name", "line_count").join(g, "path", "left").join(s, "path", "left").join(c, "path", "left")
    d = d.na.fill(0, ["n_smells", "n_todos", "n_singletons", "complexity"]).withColumn("_god", F.coalesce("_god", F.from_json(F.lit("[]"), "array<struct<o:int,line:int,name:string>>")))
    d = d.filter((F.size("_god") > 0) | (F.col("n_smells") >= MANY_SMELLS) | (F.col("n_singletons") > 0))
    kinds = F.array_join(F.transform(F.slice("_kinds", 1, 3), lambda x: F.concat_ws(" ", x["n"], x["kind"])), ", ")
    parts = F.concat_ws(
        ", ", F.when(F.size("_god") > 0, F.concat(F.size("_god"), F.lit(" god functions: "), F.array_join(F.transform(F.slice("_god", 1, 3), lambda x: x["name"]), ", "))),
        F.when(F.col("n_smells") > 0, F.concat("n_smells", F.lit(" smells ("), kinds, F.lit(")"))), F.when(F.col("n_singletons") > 0, F.concat("n_singletons", F.lit(" singletons"))), F.when(F.col("n_todos") > 0, F.concat("n_todos", F.lit(" TODOs"))),
    )
    words = F.array(*[F.lit(w) for w in ("hotspot", "refactor", "quality", "tech-debt")])
    return shaped(d.select(
        F.concat(F.lit("hotspot:"), "path").alias("id"), F.col("path").alias("file"), F.col("line_count").alias("end_line"), F.col("file_name").alias("name"), F.lit("hotspot").alias("kind"), F.coalesce("module_path", F.lit("")).alias("module_path"),
        F.concat(F.lit("Hotspot: "), "path").alias("signature"), F.concat(F.lit("File health: "), parts).alias("purpose"), "complexity", "line_count", (F.col("n_singletons") > 0).alias("is_singleton"), (F.col("n_smells") > 0).alias("has_smells"),
        (F.col("n_todos") > 0).alias("has_todo"), *[F.coalesce(x, F.array().cast("array<string>")).alias(x) for x in ("attributes", "patterns", "imports")], words.alias("keywords"), F.coalesce("layer", F.lit("unknown")).alias("layer"),
    ))


def file_summaries(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """A chunk for each file that has chunks: what it holds in one line."""
    is_type, is_method = F.col("kind").isin("class", "struct", "enum", "protocol"), F.col("kind").isin("method", "function")
    c = chunks.filter(~F.col("kind").isin(VIRTUAL)).groupBy(F.col("file").alias("path")).agg(
        F.transform(F.array_sort(F.collect_list(F.when(is_type, F.struct("line", "name")))), lambda x: x["name"]).alias("_types"), F.count_if(is_method).alias("n_methods"), F.count_if(is_method & F.col("visibility").isin("public", "open")).alias("n_public"),
        *[_joined(x) for x in ("conforms_to", "attributes", "patterns", "uses_types")], _first("module_path"), _first("imports"), _first("layer"), *[F.bool_or(x).alias(x) for x in ("is_singleton", "has_smells", "has_todo")],
    )
    d = files.select("path", "file_name", "line_count").join(c, "path")
    reactive = F.array_contains("attributes", "@Observable") | F.array_contains("patterns", "reactive")
    parts = F.concat_ws(
        ", ", F.when(F.size("_types") > 0, F.concat(F.size("_types"), F.lit(" types: "), _listed(F.col("_types"), 3))), F.when(F.col("n_methods") > 0, F.concat("n_methods", F.lit(" methods"))), F.when(F.col("n_public") > 0, F.concat("n_public", F.lit(" public"))),
        F.when(F.size("conforms_to") > 0, F.concat(F.lit("conforms to "), F.array_join(F.slice("conforms_to", 1, 3), ", "))), F.when(F.array_contains("attributes", "@MainActor"), F.lit("@MainActor")), F.when(reactive, F.lit("reactive")),
    )
    return shaped(d.select(F.concat(F.lit("summary:"), "path").alias("id"), F.col("path").alias("file"), F.col("line_count").alias("end_line"), F.col("file_name").alias("name"), F.lit("fileSummary").alias("kind"), F.col("path").alias("signature"), parts.alias("purpose"), F.array(F.lit("file"), F.lit("summary"), F.col("layer")).alias("keywords"), *[x for x in d.columns if x in COLUMNS and x != "file_name"]))


def _clusters(members: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """Groups of two files or more (key, path) with the imports, patterns and attributes of their summaries. Of the files only the first five names and the count are kept."""
    members = members.select(key, "path").distinct()
    n = members.groupBy(key).agg(F.count("*").alias("n_files")).filter("n_files >= 2")
    first = members.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("path"))).filter("_r <= 5")
    names = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", T.last_part(F.col("path")).alias("name")))), lambda x: x["name"]).alias("_names"))
    s = members.join(summaries.select(F.col("file").alias("path"), "imports", "patterns", "attributes", "layer"), "path")
    per = s.groupBy(key).agg(F.count("*").alias("_n"), _joined("patterns"), _joined("attributes"), F.min_by("layer", "path").alias("layer"))
    imports = s.select(key, F.explode("imports").alias("_module")).filter(~F.col("_module").isin(STANDARD)).groupBy(key, "_module").agg(F.count("*").alias("_m"))
    imports = imports.join(per.select(key, "_n"), key).groupBy(key).agg(F.array_sort(F.collect_list("_module")).alias("_all"), F.array_sort(F.collect_list(F.when(F.col("_m") >= F.greatest(F.lit(1), F.floor(F.col("_n") / 2)), F.col("_module")))).alias("_shared"))
    none = F.array().cast("array<string>")
    d = n.join(names, key).join(per, key, "left").join(imports, key, "left")
    named = F.concat(F.array_join("_names", ", "), F.when(F.col("n_files") > 5, F.concat(F.lit("... ("), F.col("n_files"), F.lit(" files)"))).otherwise(""))
    return d.withColumns({"_named": named, "layer": F.coalesce("layer", F.lit("unknown"))} | {c: F.coalesce(c, none) for c in ("_all", "_shared", "patterns", "attributes")})


def clusters(types: DataFrame, summaries: DataFrame) -> DataFrame:
    """Chunks for protocols with conforming types in two files or more, and for folders with two files or more.

    Both tables are read many times, so what is needed of them is written once.
    """
    types = cut(types.select("path", "name", "kind", "line", "conformances"))
    summaries = cut(summaries.select("file", "module_path", "imports", "patterns", "attributes", "layer"))
    conforming = types.filter("kind <> 'protocol'").select(F.explode("conformances").alias("protocol"), "name")
    many = conforming.groupBy("protocol").agg(F.count("*").alias("_c")).filter("_c >= 2").select("protocol")
    where = types.filter("kind <> 'extension'").groupBy("name").agg(F.max_by("path", F.struct("path", "line")).alias("path"))
    p = _clusters(conforming.join(many, "protocol", "left_semi").join(where, "name").select("protocol", "path"), summaries, "protocol")
    by_protocol = p.select(
        F.concat(F.lit("cluster:protocol:"), "protocol").alias("id"), F.concat(F.lit("protocol:"), "protocol").alias("file"), F.concat("protocol", F.lit(" conformers")).alias("name"), F.lit("cluster").alias("kind"), F.col("protocol").alias("module_path"),
        F.concat(F.lit("Cluster: "), "protocol", F.lit(" protocol conformers")).alias("signature"), F.concat("n_files", F.lit(" files conform to "), "protocol", F.lit(": "), "_named", F.lit(". Imports: "), F.array_join(F.slice("_all", 1, 3), ", ")).alias("purpose"),
        F.array("protocol").alias("conforms_to"), F.col("n_files").alias("line_count"), "attributes", F.array(F.lit("cluster"), F.lit("protocol"), F.lower("protocol"), F.col("layer")).alias("keywords"), "layer", F.col("_all").alias("imports"), "patterns",
    )
    folder = F.when(F.col("module_path") == "", "Root").otherwise(F.col("module_path"))
    m = _clusters(summaries.select(folder.alias("module"), F.col("file").alias("path")), summaries, "module")
    by_folder = m.select(
        F.concat(F.lit("cluster:dir:"), "module").alias("id"), F.col("module").alias("file"), T.last_part(F.col("module")).alias("name"), F.lit("cluster").alias("kind"), F.col("module").alias("module_path"), F.concat(F.lit("Cluster: "), "module").alias("signature"),
        F.concat("n_files", F.lit(" files: "), "_named", F.lit(". Shared: "), F.array_join(F.slice("_shared", 1, 5), ", ")).alias("purpose"), F.col("n_files").alias("line_count"), "attributes", F.array(F.lit("cluster"), F.lit("module"), F.col("layer")).alias("keywords"),
        "layer", F.col("_shared").alias("imports"), "patterns",
    )
    return shaped(by_protocol).unionByName(shaped(by_folder))


def type_summaries(chunks: DataFrame, types: DataFrame) -> DataFrame:
    """A chunk for each type that is no protocol: its files, methods and conformances, extensions included."""
    t = types.groupBy("name").agg(
        F.array_sort(F.collect_set("path")).alias("_files"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("conformances")))).alias("conforms_to"), F.max_by("path", F.when(F.col("kind") != "extension", F.struct("path", "line"))).alias("_file"),
        F.bool_or(F.col("kind") == "protocol").alias("_protocol"),
    ).filter("not _protocol")
    public = F.col("visibility").isin("public", "open")
    callable_ = F.col("kind").isin("method", "function", "initializer")
    m = chunks.filter("parent_type is not null").groupBy(F.col("parent_type").alias("name")).agg(
        F.count_if(callable_).alias("n_methods"), F.count_if(callable_ & public).alias("n_public"), F.array_sort(F.collect_list(F.when(callable_ & public, F.struct("file", "line", F.col("name").alias("method"))))).alias("_public"),
        _joined("imports"), _joined("attributes"), F.min_by("layer", F.struct("file", "line")).alias("layer"),
    )
    d = t.join(m, "name", "left").na.fill(0, ["n_methods", "n_public"])
    key = F.transform(F.slice("_public", 1, 5), lambda x: x["method"])
    files = F.transform("_files", lambda p: T.last_part(p))
    parts = F.concat_ws(
        ". ", F.when(F.size("_files") > 1, F.concat(F.size("_files"), F.lit(" files: "), F.array_join(files, ", "))), F.concat("n_methods", F.lit(" methods ("), "n_public", F.lit(" public)")),
        F.when(F.size("conforms_to") > 0, F.concat(F.lit("Conforms to: "), F.array_join(F.slice("conforms_to", 1, 5), ", "))), F.when(F.size("_public") > 0, F.concat(F.lit("Key: "), F.array_join(key, ", "))),
    )
    none = F.array().cast("array<string>")
    return shaped(d.select(
        F.concat(F.lit("typeSummary:"), "name").alias("id"), F.coalesce("_file", F.get("_files", F.lit(0))).alias("file"), "name", F.lit("typeSummary").alias("kind"), F.col("name").alias("module_path"), F.concat(F.lit("TypeSummary: "), "name").alias("signature"),
        parts.alias("purpose"), "conforms_to", F.col("n_methods").alias("line_count"), F.lit("public").alias("visibility"), F.coalesce("attributes", none).alias("attributes"), F.array(F.lit("type"), F.lit("summary"), F.lower("name")).alias("keywords"),
        F.coalesce("layer", F.lit("unknown")).alias("layer"), F.coalesce("imports", none).alias("imports"),
    ))


def virtual_chunks(chunks: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hotspots, file summaries, clusters and type summaries from the chunks of files."""
    own = chunks.filter(~F.col("kind").isin(VIRTUAL))
    types, summaries = facts.type_definitions(nodes), file_summaries(own, files)
    parts = [hotspots(own, files, facts.smells(nodes), facts.function_metrics(nodes)), summaries, clusters(types, summaries), type_summaries(own, types)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def all_chunks(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every chunk of a project: those of its files and the virtual ones."""
    own = file_chunks(files, nodes)
    return own.unionByName(virtual_chunks(own, files, nodes))


def type_map(types: DataFrame) -> dict[str, DataFrame]:
    """The definitions and what follows from them: the file of a type, the types of a file, the conforming types of a protocol, parents."""
    return {
        "definitions": types, "type_to_file": types.filter("kind <> 'extension'").groupBy("name").agg(F.max_by("path", F.struct("path", "line")).alias("path")), "file_to_types": types.groupBy("path").agg(F.array_sort(F.collect_list("name")).alias("types")),
        "conformers": types.filter("kind <> 'protocol'").select(F.explode("conformances").alias("protocol"), "name").groupBy("protocol").agg(F.array_sort(F.collect_list("name")).alias("conformers")),
        "parents": types.filter("superclass is not null").select(F.col("name").alias("child"), F.col("superclass").alias("parent")).distinct(),
    }


def chunk_report(chunks: DataFrame, kind: str | None = None, samples: int = 5) -> dict[str, DataFrame]:
    """The chunks of a kind or all, their number by kind, and the texts of the first few."""
    kept = chunks.filter(F.col("kind") == kind) if kind else chunks
    return {"chunks": kept, "by_kind": kept.groupBy("kind").agg(F.count("*").alias("n")), "samples": kept.orderBy("file", "line", "id").limit(samples).select("id", facts.embedding_text(kept).alias("text"))}
