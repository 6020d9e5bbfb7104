"""Graph operators over edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import text as T
from quarry.session import cut

#: Imports from which on a file is a hub, and nodes of a diagram.
HUB, MAX_NODES = 10, 50


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree and in_degree of every node that has an edge."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def reachable(edges: DataFrame, start: DataFrame, max_depth: int, backward: bool = False) -> DataFrame:
    """node and depth of every node within *max_depth* of *start* (column node): frontier by frontier, each node once.

    The edges are materialised once; each frontier is written once and the frontiers are put together at the end.
    """
    e = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if backward else edges.select("src", "dst")
    e = cut(e.distinct())
    frontier = cut(start.select("node").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in range(1, max_depth + 1):
        step = frontier.join(e, frontier.node == e.src).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen


def simple_paths(edges: DataFrame, start: str, target: str, max_nodes: int, max_paths: int | None = None) -> DataFrame:
    """path (joined with `>`) and length (edges) of the paths without a repeated node, shortest first.

    Only nodes from which the target can be reached in time are followed.
    """
    spark = edges.sparkSession
    e = edges.select("src", "dst").distinct()
    near = reachable(e, spark.range(1).select(F.lit(target).alias("node")), max_nodes - 1, backward=True).select(F.col("node").alias("dst"), F.col("depth").alias("left"))
    e = cut(e.join(near, "dst").select("src", "dst", "left"))
    live = spark.range(1).select(F.array(F.lit(start)).alias("path"))
    found = None
    for nodes in range(2, max_nodes + 1):
        live = live.join(e, F.element_at("path", -1) == e.src).filter(~F.array_contains("path", F.col("dst")) & (F.col("left") <= max_nodes - nodes)).select(F.concat("path", F.array("dst")).alias("path"))
        live = cut(live)
        done = live.filter(F.element_at("path", -1) == target)
        found = done if found is None else found.unionByName(done)
        live = live.filter(F.element_at("path", -1) != target)
    out = found.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("long").alias("length"))
    return out.orderBy("length", "path").limit(max_paths) if max_paths else out


def ancestors(parents: DataFrame) -> DataFrame:
    """child, ancestor and depth for the whole chain above every child; a cycle ends where it closes, so the rounds end."""
    p = cut(parents.select("child", "parent").distinct())
    up = p.select(F.col("child").alias("at"), F.col("parent").alias("above"))
    live = p.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"), F.array("child", "parent").alias("path"))
    out, depth = live, 1
    while True:
        depth += 1
        live = cut(live.join(up, live.ancestor == up.at).filter(~F.array_contains("path", F.col("above"))).select("child", F.col("above").alias("ancestor"), F.lit(depth).alias("depth"), F.concat("path", F.array("above")).alias("path")))
        if not live.take(1):
            return out.drop("path")
        out = out.unionByName(live)


def call_edges(chunks: DataFrame) -> DataFrame:
    """src and dst of the calls of chunks (name, parent_type, calls): callees without trailing parentheses, qualified only by a type."""
    src = F.when(F.col("parent_type").isNotNull(), F.concat_ws(".", "parent_type", "name")).otherwise(F.col("name"))
    callee = F.regexp_replace(F.trim("call"), r"\(\)$", "")
    parts = F.split(callee, r"\.")
    owner = F.try_element_at(parts, F.lit(-2))
    dst = F.when(owner.rlike(r"^\p{Lu}"), F.concat_ws(".", owner, F.element_at(parts, -1))).otherwise(F.element_at(parts, -1))
    return chunks.select(src.alias("src"), F.explode("calls").alias("call")).select("src", dst.alias("dst")).filter("dst <> ''").distinct()


def one(spark: SparkSession, value: str) -> DataFrame:
    """A one-row table with column node."""
    return spark.range(1).select(F.lit(value).alias("node"))


def symbols(chunks: DataFrame) -> DataFrame:
    """(symbol, name, id, file, line): the symbol of every chunk that can be called; of several the last."""
    s = F.when(F.col("parent_type").isNotNull(), F.concat_ws(".", "parent_type", "name")).otherwise(F.col("name"))
    return chunks.groupBy(s.alias("symbol")).agg(F.max_by(F.struct("name", "id", "file", "line"), F.struct("file", "line", "id")).alias("c")).select("symbol", "c.*")


def bare(symbol: Column) -> Column:
    return F.substring_index(symbol, ".", -1)


def resolve(known: DataFrame, asked: str) -> str:
    """The symbol that *asked* means: the first that ends in it after a dot, else itself, with or without parentheses. At most one row comes back."""
    plain = asked.replace("()", "")
    s = F.col("symbol")
    rank = F.when(s.endswith("." + asked) | s.endswith("." + plain), 0).when(s == asked, 1).when(s == plain, 2)
    row = known.withColumn("_r", rank).filter("_r is not null").agg(F.min(F.struct("_r", "symbol")).alias("b")).first()
    return row.b.symbol if row and row.b else asked


def matching(symbol: Column, target: str) -> Column:
    """Whether two symbols may be the same: equal, one the end of the other, or of one bare name."""
    return (symbol == target) | symbol.endswith("." + target) | F.endswith(F.lit(target), F.concat(F.lit("."), symbol)) | (bare(symbol) == target.rpartition(".")[2])


def trace(chunks: DataFrame, asked: str, max_depth: int = 5, backward: bool = False) -> DataFrame:
    """(node, depth, id, file, line) of what *asked* calls, or who calls it, the place joined where a chunk has the symbol or its bare name."""
    known = symbols(chunks)
    found = reachable(call_edges(chunks), one(chunks.sparkSession, resolve(known, asked)), max_depth, backward)
    exact = known.select(F.col("symbol").alias("node"), F.struct("id", "file", "line").alias("_e"))
    by_name = known.groupBy(bare(F.col("symbol")).alias("_bare")).agg(F.min_by(F.struct("id", "file", "line"), "symbol").alias("_b"))
    d = found.join(exact, "node", "left").withColumn("_bare", bare(F.col("node"))).join(by_name, "_bare", "left").withColumn("c", F.coalesce("_e", "_b"))
    return d.select("node", "depth", "c.id", "c.file", "c.line")


def call_paths(chunks: DataFrame, start: str, target: str, max_paths: int = 5, max_depth: int = 10) -> DataFrame:
    """The shortest paths between two symbols; every symbol that may be the target counts."""
    known, edges = symbols(chunks), call_edges(chunks)
    ends = edges.select(F.col("dst").alias("s")).union(edges.select("src")).distinct().filter(matching(F.col("s"), target))
    out = None
    for r in ends.orderBy("s").collect():  # names that end alike: as many as the symbols of one bare name
        found = simple_paths(edges, resolve(known, start), r.s, max_depth)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return edges.select(F.col("src").alias("path"), F.lit(0).cast("long").alias("length")).limit(0)
    return out.distinct().orderBy("length", "path").limit(max_paths)


def call_stats(chunks: DataFrame) -> DataFrame:
    """One row: symbols, and edges forward and backward."""
    e = call_edges(chunks).agg(F.count("*").alias("n_forward"))
    return symbols(chunks).agg(F.count("*").alias("n_symbols")).crossJoin(e).withColumn("n_backward", F.col("n_forward"))  # one row each


def file_graph(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, out_degree, in_degree, is_hub, is_orphan): modules that a file imports, files that import it by its path; busiest first."""
    out = imports.groupBy("path").agg(F.count_distinct("module").alias("out_degree"))
    into = imports.groupBy(F.col("module").alias("path")).agg(F.count_distinct("path").alias("in_degree"))
    d = files.select("path").join(out, "path", "left").join(into, "path", "left").na.fill(0, ["out_degree", "in_degree"])
    d = d.withColumn("is_hub", (F.col("out_degree") > HUB) | (F.col("in_degree") > HUB)).withColumn("is_orphan", F.col("out_degree") + F.col("in_degree") == 0)
    return d.orderBy(F.desc(F.col("out_degree") + F.col("in_degree")), "path")


def graph_metrics(degrees: DataFrame) -> DataFrame:
    """One row over file_graph(): nodes, edges, average degrees, hubs and orphans by number."""
    return degrees.agg(
        F.count("*").alias("n_nodes"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("n_edges"), F.coalesce(F.avg("in_degree"), F.lit(0.0)).alias("avg_in"), F.coalesce(F.avg("out_degree"), F.lit(0.0)).alias("avg_out"),
        F.count_if("is_hub").alias("n_hubs"), F.count_if("is_orphan").alias("n_orphans"),
    )


def diagram_edges(types: DataFrame, kind: str, max_nodes: int = MAX_NODES) -> DataFrame:
    """(src, dst, label) of a diagram of types: inheritance, protocols or dependencies (files), cut to the busiest nodes before anything is gathered."""
    if kind == "inheritance":
        rows = types.filter("kind = 'class' and superclass is not null").select(F.col("name").alias("src"), F.col("superclass").alias("dst"), "path", "line")
        return rows.orderBy("path", "line", "src").limit(max_nodes).select("src", "dst", F.lit("extends").alias("label"))
    if kind == "protocols":
        rows = types.filter("kind <> 'protocol'").select(F.col("name").alias("src"), F.explode("conformances").alias("dst")).distinct()
        top = rows.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(max_nodes // 3)
        few = rows.join(F.broadcast(top), "dst").withColumn("_r", F.row_number().over(Window.partitionBy("dst").orderBy("src"))).filter("_r <= 5")  # top is at most a third of max_nodes rows
        return few.select("src", "dst", F.lit("conforms").alias("label"))
    top = types.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(max_nodes).select("path")
    where = types.filter("kind <> 'extension'").groupBy("name").agg(F.max("path").alias("to")).select(F.col("name").alias("superclass"), "to")
    rows = types.filter("superclass is not null").join(where, "superclass").select("path", "to").distinct().filter("path <> to")
    rows = rows.join(F.broadcast(top), "path", "left_semi").join(F.broadcast(top.withColumnRenamed("path", "to")), "to", "left_semi")  # max_nodes rows
    return rows.select(T.last_part(F.col("path")).alias("src"), T.last_part(F.col("to")).alias("dst"), F.lit("uses").alias("label"))


#: Arrows of a diagram by label, and shapes of singletons and protocols.
ARROWS = {"extends": " -->|extends| ", "conforms": " -.->|conforms| ", "uses": " --> "}


def diagram(types: DataFrame, kind: str = "full", max_nodes: int = MAX_NODES, singletons: DataFrame | None = None) -> DataFrame:
    """One row (kind, n_nodes, n_edges, text, url) with a Mermaid graph of at most as many edges as the limit allows.

    *kind* is inheritance, protocols, dependencies, full (both of the first, half the limit each) or singletons, for which
    *singletons* has symbol and n. The url holds the text in base64.
    """
    if kind == "singletons":
        top = singletons.orderBy(F.desc("n"), "symbol").limit(max_nodes)
        line = F.concat(F.lit("    "), T.sanitized(F.col("symbol")), F.lit('(("'), F.col("symbol"), F.lit("\\n("), F.col("n"), F.lit(' refs)"))'))
        rows = top.select(F.lit(0).alias("part"), line.alias("line"), F.col("symbol").alias("a"), F.lit(None).cast("string").alias("b"))
        head = "graph LR"
    else:
        parts = ["inheritance", "protocols"] if kind == "full" else [kind]
        limit = max_nodes // len(parts)
        rows = None
        for i, p in enumerate(parts):
            e = diagram_edges(types, p, limit)
            arrow = F.lit(ARROWS["uses"])
            for label, sign in ARROWS.items():
                arrow = F.when(F.col("label") == label, sign).otherwise(arrow)
            name = lambda c: F.concat(T.sanitized(F.col(c)), F.lit("["), F.col(c), F.lit("]"))
            one_ = e.select(F.lit(i).alias("part"), F.concat(F.lit("    "), name("src"), arrow, name("dst")).alias("line"), F.col("src").alias("a"), F.col("dst").alias("b"))
            rows = one_ if rows is None else rows.unionByName(one_)
        head = "graph TD"
    out = rows.agg(F.size(F.array_distinct(F.array_compact(F.flatten(F.collect_list(F.array("a", "b")))))).alias("n_nodes"), F.count("b").alias("n_edges"), F.array_sort(F.collect_set(F.struct("part", "line"))).alias("_l"))
    text = F.concat_ws("\n", F.lit(head), F.transform("_l", lambda x: x["line"]))
    state = F.to_json(F.struct(F.lit(True).alias("autoSync"), F.col("text").alias("code"), F.lit("{}").alias("mermaid"), F.lit(True).alias("updateDiagram")))
    return out.withColumn("text", text).select(F.lit(kind).alias("kind"), "n_nodes", "n_edges", "text", F.concat(F.lit("https://mermaid.live/edit#base64:"), F.base64(F.encode(state, "UTF-8"))).alias("url"))


def impact(usages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files that use a symbol (path, n, how), most uses first, and one row (n_files, impact, is_safe)."""
    files = usages.groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("how")).alias("how")).orderBy(F.desc("n"), "path")
    n = usages.agg(F.count_distinct("path").alias("n_files"), F.coalesce(F.bool_or(F.col("how") == "inherits"), F.lit(False)).alias("inherited"))
    level = F.when((F.col("n_files") > 50) | F.col("inherited"), "Critical").when(F.col("n_files") > 20, "High").when(F.col("n_files") > 5, "Medium").otherwise("Low")
    return files, n.select("n_files", "inherited", level.alias("impact"), ((F.col("n_files") <= 20) & ~F.col("inherited")).alias("is_safe"))
