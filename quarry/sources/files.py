"""Readers of source trees and of the project files beside them."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.functions.syntax import Source
from quarry.operators import text as T

#: Path parts that exclude a file.
EXCLUDED = ["Pods", ".build", "DerivedData", "Carthage", "xcodeproj", "xcworkspace"]

NODES = (
    "path string, node_id int, parent_id int, end_id int, kind string, pos_line int, end_line int, name string, text string, line_text string, in_debug boolean, callee string, base string, "
    "member string, modifiers array<string>, attrs array<string>, inherits array<string>, params array<struct<label:string,name:string,type:string,has_default:boolean>>, return_type string, "
    "is_async boolean, throws boolean, bang boolean, literal string, doc array<string>, comments array<string>, visibility string, parent_kind string, parent_text string, ctx_func string, func_id int, outer_func_id int, "
    "ctx_type string, ctx_type_kind string, if_depth int, is_else_if boolean, complexity int, signature string, body string, calls array<string>, types array<string>, imports array<string>"
)
_NAMES = [c.split()[0] for c in NODES.split(", ")]
#: A batch of nodes goes on at so many rows, or characters of source.
ROWS, CHARACTERS = 10000, 1 << 20


def source_files(spark: SparkSession, root: str, include_tests: bool = False, excluding: list[str] | None = None, suffix: str = "swift") -> DataFrame:
    """(path, file_name, module_path, text, content_hash, line_count) of every source file under *root*, or of one file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(root)
    for part in [*(EXCLUDED if excluding is None else excluding), *([] if include_tests else ["Tests"])]:
        found = found.filter(~F.col("path").contains(part))
    base = root.rstrip("/") + "/"
    return described(found.select(F.substring_index("path", base, -1).alias("path"), F.decode("content", "UTF-8").alias("text")))


def described(files: DataFrame) -> DataFrame:
    """Adds the columns that follow from (path, text)."""
    return files.select(
        "path", T.last_part(F.col("path")).alias("file_name"), T.module_path(F.col("path")).alias("module_path"),
        "text", T.content_hash(F.col("text")).alias("content_hash"), F.size(F.split("text", "\n")).alias("line_count"),
    )


def matching(files: DataFrame, fragment: str) -> DataFrame:
    """Files whose path contains *fragment* or whose name equals it; pushed below any parsing."""
    return files.filter(F.col("path").contains(fragment) | (F.col("file_name") == fragment))


def file_at(files: DataFrame, path: str) -> DataFrame:
    """The file of exactly this path."""
    return files.filter(F.col("path") == path)


def dependency_root(path: str, levels: int = 5) -> str | None:
    """The nearest folder, from *path* up to *levels* parents, that holds a dependency file; a look at the driver's file system."""
    here = os.path.abspath(path)
    for _ in range(levels + 1):
        if any(os.path.exists(os.path.join(here, n)) for n in ("Podfile", "Package.swift", "Cartfile")):
            return here
        here = os.path.dirname(here)
    return None


def under(files: DataFrame, prefix: str) -> DataFrame:
    """Files under a folder, given from the root or from within."""
    p = prefix.strip("/")
    return files.filter(F.col("path").startswith(p) | F.col("path").contains(f"/{p}/") | F.col("path").endswith(f"/{p}"))


def unique_file(files: DataFrame, name: str) -> DataFrame:
    """The one file with this name or path end; none or several raise ValueError."""
    hit = files.filter((F.col("file_name") == name) | F.col("path").endswith(name))
    paths = [r.path for r in hit.select("path").limit(2).collect()]
    if len(paths) != 1:
        raise ValueError(f"no file matches {name}" if not paths else f"several files match {name}: {', '.join(paths)}")
    return hit


def of_targets(files: DataFrame, target_files: DataFrame, target: str) -> DataFrame:
    return files.join(target_files.filter(F.col("target") == target).select("file_name").distinct(), "file_name", "left_semi")


def read_lines(files: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """(path, line_no, line), from line *first* to *last*, clamped to the file."""
    rows = T.lines(files, "path", "text")
    return rows.filter(F.col("line_no").between(max(first or 1, 1), last or 2**31 - 1))


def nodes(files: DataFrame, faithful: bool = True, kinds: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The syntax nodes of every file; with *kinds* and *columns* only these, for operators that read no others (see reads).

    A Python worker holds a batch of nodes, or one file's. calls and types of a function are what stands in it and in no
    inner function; imports are those of its file.
    """
    names = [c for c in _NAMES if columns is None or c == "path" or c in columns]
    if columns is not None and (unknown := set(columns) - set(_NAMES)):
        raise ValueError(f"nodes have no {', '.join(sorted(unknown))}")
    schema = ", ".join(c for c in NODES.split(", ") if c.split()[0] in names)
    wanted, asked, form = None if kinds is None else set(kinds), names[1:], to_arrow_schema(StructType.fromDDL(schema))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in names}
        characters = 0
        for batch in batches:
            for path, text in zip(batch.column("path"), batch.column("text"), strict=True):
                source = text.as_py() or ""
                found = Source(source).table(["kind", *asked], wanted, faithful)
                n, characters = len(found["kind"]), characters + len(source)
                held["path"] += [path.as_py()] * n
                for c in asked:
                    held[c] += found[c]
                if len(held["path"]) >= ROWS or characters >= CHARACTERS:
                    yield pa.RecordBatch.from_pydict(held, schema=form)
                    held, characters = {c: [] for c in names}, 0
        if held["path"]:
            yield pa.RecordBatch.from_pydict(held, schema=form)

    return files.select("path", "text").mapInArrow(parse, schema)


def podfile(files: DataFrame) -> DataFrame:
    """(path, target, name, subspec, version, source, is_test) of the pods of a Podfile, one row for each name and subspec.

    The words of a line are read first: a call and its quoted arguments. A block opens with `do` and closes with `end`;
    a pod belongs to the innermost target around it, none after its end.
    """
    rows = T.lines(files, "path", "text").withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).filter("line <> ''")
    call = F.regexp_extract("line", r"^[a-z_]+", 0)
    quoted = F.regexp_extract_all("line", F.lit("(\"[^\"]*\"|'[^']*')"), 1)
    arguments = F.transform(quoted, lambda x: F.substring(x, 2, 1 << 20))
    arguments = F.transform(arguments, lambda x: F.regexp_replace(x, "[\"']$", ""))
    rows = rows.withColumn("call", call).withColumn("args", arguments)
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = F.col("line").rlike(r"\bdo(\s*\|.*\|)?$"), F.col("line") == "end"
    rows = rows.withColumn("depth", F.sum(opens.cast("int") - closes.cast("int")).over(w))
    # a target is around a line if it opened at a depth that has not been left since
    mark = F.when((F.col("call") == "target") & opens, F.struct(F.col("depth").alias("d"), F.get("args", F.lit(0)).alias("name")))
    rows = rows.withColumn("opened", F.collect_list(F.struct("line_no", mark.alias("t"), F.col("depth").alias("at"))).over(w))
    around = F.aggregate("opened", F.array().cast("array<struct<d:bigint,name:string>>"), lambda acc, x: F.concat(F.filter(acc, lambda y: y["d"] <= x["at"]), F.when(x["t"].isNotNull(), F.array(x["t"])).otherwise(F.array().cast("array<struct<d:bigint,name:string>>"))))
    pods = rows.filter("call = 'pod' and size(args) > 0").withColumn("target", F.try_element_at(around, F.lit(-1))["name"])
    full, version = F.get("args", F.lit(0)), F.get("args", F.lit(1))
    source = F.when(F.col("line").contains(":git"), "git").when(F.col("line").contains(":path"), "path").otherwise("registry")
    found = pods.select(
        "path", "target", F.substring_index(full, "/", 1).alias("name"), F.when(full.contains("/"), F.regexp_replace(full, "^[^/]*/", "")).alias("subspec"),
        F.when(source == "registry", version).alias("version"), source.alias("source"), F.coalesce(F.col("target").rlike("Tests?$"), F.lit(False)).alias("is_test"), "line_no",
    )
    return found.groupBy("path", "target", "name", "subspec").agg(F.min_by(F.struct("version", "source", "is_test"), "line_no").alias("f")).select("path", "target", "name", "subspec", "f.*")


def package_manifest(files: DataFrame) -> DataFrame:
    """(path, name, url) of a package manifest; the name is the last part of the url."""
    urls = F.regexp_extract_all("text", F.lit(r'\.package\s*\([^)]*?url:\s*"([^"]+)"'), 1)
    return files.select("path", F.explode(urls).alias("url")).select("path", F.regexp_replace(T.last_part(F.col("url")), r"\.git$", "").alias("name"), "url").distinct()


def cartfile(files: DataFrame) -> DataFrame:
    """(path, origin, name, version) of a Cartfile."""
    rows = T.lines(files, "path", "text").withColumn("line", F.trim("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    parts = F.split("line", r"\s+", 3)
    source = F.replace(F.get(parts, F.lit(1)), F.lit('"'), F.lit(""))
    return rows.select("path", F.get(parts, F.lit(0)).alias("origin"), T.last_part(source).alias("name"), F.get(parts, F.lit(2)).alias("version")).filter("name is not null")


def build_log(files: DataFrame) -> DataFrame:
    """(path, file, line, column, severity, message) of the diagnostics in build output; the column may be missing."""
    rows = T.lines(files, "path", "text")
    p = r"^(.+?):(\d+):(?:(\d+):)?\s*(error|warning|note):\s*(.*)$"
    part = [F.regexp_extract("line", p, i) for i in range(1, 6)]
    return rows.filter(F.col("line").rlike(p)).select("path", part[0].alias("file"), part[1].cast("int").alias("line"), F.nullif(part[2], F.lit("")).cast("int").alias("column"), part[3].alias("severity"), part[4].alias("message"))


def test_log(files: DataFrame) -> DataFrame:
    """(path, line_no, test, status) of a test run's output: passed, failed or skipped by its marks and words, the name without them and without its time."""
    rows = T.lines(files, "path", "text")
    line = F.col("line")
    status = F.when(line.contains("✔") | line.contains("passed"), "passed").when(line.contains("✘") | (line.contains("failed") & ~line.contains("tests failed")), "failed").when(line.contains("skipped"), "skipped")
    name = line
    for word in ("✔", "✘", "Test Case", "passed", "failed"):
        name = F.replace(name, F.lit(word), F.lit(""))
    name = F.trim(F.regexp_replace(F.trim(name), r"\s*\([^)]+\)\s*$", ""))
    return rows.select("path", "line_no", name.alias("test"), status.alias("status")).filter("status is not null and test <> ''")


def test_summary(results: DataFrame) -> DataFrame:
    """One row: the numbers of passed, failed and skipped tests, all, and whether none was found."""
    s = F.col("status")
    n = results.agg(*[F.count_if(s == x).alias(f"n_{x}") for x in ("passed", "failed", "skipped")], F.count("*").alias("n"))
    return n.withColumn("none_found", F.col("n") == 0)


def baseline(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An earlier summary, read as JSON with a fixed schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def to_json(rows: list[dict], pretty: bool = False) -> str:
    """A bounded report as JSON with sorted keys."""
    return json.dumps(rows, sort_keys=True, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"))
