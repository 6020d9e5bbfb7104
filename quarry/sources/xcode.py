"""Reader of Xcode project files: targets and the sources they build.

A project file is a nested property list. A small reader turns each object of it into rows (id, key, value); targets,
phases, build files and references are then equi-joins over these rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import text as T
from quarry.session import cut

_PART = re.compile(r'/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\])*"|[{}()=;,]|[^\s{}()=;,"/]+|/', re.DOTALL)

_LABEL = re.compile(r"(?<!\w)([0-9A-F]{24}) /\* (.*?) \*/")


def parts(text: str) -> list[str]:
    """The words and signs of a property list, without comments; strings without their quotes."""
    out = []
    for m in _PART.finditer(text):
        p = m[0]
        if not p.startswith(("/*", "//")):
            out.append(re.sub(r"\\(.)", r"\1", p[1:-1]) if p[0] == '"' else p)
    return out


def labels(text: str) -> dict[str, str]:
    """What the comment after an object's id calls it, the first time."""
    out: dict[str, str] = {}
    for m in _LABEL.finditer(text):
        out.setdefault(m[1], m[2])
    return out


def parse(words: list[str]) -> object:
    """The value that *words* write: dictionaries, lists and strings. What is cut off ends where the words do."""
    stack: list = []
    value: object = None
    key: str | None = None
    keys: list = []
    for w in words:
        if w in ("{", "("):
            stack.append({} if w == "{" else [])
            keys.append(key)
            key = None
            continue
        if w in ("}", ")") and stack:
            value, key = stack.pop(), keys.pop()
        elif w in ("=", ";", ","):
            continue
        elif stack and isinstance(stack[-1], dict) and key is None:
            key = w
            continue
        else:
            value = w
        if stack and isinstance(stack[-1], dict) and key is not None:
            stack[-1][key], key = value, None
        elif stack and isinstance(stack[-1], list):
            stack[-1].append(value)
    return value if not stack else stack[0]


def objects(projects: DataFrame) -> DataFrame:
    """(path, id, key, place, value): a row for each value of each object, the entries of a list by their place, and its label under the key `label`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = parts(text or "")
                root = parse(words if words[:1] == ["{"] else ["{", *words, "}"])
                found = root.get("objects", root) if isinstance(root, dict) else {}
                rows += [(path, name, "label", 0, label) for name, label in labels(text or "").items()]
                for name, fields in (found.items() if isinstance(found, dict) else ()):
                    for key, value in (fields.items() if isinstance(fields, dict) else ()):
                        rows += [(path, name, key, i, v) for i, v in enumerate(value if isinstance(value, list) else [value]) if isinstance(v, str)]
            if rows:
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "id", "key", "place", "value"])

    return projects.select("path", "text").mapInArrow(work, "path string, id string, key string, place int, value string")


def _of(rows: DataFrame, kind: str, key: str, name: str, value: str) -> DataFrame:
    """(path, *name*, *value*): the values that objects of a kind have under a key."""
    ids = rows.filter((F.col("key") == "isa") & (F.col("value") == kind)).select("path", "id")
    return rows.filter(F.col("key") == key).join(ids, ["path", "id"], "left_semi").select("path", F.col("id").alias(name), F.col("value").alias(value))


def target_files(projects: DataFrame, suffix: str = ".swift") -> DataFrame:
    """(path, target, file, file_name) of the sources that each target of a project builds.

    A target names its phases, a phase of sources its build files, and a build file its reference, whose path counts, else
    its name, else the label of the build file. A target without a name goes by its label.
    """
    rows = cut(objects(projects))
    label = rows.filter("key = 'label'").select("path", F.col("id").alias("build"), F.regexp_replace("value", " in Sources$", "").alias("label"))
    names = _of(rows, "PBXNativeTarget", "isa", "target_id", "_isa").drop("_isa").join(_of(rows, "PBXNativeTarget", "name", "target_id", "name"), ["path", "target_id"], "left")
    names = names.join(label.withColumnsRenamed({"build": "target_id", "label": "own"}), ["path", "target_id"], "left").select("path", "target_id", F.coalesce("name", "own").alias("target"))
    phases = _of(rows, "PBXNativeTarget", "buildPhases", "target_id", "phase")
    built = _of(rows, "PBXSourcesBuildPhase", "files", "phase", "build")
    refs = _of(rows, "PBXBuildFile", "fileRef", "build", "ref")
    at, named = _of(rows, "PBXFileReference", "path", "ref", "at"), _of(rows, "PBXFileReference", "name", "ref", "named")
    d = names.join(phases, ["path", "target_id"]).join(built, ["path", "phase"]).join(refs, ["path", "build"], "left").join(at, ["path", "ref"], "left").join(named, ["path", "ref"], "left").join(label, ["path", "build"], "left")
    file = F.coalesce("at", "named", "label")
    return d.select("path", "target", file.alias("file"), T.last_part(file).alias("file_name")).filter(F.col("file").endswith(suffix))


def targets_of_files(built: DataFrame) -> DataFrame:
    """(file, targets): the targets of each file, sorted."""
    return built.groupBy("file").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def orphans(files: DataFrame, built: DataFrame) -> DataFrame:
    """Source files that no target builds, by file name."""
    return files.join(built.select("file_name").distinct(), "file_name", "left_anti")
