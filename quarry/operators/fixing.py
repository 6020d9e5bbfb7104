"""Fix suggestions for code smells, and advice for compiler messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Advice by what a compiler message contains, in order of precedence.
MESSAGES = [
    (["cannot convert value of type", "Optional"], "Use optional binding (if let/guard let) or nil coalescing (??) to unwrap"), (["value of optional type", "not unwrapped"], "Add '?' for optional chaining or '!' for force unwrap (unsafe)"),
    (["cannot find", "in scope"], "Check spelling, add import, or ensure the type/function is accessible"), (["missing argument"], "Add the missing required parameter"), (["extra argument"], "Remove the extra parameter or check function signature"),
    (["type annotation missing"], "Add explicit type annotation"), (["ambiguous use of"], "Add explicit type annotation to resolve ambiguity"), (["protocol", "requires"], "Implement the missing protocol requirement"),
    (["initializer", "inaccessible"], "Use a public initializer or make the type's init accessible"),
]
#: The smells that have a fix, and the reasons why there is none.
FIXABLE = ["force_unwrap", "force_cast", "force_try", "empty_catch", "implicitly_unwrapped"]
NO_LINE, NO_FILE, NO_SUCH_LINE = "No line number available", "Could not read source file", "Line number out of range"

#: Fixed value: how an assignment to a new name begins.
_ASSIGNED = r"(?:let|var)\s+(\w+)\s*=\s*"


def message_advice(message: Column) -> Column:
    """What to do about a compiler message, or null."""
    out = None
    for parts, text in MESSAGES:
        hit = F.lit(True)
        for p in parts:
            hit = hit & message.contains(p)
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out


def suggestions(smells: DataFrame, files: DataFrame) -> DataFrame:
    """*smells* with can_fix, original, fixed, confidence, explanation and reason.

    *smells* has path, line (may be null) and kind; *files* path and text. The whole line is rewritten, its indent kept: an
    assignment gets a guard or a do block, anything else the shorter form at low confidence. Four things stand in the way of
    a fix: no line, no such file, no such line, no rule for the smell. The files are joined by their path, and only the line goes on.
    """
    names = ["original", "can_fix", "fixed", "confidence", "explanation", "reason"]
    known = files.select("path", F.lit(True).alias("_known"), "text")
    d = smells.drop(*[n for n in names if n in smells.columns]).join(known, "path", "left").withColumn("_lines", F.split("text", "\n"))
    d = d.withColumn("original", F.when(F.col("line") > 0, F.get("_lines", F.col("line") - 1))).drop("text", "_lines")
    line, kind = F.coalesce("original", F.lit("")), F.col("kind")
    body, indent = F.trim(line), F.regexp_extract(line, r"^[ \t]*", 0)
    group = lambda p, i: F.trim(F.regexp_extract(body, p, i))

    unwrap, cast, tried = _ASSIGNED + "(.+)!", _ASSIGNED + r"(.+)\s+as!\s+(\w+)", _ASSIGNED + r"try!\s*(.+)"
    bang = body.contains("!") & ~body.contains("!=")
    block = F.concat(indent, F.lit("do {\n"), indent, F.lit("    let "), group(tried, 1), F.lit(" = try "), group(tried, 2), F.lit("\n"), indent, F.lit("} catch {\n"), indent, F.lit("    // Handle error\n"), indent, F.lit("    return\n"), indent, F.lit("}"))
    caught = F.concat(indent, F.lit("} catch {\n"), indent, F.lit("    // TODO: Handle error appropriately\n"), indent, F.lit('    print("Error: \\(error)")\n'), indent, F.lit("}"))
    guarded = lambda name, value: F.concat(indent, F.lit("guard let "), name, F.lit(" = "), value, F.lit(" else { return }"))
    rules = [
        ((kind == "force_unwrap") & body.rlike(unwrap), guarded(group(unwrap, 1), group(unwrap, 2)), "medium", "Replace force unwrap with guard let. Adjust the else clause as needed (return, throw, continue, etc.)"),
        ((kind == "force_unwrap") & bang, F.replace(line, F.lit("!"), F.lit(" ?? <#default#>")), "low", "Replace force unwrap with nil coalescing. Provide an appropriate default value."),
        ((kind == "force_cast") & body.rlike(cast), guarded(group(cast, 1), F.concat(group(cast, 2), F.lit(" as? "), group(cast, 3))), "medium", "Replace force cast with conditional cast and guard. Adjust the else clause as needed."),
        ((kind == "force_cast") & body.contains(" as! "), F.replace(line, F.lit(" as! "), F.lit(" as? ")), "low", "Replace force cast with conditional cast. Handle the optional result appropriately."),
        ((kind == "force_try") & body.rlike(tried), block, "medium", "Replace try! with do-catch block. Implement proper error handling."),
        ((kind == "force_try") & body.contains("try!"), F.replace(line, F.lit("try!"), F.lit("try?")), "low", "Replace try! with try? Handle the optional result or use do-catch for proper error handling."),
        (kind == "empty_catch", caught, "medium", "Add error handling to the catch block. At minimum, log the error."),
        ((kind == "implicitly_unwrapped") & bang, F.replace(line, F.lit("!"), F.lit("?")), "medium", "Replace implicitly unwrapped optional with regular optional. Update usage sites to handle nil."),
    ]
    refusal = (
        F.when(F.col("line").isNull(), NO_LINE).when(F.col("_known").isNull(), NO_FILE).when(F.col("original").isNull(), NO_SUCH_LINE)
        .when(~kind.isin(FIXABLE), F.concat(F.lit("No auto-fix available for "), kind))
    )
    fix = None
    for hit, fixed, confidence, text in rules:
        one = F.struct(fixed.alias("fixed"), F.lit(confidence).alias("confidence"), F.lit(text).alias("explanation"))
        fix = F.when(hit, one) if fix is None else fix.when(hit, one)
    d = d.withColumn("_why", refusal).withColumn("_fix", F.when(F.col("_why").isNull(), fix))
    reason = F.coalesce("_why", F.when(F.col("_fix").isNull(), F.concat(F.lit("Could not parse "), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" pattern"))))
    keep = [c for c in d.columns if c not in ("_known", "_why", "_fix", "original")]
    return d.select(*keep, "original", F.col("_fix").isNotNull().alias("can_fix"), "_fix.fixed", "_fix.confidence", "_fix.explanation", reason.alias("reason"))
