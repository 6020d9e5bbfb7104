"""Facts over syntax nodes and lines: each is a filter and a projection, counters are one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import text as T

# The names, markers and limits that the rules look for, in order of precedence.
SINGLETONS = ["Account.sharedInstance", "LoginData.sharedInstance", "AccountAuthenticate.sharedInstance", "Network.sharedInstance", "LongevityScore.sharedInstance", "SplashScreen.sharedInstance", "TimeLogging.sharedInstance"]
REFERENCES = [*[(s, "globalSingleton") for s in SINGLETONS], ("UserDefaults.standard", "userDefaults"), ("UserDefaults()", "userDefaults"), ("NotificationCenter.default", "notificationCenter"), ("AWSCognitoIdentityUser", "cognito"), ("pool?.currentUser", "cognito"), ("pool?.getUser", "cognito"), ("Keychain", "keychain"), ("keychain", "keychain")]
MARKERS = [("TODO:", "TODO"), ("TODO(", "TODO"), ("FIXME:", "FIXME"), ("FIXME(", "FIXME"), ("HACK:", "HACK"), ("HACK(", "HACK"), ("WARNING:", "WARNING"), ("BUG:", "BUG"), ("NOTE:", "NOTE"), ("OPTIMIZE:", "OPTIMIZE"), ("DEPRECATED:", "DEPRECATED"), ("XXX:", "HACK"), ("TEMP:", "HACK"), ("TEMPORARY:", "HACK")]
RAW_TYPES = ["String", "Int", "Int8", "Int16", "Int32", "Int64", "UInt", "UInt8", "UInt16", "UInt32", "UInt64", "Double", "Float", "Character", "Bool"]
PROTOCOLS = ["Codable", "Equatable", "Hashable", "Comparable", "Identifiable", "ObservableObject", "View", "Sendable", "Error"]
URL_PARTS = ["/api/", "/v1/", "/v2/", "/user/", "/auth/", "/login", "/logout", "/tests", "/appointments", "/locations", "/physicians"]
VERBS = [("GET", "GET"), (".get", "GET"), ("POST", "POST"), (".post", "POST"), ("PUT", "PUT"), (".put", "PUT"), ("DELETE", "DELETE"), (".delete", "DELETE"), ("PATCH", "PATCH"), (".patch", "PATCH")]
CONTAINERS = ["NavigationView", "NavigationStack", "List", "Form", "VStack", "HStack", "ZStack", "LazyVStack", "LazyHStack", "ScrollView", "TabView", "Sheet", "Alert"]
UI_ELEMENTS = ["UIButton", "UILabel", "UIImageView", "UITextField", "UITextView", "UISwitch", "UISlider", "UISegmentedControl", "UITableViewCell", "UICollectionViewCell", "Button", "Text", "Image", "TextField"]
ACCESSIBILITY = ["accessibilityLabel", "accessibilityHint", "accessibilityValue", "accessibilityIdentifier", "accessibilityTraits", "accessibilityFrame", "isAccessibilityElement", "accessibilityElementsHidden", "shouldGroupAccessibilityChildren", "accessibilityViewIsModal"]
LOCKS = ["NSLock", "NSRecursiveLock", "DispatchSemaphore", "OSAllocatedUnfairLock"]
LOCALIZED = [".localize()", "NSLocalizedString", "LocalizedStringKey", 'Text("', 'Label("', ".localized", "L10n.", "Strings."]
EXPANSIONS = {"auth": "authentication", "btn": "button", "vc": "viewcontroller", "vm": "viewmodel", "mgr": "manager", "ctx": "context", "req": "request", "res": "response", "cfg": "config", "init": "initialize"}
ATTRIBUTES = [
    "@MainActor", "@globalActor", "@Sendable", "@nonisolated", "@available", "@unavailable", "@discardableResult", "@inlinable", "@usableFromInline", "@objc", "@objcMembers", "@nonobjc", "@escaping", "@autoclosure", "@convention",
    "@frozen", "@unknown", "@IBAction", "@IBOutlet", "@IBDesignable", "@IBInspectable", "@testable", "@_exported", "@dynamicMemberLookup", "@dynamicCallable", "@propertyWrapper", "@resultBuilder", "@preconcurrency", "@unchecked",
]
WRAPPERS = ["@State", "@Binding", "@ObservedObject", "@StateObject", "@EnvironmentObject", "@Environment", "@Published", "@FocusState", "@GestureState", "@SceneStorage", "@AppStorage", "@FetchRequest", "@Query", "@Inject", "@Dependency", "@Default", "@UserDefault", "@Persisted", "@Realm"]
SEVERITY = {"force_unwrap": "critical", "force_cast": "critical", "force_try": "critical", "implicitly_unwrapped": "high", "empty_catch": "high", "deep_nesting": "medium", "long_parameter_list": "medium", "print_statement": "low", "magic_number": "low"}
LAYER_PATHS = [(["/network/", "/api/", "/service"], "network"), (["/view/", "/controller/", "/ui/"], "ui"), (["/storage/", "/persistence/", "/cache/", "/keychain"], "persistence"), (["/model/", "/entity/", "/domain/"], "domain")]
MAX_PARAMS, MAX_DEPTH, LONG_FUNCTION, HIGH_COMPLEXITY = 5, 4, 50, 10

TYPE_KINDS = ["ClassDecl", "StructDecl", "EnumDecl", "ProtocolDecl", "ExtensionDecl", "ActorDecl"]
#: The kinds that the rules of smells and the chunks look at.
SMELL_KINDS = ["ForceUnwrapExpr", "AsExpr", "TryExpr", "ImplicitlyUnwrappedOptionalType", "CatchClause", "FunctionCallExpr", "FunctionDecl", "IfExpr", "IntegerLiteralExpr"]
CHUNK_KINDS = ["FunctionDecl", "InitializerDecl", "ClassDecl", "StructDecl", "EnumDecl", "ProtocolDecl", "ActorDecl"]


def _has(c: str | Column, parts: list[str]) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def smell() -> Column:
    """The smell that a node is, or null."""
    k = F.col("kind")
    number = F.col("literal").try_cast("int")
    return (
        F.when(k == "ForceUnwrapExpr", "force_unwrap")
        .when((k == "AsExpr") & F.col("bang"), "force_cast")
        .when((k == "TryExpr") & F.col("bang"), "force_try")
        .when((k == "ImplicitlyUnwrappedOptionalType") & ~F.coalesce(F.col("parent_text"), F.lit("")).contains("@IBOutlet"), "implicitly_unwrapped")
        .when((k == "CatchClause") & (F.col("literal") == ""), "empty_catch")
        .when((k == "FunctionCallExpr") & F.col("callee").isin("print", "debugPrint", "dump") & ~F.col("in_debug"), "print_statement")
        .when((k == "FunctionDecl") & (F.size("params") > MAX_PARAMS), "long_parameter_list")
        .when((k == "IfExpr") & (F.col("if_depth") > MAX_DEPTH) & ~F.col("is_else_if"), "deep_nesting")
        .when((k == "IntegerLiteralExpr") & (number > 2) & ~number.isin(10, 100) & ~_has(F.coalesce("base", F.lit("")), ["let ", "static "]), "magic_number")
    )


def smells(nodes: DataFrame) -> DataFrame:
    """(path, line, kind, severity, code, context) of every code smell, in one pass over the nodes."""
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    out = nodes.withColumn("smell", smell()).filter("smell is not null")
    return out.select("path", F.col("pos_line").alias("line"), F.col("smell").alias("kind"), severity[F.col("smell")].alias("severity"), F.substring("text", 1, 50).alias("code"), F.col("ctx_func").alias("context"))


def debt(lines: DataFrame) -> DataFrame:
    """(path, line, kind, message, context) of the markers in comment lines; the context is the last function above."""
    trimmed = F.trim("line")
    upper_ascii = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(F.col("line").contains("("), F.nullif(F.regexp_extract("line", r"func\s+(\w+)", 1), F.lit("")))
    upper = F.translate(trimmed, *upper_ascii)  # as long as the line, whatever letters it has
    payload = F.lit(None).cast("string")
    for fragment, _ in reversed(MARKERS):
        at = F.locate(fragment, upper)
        payload = F.when(at > 0, F.substring(trimmed, at + len(fragment), F.lit(2**31 - 1))).otherwise(payload)
    rows = lines.select("path", "line_no", F.last(name, ignorenulls=True).over(w).alias("context"), T.first_match(upper, MARKERS).alias("kind"), payload.alias("payload"), trimmed.alias("t"))
    rows = rows.filter(F.col("kind").isNotNull() & F.col("t").rlike(r"^(//|/\*|\*)"))
    return rows.select("path", F.col("line_no").alias("line"), "kind", F.trim(F.replace(F.substring(F.trim("payload"), 1, 200), F.lit("*/"), F.lit(""))).alias("message"), "context")


def function_metrics(nodes: DataFrame) -> DataFrame:
    """A row for each function outside other functions; is_god marks the long or complex ones."""
    return nodes.filter("kind = 'FunctionDecl' and func_id is null").select("path", "name", F.col("pos_line").alias("line"), n_lines().alias("line_count"), "complexity", F.size("params").alias("n_params"), "is_async", "throws", is_god().alias("is_god"))


def n_lines() -> Column:
    return F.col("end_line") - F.col("pos_line") + 1


def is_god() -> Column:
    """Whether a function is long or complex."""
    return (n_lines() > LONG_FUNCTION) | (F.col("complexity") > HIGH_COMPLEXITY)


def imports(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'ImportDecl'").select("path", F.col("name").alias("module")).distinct()


def references(nodes: DataFrame) -> DataFrame:
    """(path, line, symbol, kind, context) of global state that members and calls touch; the first rule that fits."""
    return nodes.withColumn("reference", reference()).filter("reference is not null").select("path", F.col("pos_line").alias("line"), F.col("text").alias("symbol"), F.col("reference").alias("kind"), F.col("ctx_func").alias("context"))


def reference() -> Column:
    """The kind of global state that a member or call touches, or null."""
    return F.when(F.col("kind").isin("MemberAccessExpr", "FunctionCallExpr"), T.first_match(F.col("text"), REFERENCES))


def reference_files(nodes: DataFrame) -> DataFrame:
    """(path, imports, n_references) of files that import something or touch global state."""
    i = imports(nodes).groupBy("path").agg(F.array_sort(F.collect_set("module")).alias("imports"))
    r = references(nodes).groupBy("path").agg(F.count("*").alias("n_references"))
    return i.join(r, "path", "full").na.fill(0, ["n_references"])


def type_definitions(nodes: DataFrame) -> DataFrame:
    """(name, kind, path, line, visibility, conformances, superclass); raw-value types are no conformances."""
    conformances = F.filter("inherits", lambda x: ~x.isin(RAW_TYPES))
    parents = F.filter("inherits", lambda x: ~x.isin(PROTOCOLS) & ~x.rlike("(Protocol|Delegate)$"))
    return nodes.filter(F.col("kind").isin(TYPE_KINDS)).select("name", F.lower(F.replace("kind", F.lit("Decl"), F.lit(""))).alias("kind"), "path", F.col("pos_line").alias("line"), "visibility", conformances.alias("conformances"), F.when(F.col("kind") == "ClassDecl", F.get(parents, F.lit(0))).alias("superclass"))


def api_symbols(nodes: DataFrame) -> DataFrame:
    """Functions, initialisers and properties that stand in types or at the top, with signatures."""
    rows = nodes.filter(F.col("kind").isin("FunctionDecl", "InitializerDecl", "VariableDecl", "SubscriptDecl") & F.col("func_id").isNull())
    return rows.select("path", "ctx_type", "kind", "name", "visibility", "params", F.coalesce("return_type", F.when(F.col("kind") == "VariableDecl", "Unknown")).alias("type"), F.array_contains("modifiers", "static").alias("is_static"), F.array_contains("modifiers", "var").alias("is_mutable"), (F.col("literal") == "computed").alias("is_computed"), "is_async", "throws", "signature")


def documentation(nodes: DataFrame) -> DataFrame:
    """Whether public and open symbols have a doc comment, and which parts of it."""
    doc = F.array_join("doc", "\n")
    rows = nodes.filter(F.col("kind").isin(*TYPE_KINDS, "FunctionDecl", "InitializerDecl", "VariableDecl") & F.col("visibility").isin("public", "open") & F.col("func_id").isNull())
    return rows.select("path", "kind", "name", F.col("pos_line").alias("line"), (F.size("doc") > 0).alias("documented"), doc.contains("Parameter").alias("has_params"), doc.contains("Returns").alias("has_returns"), doc.contains("Throws").alias("has_throws"))


def endpoints(nodes: DataFrame) -> DataFrame:
    """String literals that look like endpoints, with the verb that the surrounding node names."""
    return nodes.filter(is_endpoint()).select("path", F.col("pos_line").alias("line"), F.col("literal").alias("endpoint"), T.first_match(F.coalesce("parent_text", F.lit("")), VERBS).alias("verb"), F.col("ctx_func").alias("context"))


def is_endpoint() -> Column:
    return (F.col("kind") == "StringLiteralExpr") & _has("literal", URL_PARTS)


def delegates(nodes: DataFrame) -> DataFrame:
    """Delegate and data-source properties; those that are not weak are retain-cycle risks."""
    return nodes.filter((F.col("kind") == "VariableDecl") & F.lower("name").rlike("(delegate|datasource)$") & F.col("func_id").isNull()).select("path", F.col("pos_line").alias("line"), "name", "ctx_type", F.array_contains("modifiers", "weak").alias("is_weak"))


def captures(nodes: DataFrame) -> DataFrame:
    """Closures and how they hold self."""
    held = F.coalesce("literal", F.lit(""))
    return nodes.filter("kind = 'ClosureExpr'").select("path", F.col("pos_line").alias("line"), F.col("text").contains("self").alias("uses_self"), held.contains("weak").alias("is_weak"), held.contains("unowned").alias("is_unowned"), F.col("ctx_func").alias("context"))


def literals(nodes: DataFrame) -> DataFrame:
    """String literals of three letters or more and whether they are localised."""
    return nodes.filter((F.col("kind") == "StringLiteralExpr") & (F.length("literal") >= 3)).select("path", F.col("pos_line").alias("line"), F.col("literal"), _has(F.coalesce("parent_text", F.lit("")), LOCALIZED).alias("is_localized"))


def counters(nodes: DataFrame) -> DataFrame:
    """One row for each file with the counters of all framework audits: one aggregation, combined map-side."""
    k, member = F.col("kind"), F.col("member")
    call, access, attr = k == "FunctionCallExpr", k == "MemberAccessExpr", F.coalesce("attrs", F.array().cast("array<string>"))
    wrapper = lambda w: (k == "VariableDecl") & F.exists(attr, lambda a: a.rlike(rf"^@{w}(\(|$)"))
    rules = {
        "main_queue": access & F.col("text").endswith("DispatchQueue.main"), "global_queue": call & F.col("callee").endswith("DispatchQueue.global"), "main_sync": access & F.col("text").endswith("DispatchQueue.main.sync"),
        "tasks": call & (F.col("callee") == "Task"), "main_actor": F.exists(attr, lambda a: a == "@MainActor"), "sendable": F.exists(attr, lambda a: a == "@Sendable"), "locks": call & F.col("callee").isin(LOCKS),
        "subscribe": call & (member == "subscribe"), "bind": call & (member == "bind"), "drive": call & (member == "drive"), "sink": call & (member == "sink"), "assign": call & (member == "assign"), "dispose_bags": call & (F.col("callee") == "DisposeBag"),
        "state": wrapper("State"), "binding": wrapper("Binding"), "observed_object": wrapper("ObservedObject"), "state_object": wrapper("StateObject"), "environment_object": wrapper("EnvironmentObject"), "environment": wrapper("Environment"), "published": wrapper("Published"),
        "containers": (k == "TypeReference") & F.col("name").isin(CONTAINERS), "views": (k == "StructDecl") & F.array_contains("inherits", "View"), "view_controllers": (k == "ClassDecl") & F.exists("inherits", lambda x: x.endswith("ViewController")),
        "outlets": F.exists(attr, lambda a: a == "@IBOutlet"), "actions": F.exists(attr, lambda a: a == "@IBAction"), "managed": F.exists(attr, lambda a: a == "@NSManaged"), "fetch_requests": (k == "TypeReference") & (F.col("name") == "NSFetchRequest"),
        "timers": call & F.col("callee").startswith("Timer."), "observers": call & (member == "addObserver"), "ui_elements": call & member.isin(UI_ELEMENTS), "accessibility": access & member.isin(ACCESSIBILITY), "assertions": call & F.col("callee").startswith("XCT"),
        "test_functions": (k == "FunctionDecl") & F.col("name").startswith("test"), "functions": k == "FunctionDecl", "classes": k == "ClassDecl",
    }
    return nodes.groupBy("path").agg(*[F.count_if(c).alias(n) for n, c in rules.items()])


def calls_to(nodes: DataFrame, pattern: str) -> DataFrame:
    """Calls that fit `receiver.method`, `*.method`, `receiver.*` or a bare method."""
    receiver, _, method = pattern.rpartition(".")
    fits = (F.col("member") == method) if method != "*" else F.lit(True)
    if receiver and receiver != "*":
        fits = fits & F.col("callee").contains(receiver + ".")
    elif receiver == "*":
        fits = fits & F.col("callee").contains(".")
    return nodes.filter((F.col("kind") == "FunctionCallExpr") & fits).select("path", F.col("pos_line").alias("line"), "callee", F.substring("text", 1, 150).alias("code"), F.col("ctx_func").alias("context"))


def usages(nodes: DataFrame, symbol: str) -> DataFrame:
    """Where a symbol is inherited from, called, accessed or named."""
    k = F.col("kind")
    how = (
        F.when(k.isin(TYPE_KINDS) & (F.get("inherits", F.lit(0)) == symbol), "inherits")
        .when(k.isin(TYPE_KINDS) & F.array_contains("inherits", symbol), "conforms")
        .when((k == "FunctionCallExpr") & (F.col("callee").isin(symbol) | F.col("callee").endswith("." + symbol)), "calls")
        .when((k == "MemberAccessExpr") & (F.col("member") == symbol), "accesses")
        .when((k == "TypeReference") & (F.col("name") == symbol), "type_reference")
        .when((k == "DeclReferenceExpr") & (F.col("name") == symbol), "references")
    )
    return nodes.withColumn("how", how).filter("how is not null").select("path", F.col("pos_line").alias("line"), "how", F.substring("text", 1, 60).alias("code"))


def layer(path: Column, name: Column) -> Column:
    """The layer of a chunk: by folders first, then by its name."""
    p = F.lower(path)
    out = None
    for parts, label in LAYER_PATHS:
        out = F.when(_has(p, parts), label) if out is None else out.when(_has(p, parts), label)
    return (
        out.when(name.rlike("(ViewController|View|Cell)$"), "ui").when(name.rlike("(Service|API)$|Network"), "network")
        .when(name.rlike("(Storage|Repository)$|Keychain"), "persistence").otherwise("business-logic")
    )


def keywords(name: Column) -> Column:
    """Words of a name of three letters or more, short forms written out."""
    table = F.create_map(*[F.lit(x) for kv in EXPANSIONS.items() for x in kv])
    words = F.split(F.lower(F.regexp_replace(name, r"(?<=.)(\p{Lu})", " $1")), " ")
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.coalesce(table[w], w)), lambda w: F.length(w) > 2))


def chunks(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each type, function, method and initialiser, with what it calls and names.

    Calls, type names and imports come with the nodes and the folder follows from the path, so *files* is not read: Spark
    takes a parser's output to be as small as the keys below it and would send a side of a join to the driver.
    """
    d = nodes.filter(F.col("kind").isin(CHUNK_KINDS) & F.col("path").isNotNull())
    none = F.array().cast("array<string>")
    kind = F.when(F.col("kind") == "InitializerDecl", "initializer").when((F.col("kind") == "FunctionDecl") & F.col("ctx_type").isNotNull() & (F.col("ctx_type_kind") != "ExtensionDecl"), "method").when(F.col("kind") == "FunctionDecl", "function").otherwise(F.lower(F.replace("kind", F.lit("Decl"), F.lit(""))))
    takes = F.transform(F.coalesce("params", F.from_json(F.lit("[]"), "array<struct<label:string,name:string,type:string,has_default:boolean>>")), lambda p: p["name"])
    body = F.coalesce("body", F.lit(""))
    patterns = F.array_compact(F.array(
        F.when(F.coalesce(F.col("signature"), F.lit("")).contains("async") | body.contains("await "), "async-await"), F.when(F.col("throws"), "throws"),
        F.when(F.col("kind").isin("FunctionDecl", "InitializerDecl") & _has(F.coalesce("signature", F.lit("")), ["completion", "handler", "callback"]), "callback"),
    ))
    raw = F.concat_ws("\n", F.array_join("comments", "\n"), "text")  # comments before a declaration count as part of it
    held = lambda names: F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(raw, n))
    return d.select(
        F.concat_ws(":", "path", "pos_line").alias("id"), F.col("path").alias("file"), F.col("pos_line").alias("line"), "end_line", "name", kind.alias("kind"), F.when(~F.col("ctx_type_kind").eqNullSafe("ExtensionDecl"), F.col("ctx_type")).alias("parent_type"), T.module_path(F.col("path")).alias("module_path"), "signature",
        takes.alias("parameters"), "return_type", F.nullif(F.array_join("doc", "\n"), F.lit("")).alias("doc_comment"), F.coalesce("calls", none).alias("calls"), F.coalesce("types", none).alias("uses_types"),
        F.coalesce("inherits", none).alias("conforms_to"), F.when(F.col("kind") == "InitializerDecl", 1).otherwise(F.when(F.col("kind") == "FunctionDecl", F.col("complexity"))).alias("complexity"), (F.col("end_line") - F.col("pos_line") + 1).alias("line_count"),
        "visibility", raw.contains("static let shared").alias("is_singleton"), F.coalesce(F.col("body").contains("!") & ~F.col("body").contains("!="), F.lit(False)).alias("has_smells"), raw.contains("TODO").alias("has_todo"),
        held(ATTRIBUTES).alias("attributes"), F.array_sort(held(WRAPPERS)).alias("property_wrappers"),
        keywords(F.col("name")).alias("keywords"), layer(F.col("path"), F.col("name")).alias("layer"), F.coalesce("imports", none).alias("imports"), patterns.alias("patterns"),
    )


def called_by(chunks: DataFrame) -> DataFrame:
    """Adds called_by: the ids of the chunks that call this bare name."""
    caller = F.concat_ws(".", F.coalesce("parent_type", F.lit("")), "name")
    edges = chunks.select(caller.alias("caller"), F.explode("calls").alias("name")).distinct()
    back = edges.groupBy("name").agg(F.array_sort(F.collect_set("caller")).alias("called_by"))
    return chunks.join(back, "name", "left").withColumn("called_by", F.coalesce("called_by", F.array().cast("array<string>")))


def embedding_text(chunks: DataFrame) -> Column:
    """The text that stands for a chunk in the vector index; calls and callers are given up to ten."""
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label + ": "), F.array_join(c, ", ")))
    c = F.col
    purpose = F.coalesce("purpose", "doc_comment") if "purpose" in chunks.columns else c("doc_comment")
    callers = part("Called by", F.slice("called_by", 1, 10)) if "called_by" in chunks.columns else F.lit(None).cast("string")
    return F.concat_ws(
        "\n", F.concat(F.concat_ws(".", "parent_type", "name"), F.lit(" in "), c("module_path")), F.concat(F.lit("Purpose: "), purpose), F.concat(F.lit("Signature: "), c("signature")), part("Calls", F.slice("calls", 1, 10)), callers,
        part("Domain", c("keywords")), F.concat(F.lit("Layer: "), c("layer")), part("Uses", c("imports")), part("Attributes", c("attributes")), part("PropertyWrappers", c("property_wrappers")), part("Patterns", c("patterns")),
        F.concat(F.when(c("complexity").isNotNull(), F.concat(F.lit("Complexity: "), c("complexity"), F.lit(", "))).otherwise(""), F.lit("Lines: "), c("line_count")),
    )
