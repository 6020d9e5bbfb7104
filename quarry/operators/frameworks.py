"""Framework audits as rows over syntax nodes, their counters and scores.

An audit is a list of rules; findings() evaluates all of them in one pass and gives a row for each that
fits a node. Counters are conditional counts, combined map-side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import facts
from quarry.operators import text as T

# Names that the audits look for.
SHARED = ["Account.sharedInstance()", "UserDefaults.standard", "NotificationCenter.default", "FileManager.default", "URLSession.shared"]
NETWORK_KEYWORDS = ["URLSession", "URLRequest", "Alamofire", "AF.", "Moya", "dataTask", "downloadTask", "uploadTask", "RxAlamofire", "rx.request", "rx.data", "httpMethod", "HTTPMethod"]
NETWORK_KINDS = {"URLSession": "Apple's native networking", "URLRequest": "URL request construction", "Alamofire": "Alamofire HTTP client", "AF.": "Alamofire HTTP client", "Moya": "Moya network abstraction", "RxAlamofire": "Reactive Alamofire", "dataTask": "URLSession data task", "rx.request": "RxSwift network extension", "rx.data": "RxSwift network extension"}
TECHNICAL = ["http", "https", "/", ".", "_", "com.", "identifier", "cell", "segue", "storyboard", "nib", "xib", "png", "jpg", "json", "xml", "plist", "key", "id", "uuid"]
UI_WORDS = ["button", "label", "title", "message", "error", "success", "please", "enter", "select"]
ACCOUNT = ["name", "email", "dob", "phone", "pwd", "accessToken", "dataAccessToken", "cognitoAccessToken", "cognitoRefreshToken", "cognitoAccessTokenExpiration", "user", "refreshWithUser", "getToken", "logoutUser", "loadBackendData", "dataLogin"]
AUTHENTICATE = ["pool", "signedIn", "loginView"]
LOGIN = ["user", "signedIn", "checkIfLoggedIn", "lastLogin"]
SDK = ["AWSCognitoIdentityUser", "AWSCognitoIdentityUserPool", "getSession", "getDetails", "isSignedIn", "signOut"]
USER_MEMBERS = ["isSignedIn", "getSession", "getDetails", "signOut", "delete"]
#: Advice for a property, and what may stand in its place.
ADVICE = {
    "HIGH PRIORITY: Replace with AuthManager.currentValidToken()": ["Account.dataAccessToken", "Account.accessToken", "Account.cognitoAccessToken"],
    "MEDIUM: Read from AuthManager.currentProfile or Keychain": ["Account.name", "Account.email", "Account.dob", "Account.phone"],
    "HIGH: Remove direct Cognito access, use AuthManager": ["Account.user", "CognitoUser.isSignedIn", "CognitoUser.getSession"],
    "HIGH: Replace with AuthManager.validateTokens()": ["Account.refreshWithUser", "Account.getToken"],
    "MEDIUM: Replace with AuthManager.logout()": ["Account.logoutUser"],
    "MEDIUM: Replace with AuthManager.isCurrentlyLoggedIn()": ["LoginData.checkIfLoggedIn", "LoginData.signedIn"],
}
SDK_ADVICE, OTHER_ADVICE = "HIGH: Encapsulate in CognitoService, not direct SDK calls", "Review and migrate to AuthManager"
REPLACEMENTS = {
    "Account.dataAccessToken": "AuthManager.shared.currentValidToken()", "Account.accessToken": "AuthManager.shared.currentValidToken()", "Account.cognitoAccessToken": "AuthManager.shared.cachedToken",
    "Account.name": "KeychainTokenStorage.shared.loadUserProfile()?.name", "Account.email": "KeychainTokenStorage.shared.loadUserProfile()?.email", "Account.dob": "KeychainTokenStorage.shared.loadUserProfile()?.dob", "Account.phone": "KeychainTokenStorage.shared.loadUserProfile()?.phone",
    "Account.refreshWithUser": "await AuthManager.shared.validateTokens()", "Account.getToken": "await AuthManager.shared.validateTokens()", "Account.logoutUser": "await AuthManager.shared.logout()", "LoginData.checkIfLoggedIn": "AuthManager.shared.isCurrentlyLoggedIn()",
    "CognitoUser.isSignedIn": "AuthManager.shared.isCurrentlyLoggedIn()", "Cognito.isSignedIn": "AuthManager.shared.isCurrentlyLoggedIn()", "CognitoUser.getSession": "Use CognitoService.refreshSession()", "Cognito.getSession": "Use CognitoService.refreshSession()",
    "CognitoUser.signOut": "await AuthManager.shared.logout()", "Cognito.signOut": "await AuthManager.shared.logout()",
}
OTHER_REPLACEMENT = "// TODO: Migrate to AuthManager"
#: Limits of the audits.
MANY_STATES, MASSIVE_LINES, TAP_LIMIT = 5, 500, 10

MEMBER = "member"


@dataclass
class Rule:
    """An issue, its severity, when a node has it, and what is said about it."""

    issue: str
    severity: str
    when: Column
    detail: Column | None = None


def _kind(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _calls(*parts: str) -> Column:
    return _kind("FunctionCallExpr") & facts._has(_text("callee"), list(parts))


def _attr(name: str) -> Column:
    return _kind("Attribute") & _text("text").contains(name)


def _fitting(rules: list[Rule]) -> Column:
    """The issues of the rules that fit a node, as an array."""
    return F.array_compact(F.array(*[F.when(r.when, F.struct(F.lit(r.issue).alias("issue"), F.lit(r.severity).alias("severity"), (r.detail if r.detail is not None else F.lit(None)).cast("string").alias("detail"))) for r in rules]))


def findings(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """(path, line, issue, severity, detail, context): a row for each rule that fits a node, in one pass."""
    rows = nodes.select("path", F.col("pos_line").alias("line"), F.col("ctx_func").alias("context"), F.explode(_fitting(rules)).alias("f"))
    return rows.select("path", "line", "f.issue", "f.severity", "f.detail", "context")


def counted(nodes: DataFrame, rules: dict[str, Column], by: str | None = "path") -> DataFrame:
    """A column with the count of nodes for each rule; one row a file, or one in all."""
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()]
    return nodes.groupBy(by).agg(*counts) if by else nodes.agg(*counts)


def patterns(counters: DataFrame, *names: str) -> DataFrame:
    """(pattern, n) of the summed counters that are not zero."""
    total = counters.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return total.select(F.inline(F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(n).alias("n")) for n in names]))).filter("n > 0")


def advice(counters: DataFrame, rules: list[tuple[Column, Column | str]]) -> DataFrame:
    """(advice): the texts whose condition holds on a one-row table, in order."""
    texts = [F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in rules]
    return counters.select(F.explode(F.array_compact(F.array(*texts))).alias("advice"))


# Concurrency


def concurrency(nodes: DataFrame) -> dict[str, Column]:
    text, callee = _text("text"), _text("callee")
    access = _kind("MemberAccessExpr")
    out = {"DispatchQueue.main": access & text.contains("DispatchQueue.main"), "DispatchQueue.global": access & text.contains("DispatchQueue.global"), "await": _kind("AwaitExpr")}
    out |= {"Task": _kind("FunctionCallExpr") & ((callee == "Task") | callee.startswith("Task.")), "MainActor.run": _calls("MainActor.run"), "performSelector": _calls("performSelector")}
    out |= {"@MainActor": _attr("@MainActor"), "@Sendable": _attr("@Sendable"), "nonisolated": F.array_contains(F.coalesce("modifiers", F.array().cast("array<string>")), "nonisolated")}
    return out | {lock: _kind("TypeReference") & (F.col("name") == lock) for lock in facts.LOCKS}


def thread_issues(nodes: DataFrame) -> DataFrame:
    """Blocking the main queue, shared state from asynchronous functions off the main actor, tasks that hold self, old selectors.

    What fits a rule, the asynchronous functions and the classes on the main actor are gathered by file, in one pass.
    """
    main = F.exists(F.coalesce("attrs", F.array().cast("array<string>")), lambda a: a.contains("@MainActor"))
    text, access = _text("text"), _kind("MemberAccessExpr")
    shared = F.filter(F.array(*[F.lit(s) for s in SHARED]), lambda s: F.contains(text, s))
    callee = _text("callee")
    found = _fitting([
        Rule("blocking_main_thread", "critical", access & text.contains("DispatchQueue.main") & text.contains(".sync")),
        Rule("shared_state_access", "warning", access & F.col("func_id").isNotNull() & (F.size(shared) > 0), F.array_join(shared, ", ")),
        Rule("actor_isolation", "warning", _kind("FunctionCallExpr") & ((callee == "Task") | callee.startswith("Task.")) & text.contains("self.") & ~text.contains("[weak self]")),
        Rule("legacy_selector", "info", _calls("performSelector")),
    ])
    rows = nodes.select(
        "path", F.when(_kind("ClassDecl") & main, F.col("name")).alias("_main"), F.when(_kind("FunctionDecl") & F.col("is_async") & ~main, F.struct("node_id", "ctx_type")).alias("_async"),
        F.when(F.size(found) > 0, F.struct(F.col("pos_line").alias("line"), found.alias("found"), F.col("ctx_func").alias("context"), "func_id")).alias("_hit"),
    ).filter("_main is not null or _async is not null or _hit is not null")
    d = rows.groupBy("path").agg(F.collect_set("_main").alias("_main"), F.collect_list("_async").alias("_async"), F.collect_list("_hit").alias("_hit"))
    free = F.filter("_async", lambda f: ~F.coalesce(F.array_contains("_main", f["ctx_type"]), F.lit(False)))
    d = d.select("path", F.transform(free, lambda f: f["node_id"]).alias("_free"), F.explode("_hit").alias("h"))
    d = d.select("path", "h.line", F.explode("h.found").alias("f"), "h.context", F.array_contains("_free", F.col("h.func_id")).alias("_is_free"))
    return d.filter((F.col("f.issue") != "shared_state_access") | F.col("_is_free")).select("path", "line", "f.issue", "f.severity", "f.detail", "context")


def thread_advice(counters: DataFrame, issues: DataFrame) -> DataFrame:
    shared = issues.agg(F.count_if(F.col("issue") == "shared_state_access").alias("_shared"))
    c = F.col
    return advice(counters.crossJoin(shared), [  # both are one row
        (c("`DispatchQueue.main`") > 50, "Heavy DispatchQueue.main usage - consider migrating to @MainActor"),
        ((c("`@MainActor`") < 10) & (c("`DispatchQueue.main`") > 20), "Low @MainActor adoption - modern Swift concurrency recommended"),
        (c("_shared") > 10, "Many shared state accesses - consider actor-based isolation"),
    ])


# Retain cycles


def retain_counters(nodes: DataFrame) -> dict[str, Column]:
    text, callee = _text("text"), _text("callee")
    closure, held = _kind("ClosureExpr"), _text("literal")
    delegate = _kind("VariableDecl") & F.lower(_text("name")).rlike("(delegate|datasource)$")
    weak = F.array_contains("modifiers", "weak")
    return {
        "closures_with_self": closure & text.contains("self"), "closures_with_weak_self": closure & held.contains("weak"), "closures_with_unowned_self": closure & held.contains("unowned"),
        "strong_delegates": delegate & ~weak, "weak_delegates": delegate & weak, "timers_created": _calls("Timer.scheduledTimer") | (_kind("FunctionCallExpr") & (callee == "Timer")),
        "timers_invalidated": _kind("FunctionCallExpr") & (F.col(MEMBER) == "invalidate"), "notifications_added": _calls("NotificationCenter") & callee.contains("addObserver"),
        "notifications_removed": _calls("NotificationCenter") & callee.contains("removeObserver"), "escaping_closures": _attr("@escaping"),
    }


def retain_cycles(nodes: DataFrame) -> DataFrame:
    """Strong delegates, closures kept as properties, timers that hold their target."""
    kind, text = _text("return_type"), _text("text")
    return findings(nodes, [
        Rule("strong_delegate_property", "high", retain_counters(nodes)["strong_delegates"], F.concat(F.lit("weak var "), F.col("name"))),
        Rule("closure_stored_as_property", "medium", _kind("VariableDecl") & kind.contains("->") & kind.contains("(") & ~kind.startswith("["), F.col("name")),
        Rule("timer_without_invalidate", "high", retain_counters(nodes)["timers_created"] & text.contains("target: self") & ~text.contains("[weak")),
    ])


def retain_risk() -> Column:
    """0 to 100 over the retain counters: strong delegates, unsafe closures, timers and observers that stay."""
    unsafe = F.col("closures_with_self") - F.col("closures_with_weak_self") - F.col("closures_with_unowned_self")
    timers = F.greatest(F.col("timers_created") - F.col("timers_invalidated"), F.lit(0))
    observers = F.greatest(F.col("notifications_added") - F.col("notifications_removed"), F.lit(0))
    return F.least(F.lit(100), F.col("strong_delegates") * 10 + unsafe * 2 + timers * 5 + observers * 3)


def retain_advice(counters: DataFrame) -> DataFrame:
    unsafe = F.col("closures_with_self") - F.col("closures_with_weak_self") - F.col("closures_with_unowned_self")
    return advice(counters, [
        (F.col("strong_delegates") > 0, F.concat(F.lit("Found "), F.col("strong_delegates"), F.lit(" strong delegate properties - add 'weak' keyword"))),
        (unsafe > 10, "Many closures capture self strongly - review for potential retain cycles"),
        (F.col("timers_created") > F.col("timers_invalidated"), "More timers created than invalidated - ensure timers are cleaned up"),
        (F.col("notifications_added") > F.col("notifications_removed"), "More notification observers added than removed - check for leaks"),
    ])


# Reactive


def subscriptions(nodes: DataFrame) -> DataFrame:
    """(path, line, kind, context, disposed) of subscribe, bind, drive, sink and assign; a chain that goes on after an inner call counts it again."""
    parent = _text("parent_text")
    disposed = parent.contains(".disposed(by:)") | parent.contains("disposeBag")
    kinds = [("subscribe", disposed), ("bind", disposed), ("drive", disposed), ("sink", F.lit(True)), ("assign", F.lit(True))]
    each = [F.when(_chained(k), F.struct(F.lit(k).alias("kind"), d.alias("disposed"))) for k, d in kinds]
    rows = nodes.filter("kind = 'FunctionCallExpr'").select("path", F.col("pos_line").alias("line"), "node_id", "func_id", F.col("ctx_func").alias("context"), F.explode(F.array_compact(F.array(*each))).alias("s"))
    return rows.select("path", "line", "node_id", "func_id", "s.kind", "context", "s.disposed")


def _chained(name: str) -> Column:
    """Whether a call is of this member, or goes on after one."""
    callee = _text("callee")
    return callee.endswith("." + name) | callee.contains(f".{name}(")


def is_subscription() -> Column:
    out = F.lit(False)
    for k in ("subscribe", "bind", "drive", "sink", "assign"):
        out = out | _chained(k)
    return _kind("FunctionCallExpr") & out


def reactive_counters(nodes: DataFrame) -> dict[str, Column]:
    v = _kind("VariableDecl")
    return {"dispose_bags": v & _text("text").contains("DisposeBag"), "cancellables": v & _text("text").contains("AnyCancellable")}


def reactive_leaks(nodes: DataFrame) -> DataFrame:
    """(path, line, issue): subscriptions without disposal before any bag of their function, closures that hold self in a reactive call."""
    bag = reactive_counters(nodes)["dispose_bags"]
    text, parent = _text("text"), _text("parent_text")
    open_ = _kind("FunctionCallExpr") & _chained("subscribe") & ~(parent.contains(".disposed(by:)") | parent.contains("disposeBag"))
    held = _kind("ClosureExpr") & (text.contains("self.") | text.contains("self,")) & ~text.contains("[weak self]") & ~text.contains("[unowned self]")
    strong = held & facts._has(parent, [".subscribe", ".sink", ".bind"])
    rows = nodes.filter(bag | open_ | strong).select("path", F.col("pos_line").alias("line"), "func_id", "node_id", bag.alias("_bag"), open_.alias("_open"), strong.alias("_strong"))
    # only bags, subscriptions and such closures come together by function
    w = Window.partitionBy("path", "func_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_seen", F.max("_bag").over(w))
    issue = F.when(F.col("_open") & ~F.col("_seen"), "subscribe_without_disposal").when(F.col("_strong"), "strong_self_in_closure")
    return rows.select("path", "line", issue.alias("issue")).filter("issue is not null")


def reactive_framework(nodes: DataFrame) -> DataFrame:
    """One row: Both, RxSwift, Combine or None."""
    found = subscriptions(nodes).agg(F.coalesce(F.bool_or(F.col("kind").isin("subscribe", "bind", "drive")), F.lit(False)).alias("rx"), F.coalesce(F.bool_or(F.col("kind").isin("sink", "assign")), F.lit(False)).alias("combine"))
    kept = counted(nodes, reactive_counters(nodes), None)
    rx, combine = F.col("rx") | (F.col("dispose_bags") > 0), F.col("combine") | (F.col("cancellables") > 0)
    return found.crossJoin(kept).select(F.when(rx & combine, "Both").when(rx, "RxSwift").when(combine, "Combine").otherwise("None").alias("framework"))  # one row each


# User interface


WRAPPERS = ["State", "Binding", "ObservedObject", "StateObject", "EnvironmentObject", "Environment", "Published", "Observable"]


def wrapper_counters() -> dict[str, Column]:
    text = _text("text")
    longer = {"State": "StateObject", "Environment": "EnvironmentObject"}
    return {w: _attr("@" + w) & (~text.contains("@" + longer[w]) if w in longer else F.lit(True)) for w in WRAPPERS}


def ui_patterns(nodes: DataFrame) -> dict[str, Column]:
    """Property wrappers, containers one by one, and imports."""
    named, module = _kind("TypeReference"), _kind("ImportDecl")
    out = {f"@{w}": c for w, c in wrapper_counters().items()} | {c: named & (F.col("name") == c) for c in facts.CONTAINERS}
    return out | {f"import {m}": module & (F.col("name") == m) for m in ("SwiftUI", "UIKit", "Combine")} | {"View": _kind("StructDecl") & F.array_contains("inherits", "View")}


def swiftui_views(nodes: DataFrame) -> DataFrame:
    """(path, name, line, the wrapper counts, body_lines) of every view structure."""
    views = nodes.filter(_kind("StructDecl") & F.array_contains("inherits", "View")).select("path", "name", F.col("pos_line").alias("line"), (F.col("end_line") - F.col("pos_line")).alias("body_lines"))
    w = wrapper_counters()
    kinds = {"n_state": "State", "n_binding": "Binding", "n_observed": "ObservedObject", "n_environment": "EnvironmentObject"}
    held = nodes.filter(_kind("Attribute")).groupBy("path", F.col("ctx_type").alias("name")).agg(*[F.count_if(w[k]).alias(n) for n, k in kinds.items()])
    return views.join(held, ["path", "name"], "left").na.fill(0, list(kinds))


def swiftui_issues(views: DataFrame) -> DataFrame:
    return views.filter(F.col("n_state") > MANY_STATES).select("path", "line", F.lit("too_many_state_properties").alias("issue"), F.concat_ws(" ", "name", "n_state").alias("detail"))


def ui_mix(nodes: DataFrame) -> DataFrame:
    """One row: files with one framework, the other, or both, and whether the project is of views."""
    m = nodes.filter("kind = 'ImportDecl'").groupBy("path").agg(F.bool_or(F.col("name") == "SwiftUI").alias("s"), F.bool_or(F.col("name") == "UIKit").alias("u"))
    out = m.agg(F.count_if(F.col("s") & ~F.col("u")).alias("swiftui_files"), F.count_if(F.col("u") & ~F.col("s")).alias("uikit_files"), F.count_if(F.col("s") & F.col("u")).alias("mixed_files"))
    return out.withColumn("is_swiftui_project", F.col("swiftui_files") > 10)


def uikit_counters() -> dict[str, Column]:
    return {
        "outlets": _attr("@IBOutlet"), "actions": _attr("@IBAction"), "constraints": _calls("NSLayoutConstraint", "activate", "addConstraint", "translatesAutoresizingMaskIntoConstraints"),
        "snapkit": _calls("snp.", "makeConstraints", "updateConstraints", "remakeConstraints"), "frames": _calls(".frame", "CGRect("), "delegate_properties": _kind("VariableDecl") & F.lower(_text("name")).rlike("(delegate|datasource)$"),
        "notification_center": _calls("NotificationCenter"), "target_actions": _attr("@objc") | _calls("addTarget"), "gestures": _calls("UIGestureRecognizer", "TapGestureRecognizer", "SwipeGestureRecognizer", "PanGestureRecognizer"),
        "table_views": _calls("UITableView"), "collection_views": _calls("UICollectionView"), "navigation_controllers": F.lit(False), "tab_bar_controllers": F.lit(False), "alerts": _calls("UIAlertController"),
        "presents": _calls("present(", "present(animated"), "pushes": _calls("pushViewController"), "segues": _calls("performSegue"), "storyboards": _calls("instantiateViewController", "UIStoryboard"),
    }


def uikit_classes(nodes: DataFrame) -> DataFrame:
    """(path, name, line, superclass, line_count, role, n_outlets, n_actions, massive) of controllers and views; the last inherited type counts."""
    parent = F.try_element_at("inherits", F.lit(-1))
    role = F.when(parent.contains("Controller"), "controller").when((parent == "UIView") | parent.endswith("View"), "view")
    rows = nodes.filter("kind = 'ClassDecl' and size(inherits) > 0").select("path", "name", F.col("pos_line").alias("line"), parent.alias("superclass"), (F.col("end_line") - F.col("pos_line")).alias("line_count"), role.alias("role")).filter("role is not null")
    held = nodes.filter(_kind("Attribute")).groupBy("path", F.col("ctx_type").alias("name")).agg(F.count_if(_attr("@IBOutlet")).alias("n_outlets"), F.count_if(_attr("@IBAction")).alias("n_actions"))
    rows = rows.join(held, ["path", "name"], "left").na.fill(0, ["n_outlets", "n_actions"])
    return rows.withColumn("massive", (F.col("role") == "controller") & (F.col("line_count") > MASSIVE_LINES))


def modernization() -> Column:
    """0 to 100 over the summed UIKit counters and n_massive."""
    code, massive = F.col("presents") + F.col("pushes"), F.col("n_massive")
    score = 50 + F.when(F.col("constraints") > F.col("frames"), 15).otherwise(0) + F.when(F.col("snapkit") > 0, 10).otherwise(0) + F.when(code > F.col("segues"), 10).otherwise(0)
    score = score - F.when(massive > 5, 15).when(massive > 0, 5).otherwise(0) - F.when(F.col("frames") > 100, 10).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


# Core Data


def entities(nodes: DataFrame) -> DataFrame:
    """(path, name, line, properties, relationships) of managed object classes."""
    classes = nodes.filter((F.col("kind") == "ClassDecl") & F.exists("inherits", lambda x: x.contains("ManagedObject"))).select("path", "name", F.col("pos_line").alias("line"))
    managed = nodes.filter((F.col("kind") == "VariableDecl") & F.exists("attrs", lambda a: a.contains("@NSManaged")))
    many = facts._has(_text("return_type"), ["NSSet", "Set<", "NSOrderedSet"])
    named = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("node_id", "name")))), lambda x: x["name"])
    held = managed.groupBy("path", F.col("ctx_type").alias("_t")).agg(named(~many).alias("properties"), named(many).alias("relationships")).withColumnRenamed("_t", "name")
    none = F.array().cast("array<string>")
    return classes.join(held, ["path", "name"], "left").withColumns({c: F.coalesce(c, none) for c in ("properties", "relationships")})


def fetch_requests(nodes: DataFrame) -> DataFrame:
    """(path, line, entity, has_predicate, has_sort); without a predicate all objects may come."""
    text = _text("text")
    entity = F.nullif(F.regexp_extract(text, r"NSFetchRequest<(\w+)>", 1), F.lit(""))
    return nodes.filter(_calls("FetchRequest")).select("path", F.col("pos_line").alias("line"), entity.alias("entity"), text.contains("predicate").alias("has_predicate"), text.contains("sortDescriptor").alias("has_sort"))


def core_data_counters() -> dict[str, Column]:
    access = _kind("MemberAccessExpr")
    return {
        "fetch_requests": _calls("FetchRequest"), "batch_inserts": _calls("NSBatchInsertRequest"), "batch_deletes": _calls("NSBatchDeleteRequest"), "batch_updates": _calls("NSBatchUpdateRequest"), "performs": _calls("performBlock", "perform {"),
        "performs_and_waits": _calls("performAndWait"), "saves": _kind("FunctionCallExpr") & (F.col(MEMBER) == "save"), "main_context": _calls("viewContext", "mainContext") | (access & (F.col(MEMBER) == "viewContext")),
        "background_context": _calls("newBackgroundContext", "backgroundContext") | (access & (F.col(MEMBER) == "newBackgroundContext")), "result_controllers": _calls("NSFetchedResultsController"),
    }


def core_data_advice(counters: DataFrame, n_entities: Column, n_open: Column) -> DataFrame:
    """*counters* is one row that also has what the columns *n_entities* and *n_open* (requests without predicate) name."""
    return advice(counters, [
        (F.col("main_context") > F.col("background_context") * 2, "Heavy main context usage - consider moving fetches to background contexts"),
        ((F.col("performs") == 0) & (F.col("saves") > 0), "Saves without perform blocks detected - ensure thread safety"),
        ((F.col("batch_inserts") == 0) & (n_entities > 10), "Consider using batch inserts for better performance"),
        (n_open > 5, "Many fetch requests without predicates - may cause performance issues"),
    ])


# Accessibility and localisation


def ui_elements(nodes: DataFrame) -> DataFrame:
    """(path, line, element): calls that make an element, and declarations of images."""
    callee = _text("callee")
    made = F.filter(F.array(*[F.lit(e) for e in facts.UI_ELEMENTS]), lambda e: (callee == e) | F.endswith(callee, F.concat(F.lit("."), e)))
    image = _kind("VariableDecl") & facts._has(_text("text"), ["UIImageView", "Image("])
    element = F.when(_kind("FunctionCallExpr"), F.get(made, F.lit(0))).when(image, "image")
    return nodes.select("path", F.col("pos_line").alias("line"), element.alias("element")).filter("element is not null")


def accessibility_uses(nodes: DataFrame) -> DataFrame:
    return nodes.filter(_kind("MemberAccessExpr") & F.col(MEMBER).isin(facts.ACCESSIBILITY)).select("path", F.col("pos_line").alias("line"), F.col(MEMBER).alias("api"))


def accessibility_issues(nodes: DataFrame) -> DataFrame:
    parents, text = F.array_join(F.coalesce("inherits", F.array().cast("array<string>")), ","), _text("text")
    is_class = _kind("ClassDecl")
    return findings(nodes, [
        Rule("button_without_label", "warning", is_class & facts._has(parents, ["UIButton", "UIControl"]) & ~text.contains("accessibilityLabel"), F.col("name")),
        Rule("custom_view_without_traits", "warning", is_class & parents.contains("UIView") & ~parents.contains("UIViewController") & ~facts._has(text, ["accessibilityTraits", "isAccessibilityElement"]), F.col("name")),
    ])


def accessibility_by_file(nodes: DataFrame) -> DataFrame:
    """(path, n_elements, n_set, coverage) of files with elements."""
    e = ui_elements(nodes).groupBy("path").agg(F.count("*").alias("n_elements"))
    u = accessibility_uses(nodes).groupBy("path").agg(F.count("*").alias("n_set"))
    return e.join(u, "path", "left").na.fill(0, ["n_set"]).withColumn("coverage", F.col("n_set") * 100.0 / F.col("n_elements"))


def string_literals(nodes: DataFrame) -> DataFrame:
    """(path, line, literal, verdict, context) of literals: localized, hardcoded (three letters or more that a user may see), or technical."""
    content, parent = _text("literal"), _text("parent_text")
    low = F.lower(content)
    seen = content.contains(" ") | (content.rlike(r"^\p{Lu}") & (F.length(content) > 5)) | facts._has(low, UI_WORDS)
    verdict = F.when(facts._has(parent, facts.LOCALIZED), "localized").when((F.length(content) >= 3) & seen & ~facts._has(low, TECHNICAL), "hardcoded").otherwise("technical")
    rows = nodes.filter((F.col("kind") == "StringLiteralExpr") & (content != ""))
    return rows.select("path", F.col("pos_line").alias("line"), F.substring(content, 1, 100).alias("literal"), verdict.alias("verdict"), F.col("ctx_func").alias("context"))


def localization_coverage(literals: DataFrame) -> DataFrame:
    """One row: localized, hardcoded and the share of the first, 100 where there are none."""
    n = literals.agg(F.count_if(F.col("verdict") == "localized").alias("n_localized"), F.count_if(F.col("verdict") == "hardcoded").alias("n_hardcoded"))
    total = F.col("n_localized") + F.col("n_hardcoded")
    return n.withColumn("coverage", F.when(total > 0, F.col("n_localized") * 100.0 / total).otherwise(100.0))


# Delegates, network, properties, authentication


def is_wiring() -> Column:
    return (F.col("kind") == "AssignExpr") & (F.col("callee") == "=") & F.lower(_text("base")).rlike("(delegate|datasource)$")


def wirings(nodes: DataFrame) -> DataFrame:
    """(path, line, target, value, context) of assignments to delegates and data sources."""
    return nodes.filter(is_wiring()).select("path", F.col("pos_line").alias("line"), F.col("base").alias("target"), F.col("literal").alias("value"), F.col("ctx_func").alias("context"))


def delegate_issues(properties: DataFrame, wired: DataFrame) -> DataFrame:
    """Properties that are not weak, and delegates set in an initialiser."""
    strong = properties.filter("not is_weak").select("path", F.lit(None).cast("int").alias("line"), F.lit("strong_delegate_reference").alias("issue"), F.col("name").alias("detail"))
    early = wired.filter("context = 'init'").select("path", "line", F.lit("delegate_set_in_init").alias("issue"), F.col("target").alias("detail"))
    return strong.unionByName(early)


def delegate_protocols(conformances: DataFrame, wired: DataFrame) -> DataFrame:
    """(protocol, conformers, n_assigned) of delegate protocols; an assignment counts for the protocol whose bare name its target contains.

    *conformances* has protocol and conformers. The targets are counted first, so that what is compared is distinct spellings.
    """
    p = conformances.filter(facts._has("protocol", ["Delegate", "DataSource"])).withColumn("_bare", F.replace(F.lower("protocol"), F.lit("delegate"), F.lit("")))
    t = wired.groupBy(F.lower("target").alias("_target")).agg(F.count("*").alias("_n"))
    hits = p.join(F.broadcast(t) if t.count() <= 200_000 else t, F.contains(F.col("_target"), F.col("_bare")), "left")
    return hits.groupBy("protocol").agg(F.first("conformers").alias("conformers"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_assigned"))


def network_patterns(nodes: DataFrame) -> DataFrame:
    """(pattern, n, files, description): keywords of member accesses and names that hold one, once a file."""
    text = _text("text")
    keyword = T.first_match(text, [(k, k) for k in NETWORK_KEYWORDS])
    name = F.when((F.length("name") > 5) & facts._has(_text("name"), NETWORK_KEYWORDS), F.col("name"))
    found = F.when(_kind("MemberAccessExpr"), keyword).when(_kind("DeclReferenceExpr", "TypeReference"), name)
    rows = nodes.select("path", found.alias("pattern")).filter("pattern is not null").distinct()
    out = rows.groupBy("pattern").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path")).alias("files"))
    kinds = F.create_map(*[F.lit(x) for kv in NETWORK_KINDS.items() for x in kv])
    return out.withColumn("description", F.coalesce(kinds[F.col("pattern")], F.lit("Network-related code")))


def property_accesses(nodes: DataFrame, pattern: str, name: str | None = None) -> DataFrame:
    """(path, line, property, access, context, code): reads, writes and calls of what contains *pattern* (`X.*`: what follows `X.`).

    *name* keeps properties by name, `p*` by beginning, `*s` by end, whatever their case.
    """
    wanted = pattern[:-1] if pattern.endswith(".*") else pattern
    is_access = _kind("MemberAccessExpr") & _text("text").contains(wanted)
    is_write = (F.col("kind") == "AssignExpr") & F.col("callee").isin("=", "+=", "-=") & _text("base").contains(wanted) & _text("base").contains(".")
    out = nodes.filter(is_access | is_write).select(
        "path", F.col("pos_line").alias("line"), F.when(_kind("AssignExpr"), F.trim(T.last_part(F.col("base"), "."))).otherwise(F.col(MEMBER)).alias("property"),
        F.when(_kind("AssignExpr"), "write").when(F.col("parent_kind") == "FunctionCallExpr", "call").otherwise("read").alias("access"), F.col("ctx_func").alias("context"), F.substring("text", 1, 100).alias("code"),
    )
    return out.filter(named_like(F.col("property"), name)) if name else out


def named_like(name: Column, pattern: str) -> Column:
    low = pattern.lower()
    n = F.lower(name)
    return n.startswith(low[:-1]) if low.endswith("*") else n.endswith(low[1:]) if low.startswith("*") else n == low


def property_summary(accesses: DataFrame) -> DataFrame:
    """(property, n_reads, n_writes, n_calls, n_files)."""
    a = F.col("access")
    return accesses.groupBy("property").agg(F.count_if(a == "read").alias("n_reads"), F.count_if(a == "write").alias("n_writes"), F.count_if(a == "call").alias("n_calls"), F.count_distinct("path").alias("n_files"))


def auth_accesses(nodes: DataFrame) -> DataFrame:
    """(path, line, property, access, context, code) of old sign-in code: account, authenticate and login singletons, SDK calls, user members, writes."""
    text, member, base = _text("text"), F.col(MEMBER), _text("base")
    owners = [("Account", "Account.sharedInstance()", ACCOUNT), ("AccountAuthenticate", "AccountAuthenticate.sharedInstance()", AUTHENTICATE), ("LoginData", "LoginData.sharedInstance()", LOGIN)]
    each = [F.when(text.contains(sign) & member.isin(names), F.concat(F.lit(owner + "."), member)) for owner, sign, names in owners]
    each.append(F.concat(F.lit("Cognito."), T.first_match(text, [(p, p) for p in SDK])))
    each.append(F.when(((base == "user") | base.endswith(".user")) & member.isin(USER_MEMBERS), F.concat(F.lit("CognitoUser."), member)))
    access = F.when(text.contains("(") & ~text.contains("sharedInstance()"), "call").otherwise("read")
    is_read = F.col("kind") == "MemberAccessExpr"
    set_ = F.get(F.filter(F.array(*[F.lit(n) for n in sorted(ACCOUNT, key=lambda n: (-len(n), n))]), lambda n: F.contains(base, F.concat(F.lit("."), n))), F.lit(0))
    is_write = (F.col("kind") == "AssignExpr") & (F.col("callee") == "=") & base.contains("Account.sharedInstance()")
    property_ = F.when(is_read, F.array(*each)).when(is_write, F.array(F.concat(F.lit("Account."), set_)))
    return nodes.select(
        "path", F.col("pos_line").alias("line"), F.explode(F.array_compact(property_)).alias("property"), F.when(is_read, access).otherwise("write").alias("access"), F.col("ctx_func").alias("context"),
        F.when(is_read, F.substring("text", 1, 100)).otherwise(F.trim("text")).alias("code"),
    )


def migration_priority(accesses: DataFrame) -> DataFrame:
    """(property, n_accesses, n_files, advice), most used first."""
    known = F.create_map(*[F.lit(x) for text, names in ADVICE.items() for n in names for x in (n, text)])
    rows = accesses.groupBy("property").agg(F.count("*").alias("n_accesses"), F.count_distinct("path").alias("n_files"))
    told = F.coalesce(known[F.col("property")], F.when(F.col("property").startswith("Cognito."), SDK_ADVICE).otherwise(OTHER_ADVICE))
    return rows.withColumn("advice", told).orderBy(F.desc("n_accesses"), "property")


def replacement(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in REPLACEMENTS.items() for x in kv])
    return F.coalesce(known[name], F.lit(OTHER_REPLACEMENT))


#: The phases of a migration with their priority.
PHASES = [("Phase 1: Token Access Migration", "critical"), ("Phase 2: Cognito SDK Encapsulation", "high"), ("Phase 3: User Profile Migration", "medium"), ("Phase 4: Login State Consolidation", "low")]


def migration_phases(priority: DataFrame, accesses: DataFrame) -> DataFrame:
    """(phase, priority, property, task, advice, path, line, code, suggestion): a row for each place; a property may be in several phases."""
    p, low = F.col("property"), F.lower("property")
    in_phase = [facts._has(p, ["Token", "token"]), facts._has(p, ["Cognito", "getSession", "signOut", "isSignedIn"]), facts._has(low, ["name", "email", "dob", "phone", "pwd"]), facts._has(p, ["checkIfLoggedIn", "signedIn", "LoginData"])]
    uses = F.concat(F.lit(" ("), F.col("n_accesses"), F.lit(" uses"))
    tasks = [F.concat(F.lit("Replace "), p, uses, F.lit(" in "), F.col("n_files"), F.lit(" files)")), F.concat(F.lit("Encapsulate "), p, uses, F.lit(")")), F.concat(F.lit("Migrate "), p, F.lit(" to Keychain/AuthManager"), uses, F.lit(")")), F.concat(F.lit("Update "), p, uses, F.lit(")"))]
    each = [F.when(c, F.struct(F.lit(n).alias("phase"), F.lit(level).alias("priority"), t.alias("task"))) for c, (n, level), t in zip(in_phase, PHASES, tasks, strict=True)]
    rows = priority.select("property", "advice", F.explode(F.array_compact(F.array(*each))).alias("x")).select("x.*", "property", "advice")
    return rows.join(accesses.select("property", "path", "line", "code"), "property").withColumn("suggestion", replacement(p))


def effort(n: Column) -> Column:
    return F.when(n < 20, "Small (~1-2 hours)").when(n < 50, "Medium (~4-8 hours)").when(n < 100, "Large (~1-2 days)").otherwise("XL (~3-5 days)")


def migration_checklist(phases: DataFrame) -> DataFrame:
    """(phase, n_tasks, n_places, n_files, effort, text): a Markdown text for each phase, up to TAP_LIMIT places a task.

    Each task's first places are taken by rank before the text is made, so that a text stays as small as its tasks.
    """
    total = phases.agg(F.count("*").alias("n_places"), F.count_distinct("phase", "task").alias("n_tasks")).withColumn("effort", effort(F.col("n_places")))
    w = Window.partitionBy("phase", "task").orderBy("path", "line", "code")
    row = F.concat(F.lit("| "), T.last_part(F.col("path")), F.lit(" | "), F.coalesce(F.col("line").cast("string"), F.lit("?")), F.lit(" | `"), F.substring("code", 1, 30), F.lit("` | `"), F.substring("suggestion", 1, 30), F.lit("` |"))
    n = phases.groupBy("phase", "task").agg(F.count("*").alias("n"))
    top = phases.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= TAP_LIMIT)
    task = top.groupBy("phase", "priority", "task", "advice").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", row.alias("row")))), lambda x: x["row"]).alias("rows")).join(n, ["phase", "task"])
    more = F.when(F.col("n") > TAP_LIMIT, F.concat(F.lit("\n| ... | ... | +"), F.col("n") - TAP_LIMIT, F.lit(" more | ... |"))).otherwise("")
    head = F.lit("| File | Line | Current | Suggested |\n|------|------|---------|----------|\n")
    text = F.concat(F.lit("### "), F.col("task"), F.lit("\n\n**Recommendation:** "), F.col("advice"), F.lit("\n\n"), head, F.array_join("rows", "\n"), more)
    files = phases.groupBy("phase").agg(F.count_distinct("path").alias("n_files"))
    out = task.groupBy("phase", "priority").agg(F.array_join(F.array_sort(F.collect_list(text)), "\n\n").alias("_t")).join(files, "phase")
    out = out.crossJoin(F.broadcast(total))  # one row
    return out.select("phase", "priority", "n_tasks", "n_places", "n_files", "effort", F.concat(F.lit("## "), F.col("phase"), F.lit("\n\n**Files affected:** "), F.col("n_files"), F.lit("\n\n"), F.col("_t")).alias("text"))


def protocol_like(name: Column) -> Column:
    """Whether an inherited name looks like a protocol."""
    return name.rlike("Protocol|Delegate|DataSource|Codable|Hashable|Equatable|Comparable|Identifiable|ObservableObject|View|(able|ing)$")


def singleton_usage(references: DataFrame) -> DataFrame:
    """(symbol, n): references by what stands before the shared instance."""
    s = F.col("symbol")
    base = F.when(s.contains(".sharedInstance"), F.concat(F.substring_index(s, ".sharedInstance", 1), F.lit(".sharedInstance()"))).otherwise(s)
    return references.groupBy(base.alias("symbol")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol")
