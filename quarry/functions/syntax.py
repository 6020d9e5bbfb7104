"""Syntax facts of one source text: tokens, matched brackets, and nodes as token intervals.

Recognisers look at the token list independently of each other and emit intervals; sorting these by start
and length gives the pre-order, and a stack gives the parents. A text that does not parse only loses the
nodes whose brackets are unmatched.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

TYPES = {"class", "struct", "enum", "protocol", "extension", "actor"}
MODIFIERS = {"public", "private", "fileprivate", "internal", "open", "static", "class", "final", "override", "mutating", "nonmutating", "lazy", "weak", "unowned", "required", "convenience", "dynamic", "optional", "indirect", "nonisolated", "isolated"}
VISIBILITY = ["public", "private", "fileprivate", "internal", "open"]
#: Reserved words; the other modifiers are names wherever they do not modify.
KEYWORDS = {"class", "struct", "enum", "protocol", "extension", "public", "private", "fileprivate", "internal", "static", "if", "else", "guard", "for", "while", "repeat", "switch", "case", "catch", "do", "try", "as", "is", "in", "let", "var", "func", "init", "deinit", "subscript", "return", "throw", "throws", "rethrows", "await", "import", "where", "defer", "default", "inout"}
#: Words before a brace that is not a closure.
ACCESSORS = {"get", "set", "willSet", "didSet", "async", "mutating", "nonmutating"}
#: Kinds with a body; the surrounding text of what stands in them is its line.
BODIES = {"ClassDecl", "StructDecl", "EnumDecl", "ProtocolDecl", "ExtensionDecl", "ActorDecl", "FunctionDecl", "InitializerDecl", "DeinitializerDecl", "ClosureExpr", "IfExpr", "GuardStmt", "ForStmt", "WhileStmt", "RepeatStmt", "CatchClause", "SwitchExpr", "SwitchCase"}
DECISIONS = {"if": "IfExpr", "guard": "GuardStmt", "for": "ForStmt", "while": "WhileStmt", "repeat": "RepeatStmt", "catch": "CatchClause", "switch": "SwitchExpr"}
#: Kinds that count for cyclomatic complexity.
BRANCHES = {"IfExpr", "GuardStmt", "ForStmt", "WhileStmt", "RepeatStmt", "CatchClause", "SwitchCase"}
FUNCTIONS, TYPE_DECLS = {"FunctionDecl", "InitializerDecl"}, {t.capitalize() + "Decl" for t in TYPES}
#: Words that begin a declaration or a decision, and what stands before a word that is no reference.
_OPENING, _NO_REFERENCE = {"import", "func", "init", "subscript", "deinit", "let", "var"} | TYPES | set(DECISIONS), TYPES | {".", "func", "let", "var", "import"}
_NO_NAME, _NO_CLOSURE = KEYWORDS | MODIFIERS, KEYWORDS | ACCESSORS

_TOKEN = re.compile(
    r"""(?P<word>`?[^\W\d]\w*`?|\$\d+)
    |(?P<number>0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)
    |(?P<mark>[@\#][^\W\d]\w*)
    |(?P<op>->|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\.\.\.|\.\.<|[-+*/%&|^]=|.)""",
    re.VERBOSE | re.DOTALL,
)
_RAW_STRING = re.compile('#+"')
_SPACES = re.compile(r"\s+")
_DECIMAL = re.compile(r"[\d_]+")
_CLOSER = {"(": ")", "[": "]", "{": "}"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    spaced: bool
    comments: list[str] = field(default_factory=list)


#: Tokens between angle brackets that are looked at.
GENERIC = 60
#: Interpolations within one another that are followed; what lies deeper ends the text.
NESTED = 50


def _string_end(s: str, i: int, level: int = 0) -> int:
    """End of the string literal that opens at *i* (a quote or hash signs before one)."""
    if level > NESTED:
        return len(s)
    hashes = 0
    while s[i + hashes] == "#":
        hashes += 1
    i += hashes
    quote = '"""' if s.startswith('"""', i) else '"'
    close, escape = quote + "#" * hashes, "\\" + "#" * hashes
    i += len(quote)
    while i < len(s):
        if s.startswith(escape, i):
            i += len(escape)
            if s[i : i + 1] == "(":
                depth = 0
                while i < len(s):
                    if s[i] == '"':
                        i = _string_end(s, i, level + 1)
                        continue
                    depth += (s[i] == "(") - (s[i] == ")")
                    i += 1
                    if not depth:
                        break
            else:
                i += 1
        elif s.startswith(close, i):
            return i + len(close)
        elif len(quote) == 1 and s[i] == "\n":
            return i
        else:
            i += 1
    return len(s)


def _comment_end(s: str, i: int) -> int:
    if s[i + 1] == "/":
        j = s.find("\n", i)
        return len(s) if j < 0 else j
    depth, j = 1, i + 2
    while j < len(s) and depth:
        step = 1 if s.startswith("/*", j) else -1 if s.startswith("*/", j) else 0
        depth, j = depth + step, j + (2 if step else 1)
    return j


def tokens(s: str) -> list[Token]:
    out: list[Token] = []
    i, spaced, comments = 0, True, []
    length, spaces, match = len(s), _SPACES.match, _TOKEN.match
    while i < length:
        c = s[i]
        if c.isspace():
            i, spaced = spaces(s, i).end(), True
            continue
        if c == "/" and s[i + 1 : i + 2] in ("/", "*"):
            j = _comment_end(s, i)
            comments.append(s[i:j])
            i, spaced = j, True
            continue
        if c == '"' or (c == "#" and _RAW_STRING.match(s, i)):
            kind, j = "string", _string_end(s, i)
        else:
            m = match(s, i)
            kind, j = m.lastgroup, m.end()
        out.append(Token(kind, s[i:j], i, j, spaced, comments))
        i, spaced, comments = j, False, []
    return out


class Source:
    """The recognisers over one text; nodes() gives rows in pre-order."""

    def __init__(self, text: str) -> None:
        self.s, self.t = text, tokens(text)
        self.x, self.n = [t.text for t in self.t], len(self.t)
        self.newlines = [m.start() for m in re.finditer("\n", text)]
        self.pair: dict[int, int] = {}
        #: For each token the innermost bracket that is open before it.
        self.inside: list[int | None] = []
        stack: list[int] = []
        for i, t in enumerate(self.t):
            self.inside.append(stack[-1] if stack else None)
            if t.kind != "op":
                continue
            if t.text in _CLOSER:
                stack.append(i)
            elif t.text in ")]}":
                while stack and _CLOSER[self.t[stack[-1]].text] != t.text:
                    stack.pop()
                if stack:
                    o = stack.pop()
                    self.pair[o], self.pair[i] = i, o
        self.found: list[dict] = []
        self.params: set[int] = set()
        self.owned: set[int] = set()

    def at(self, i: int) -> str:
        return self.x[i] if 0 <= i < self.n else ""

    def names(self, i: int) -> bool:
        """Whether token *i* is a word that stands for a value: no keyword, or one after a dot."""
        return i >= 0 and self.t[i].kind == "word" and (self.at(i) not in KEYWORDS or self.at(i - 1) == ".")

    def span(self, a: int, b: int) -> str:
        return self.s[self.t[a].start : self.t[b].end] if a <= b < len(self.t) else ""

    def line(self, offset: int) -> int:
        return bisect_left(self.newlines, offset) + 1

    def line_of(self, offset: int) -> str:
        end = self.s.find("\n", offset)
        return self.s[self.s.rfind("\n", 0, offset) + 1 : end if end >= 0 else len(self.s)]

    def debug_regions(self) -> list[bool]:
        """For each token whether it stands between `#if DEBUG` and its end."""
        stack: list[bool] = []
        out = []
        for i, t in enumerate(self.t):
            if t.text == "#if":
                stack.append(self.at(i + 1) == "DEBUG")
            elif t.text == "#endif" and stack:
                stack.pop()
            out.append(any(stack))
        return out

    def add(self, kind: str, a: int, b: int, **more) -> None:
        self.found.append({"kind": kind, "a": a, "b": max(a, min(b, len(self.t) - 1)), **more})

    def body(self, i: int) -> int | None:
        """The first open brace after *i* outside round and square brackets."""
        while i < len(self.t):
            x = self.at(i)
            if x == "{":
                return i if i in self.pair else None
            if x in ("}", ")", "]"):
                return None
            i = self.pair.get(i, i) + 1 if x in ("(", "[") else i + 1
        return None

    def chain_start(self, i: int) -> int:
        """First token of the postfix expression that ends at token *i*."""
        while True:
            while self.at(i) in ("?", "!") and i and not self.t[i].spaced:
                i -= 1
            x = self.at(i)
            if x == ">" and (g := self.generic_start(i)) is not None:
                i = g
                continue
            if x in (")", "]") and i in self.pair:
                o = self.pair[i]
                callable_before = o and not self.t[o].spaced and (self.names(o - 1) or self.at(o - 1) in (")", "]", "?", "!"))
                if not callable_before:
                    return o
                i = o - 1
                continue
            if x == "}" and i in self.pair and self.pair[i] and self.pair[i] not in self.owned:
                i = self.pair[i] - 1
                continue
            if i > 1 and self.at(i - 1) == ".":
                if self.names(i - 2) or self.t[i - 2].kind in ("string", "number") or self.at(i - 2) in (")", "]", "}", "?", "!"):
                    i -= 2
                    continue
                return i - 1
            return i

    def generic_start(self, i: int) -> int | None:
        """The name before the angle brackets that close at token *i*, if these hold types only."""
        depth = 0
        for j in range(i, max(-1, i - GENERIC), -1):
            x = self.at(j)
            depth += (x == ">") - (x == "<")
            if not depth:
                return j - 1 if j and self.names(j - 1) and not self.t[j].spaced else None
            if self.t[j].kind != "word" and x not in ("<", ">", ",", ".", "?", "[", "]", ":", "&", "(", ")", "->"):
                return None
        return None

    def value_end(self, i: int) -> int:
        """Last token of the value after the equals sign *i*: to the end of its line, or of the chain that goes on after it."""
        e = i
        while e + 1 < len(self.t):
            n = e + 1
            x = self.at(n)
            if x in ("}", ")", "]", ";", ",", "else") or (x == "{" and n in self.owned):
                break
            if e != i and "\n" in self.s[self.t[e].end : self.t[n].start] and x not in (".", "?", ":", "??", "&&", "||") and self.at(e) not in ("=", "??", "&&", "||", "+"):
                break
            e = self.pair.get(n, n) if x in _CLOSER else n
        return e

    def before(self, i: int) -> tuple[int, list[str], list[str]]:
        """Where the modifiers and attributes before a declaring keyword begin, and both lists."""
        mods: list[str] = []
        attrs: list[str] = []
        while i:
            p = i - 1
            q = self.pair.get(p, p) if self.at(p) == ")" else p
            q = q - 1 if q != p else p
            if q >= 0 and self.t[q].kind == "mark" and self.at(q)[0] == "@":
                attrs.insert(0, self.span(q, p))
                i = q
            elif q >= 0 and self.at(q) in MODIFIERS and (q == p or self.at(q + 1) == "("):
                mods.insert(0, self.at(q))
                i = q
            else:
                break
        return i, mods, attrs

    def listed(self, a: int, b: int) -> list[tuple[int, int]]:
        """Token ranges between commas of *a*..*b* outside brackets and angle brackets."""
        out, first, angle, i = [], a, 0, a
        while i <= b:
            x = self.at(i)
            angle += (x == "<") - (x == ">")
            if x in _CLOSER and i in self.pair:
                i = self.pair[i]
            elif x == "," and angle <= 0:
                out.append((first, i - 1))
                first = i + 1
            i += 1
        return [r for r in [*out, (first, b)] if r[0] <= r[1]]

    def parameters(self, o: int) -> list[dict]:
        rows = []
        for a, b in self.listed(o + 1, self.pair[o] - 1):
            colon = next((i for i in range(a, b + 1) if self.at(i) == ":"), None)
            if colon is None:
                continue
            equals = next((i for i in range(colon, b + 1) if self.at(i) == "="), None)
            words = [self.at(i) for i in range(a, colon) if self.t[i].kind == "word"]
            rows.append({"label": words[0] if words else None, "name": words[-1] if words else None, "type": self.span(colon + 1, (equals or b + 1) - 1), "has_default": equals is not None})
        return rows

    def declarations(self) -> None:
        i = 0
        while i < len(self.t):
            x = self.x[i]
            if x not in _OPENING or self.at(i - 1) == "." or self.t[i].kind != "word":
                i += 1
                continue
            if x == "import":
                j = i + 2 if self.at(i + 1) in TYPES | {"func", "var", "let", "typealias"} else i + 1
                e = j
                while self.at(e + 1) == ".":
                    e += 2
                self.add("ImportDecl", i, e, name=self.at(j))
            elif x in TYPES and i + 1 < len(self.t) and self.t[i + 1].kind == "word" and self.at(i + 1) not in _NO_NAME and self.at(i - 1) != ":":
                self.type_declaration(i)
            elif x == "func" or (x in ("init", "subscript") and self.at(i + 1) in ("(", "?", "!", "<")) or (x == "deinit" and self.at(i + 1) == "{"):
                self.function(i)
            elif x in ("let", "var") and i + 1 < len(self.t) and self.t[i + 1].kind == "word":
                self.variable(i)
            elif x in DECISIONS:
                self.decision(i)
            i += 1

    def type_declaration(self, i: int) -> None:
        o = self.body(i)
        if o is None:
            return
        self.owned.add(o)
        a, mods, attrs = self.before(i)
        name_end = i + 1
        while self.at(name_end + 1) == ".":
            name_end += 2
        stop = next((j for j in range(i, o) if self.at(j) == "where"), o)
        depth, colon = 0, None
        for j in range(name_end + 1, stop):
            depth += (self.at(j) == "<") - (self.at(j) == ">")
            if self.at(j) == ":" and not depth:
                colon = j
                break
        inherits = [self.span(*r) for r in self.listed(colon + 1, stop - 1)] if colon else []
        self.add(self.at(i).capitalize() + "Decl", a, self.pair[o], name=self.span(i + 1, name_end), modifiers=mods, attrs=attrs, inherits=inherits, signature=self.span(a, o - 1))

    def function(self, i: int) -> None:
        a, mods, attrs = self.before(i)
        o = i + 1
        while o < len(self.t) and self.at(o) not in ("(", "{") or self.at(o) == "(" and self.at(i) == "func" and o == i + 1:
            o += 1
        if self.at(i) == "deinit":
            self.owned.add(o)
            if o in self.pair:
                self.add("DeinitializerDecl", a, self.pair[o], name="deinit", modifiers=mods, attrs=attrs)
            return
        if self.at(o) != "(" or o not in self.pair:
            return
        self.params.add(o)
        j, is_async, throws, result = self.pair[o] + 1, False, False, None
        while self.at(j) in ("async", "throws", "rethrows"):
            is_async, throws = is_async or self.at(j) == "async", throws or self.at(j) != "async"
            j += 1
        head = j - 1
        if self.at(j) == "->":
            e = j + 1
            while e < len(self.t):
                if self.at(e) in ("{", "}", "where") or (e > j + 1 and "\n" in self.s[self.t[e - 1].end : self.t[e].start] and self.at(e) not in (".", "->", "?", "!", "<", ",")):
                    break
                e = self.pair.get(e, e) + 1 if self.at(e) in ("(", "[") else e + 1
            result, head = self.span(j + 1, e - 1), e - 1
        k = head + 1
        if self.at(k) == "where":
            k = self.body(k) or k
        if self.at(k) == "{" and k in self.pair:
            self.owned.add(k)
            end = self.pair[k]
        else:
            end = head
        kind = {"func": "FunctionDecl", "init": "InitializerDecl", "subscript": "SubscriptDecl"}[self.at(i)]
        self.add(kind, a, end, name=self.at(i + 1) if self.at(i) == "func" else self.at(i), modifiers=mods, attrs=attrs, params=self.parameters(o), return_type=result, is_async=is_async, throws=throws, signature=self.span(a, head), body=self.span(k + 1, end - 1) if end != head else None)

    def variable(self, i: int) -> None:
        a, mods, attrs = self.before(i)
        e, kind = i + 1, None
        if self.at(i + 2) == ":":
            e = i + 3
            while e + 1 < len(self.t) and self.at(e + 1) not in ("=", "{", "}", ",", ")", ";", "in", "else") and "\n" not in self.s[self.t[e].end : self.t[e + 1].start]:
                e = self.pair.get(e, e) if self.at(e) in ("(", "[") else e
                if self.at(e + 1) in ("=", "{", "}", ",", ")", ";") or "\n" in self.s[self.t[e].end : self.t[min(e + 1, len(self.t) - 1)].start]:
                    break
                e += 1
            e = self.pair.get(e, e) if self.at(e) in ("(", "[") else e
            kind = self.span(i + 3, e)
        computed = self.at(e + 1) == "{" and e + 1 in self.pair and self.at(i) == "var"
        if computed:
            self.owned.add(e + 1)
            e = self.pair[e + 1]
        elif self.at(e + 1) == "=":
            e = self.value_end(e + 1)
        self.add("VariableDecl", a, e, name=self.at(i + 1), modifiers=[*mods, self.at(i)], attrs=attrs, return_type=kind, literal="computed" if computed else "stored")

    def decision(self, i: int) -> None:
        x = self.at(i)
        if x == "while" and self.at(i - 1) == "}" and self.pair.get(i - 1, 0) and self.at(self.pair[i - 1] - 1) == "repeat":
            return
        o = self.body(i + 1)
        if o is None:
            return
        self.owned.add(o)
        end = self.pair[o]
        if x == "if":
            while self.at(end + 1) == "else":
                n = self.body(end + 2)
                if n is None:
                    break
                self.owned.add(n)
                end, more = self.pair[n], self.at(end + 2) == "if"
                if not more:
                    break
        if x == "switch":
            depth_of = [j for j in range(o + 1, end) if self.at(j) in ("case", "default") and self.t[j].kind == "word" and self.innermost(j) == o]
            for j, n in zip(depth_of, [*depth_of[1:], end]):
                self.add("SwitchCase", j, n - 1)
        self.add(DECISIONS[x], i, end, is_else_if=x == "if" and self.at(i - 1) == "else", literal=self.span(o + 1, self.pair[o] - 1).strip() if x == "catch" else None)

    def innermost(self, i: int) -> int | None:
        """The brace that directly holds token *i*."""
        o = self.inside[i]
        while o is not None and (self.at(o) != "{" or o not in self.pair):
            o = self.inside[o]
        return o

    def is_type_position(self, a: int, i: int) -> bool:
        if self.at(a - 1) == "->":
            return True
        if self.at(a - 1) != ":":
            return False
        if self.at(a - 3) in ("let", "var"):
            return True
        o = self.inside[i]
        while o is not None and o not in self.params:
            o = self.inside[o]
        return o is not None

    def scope(self, i: int) -> str:
        """The text between the round or square brackets that directly hold token *i*; empty where braces do."""
        o = self.inside[i]
        return self.span(o + 1, self.pair[o] - 1) if o is not None and self.at(o) != "{" and o in self.pair else ""

    def assignment(self, i: int) -> None:
        """The operator at *i* as an assignment, unless it gives a declared name or a parameter its first value."""
        a = self.chain_start(i - 1)
        before = self.at(a - 1)
        if before not in ("let", "var", ":", "case", "?", "typealias", "associatedtype", ">", "]") and self.inside[i] not in self.params:
            self.add("AssignExpr", a, self.line_end(i), base=self.span(a, i - 1), callee=self.at(i), literal=self.span(i + 1, self.line_end(i)))

    def expressions(self) -> None:
        for i, t in enumerate(self.t):
            x, tight = t.text, not t.spaced
            if t.kind == "word" and x not in KEYWORDS:
                if self.at(i - 1) not in _NO_REFERENCE:
                    self.add("TypeReference" if x[0].isupper() else "DeclReferenceExpr", i, i, name=x.strip("`"))
            elif t.kind == "string":
                self.add("StringLiteralExpr", i, i, literal=x.strip("#").strip('"'))
            elif t.kind == "number" and _DECIMAL.fullmatch(x):
                self.add("IntegerLiteralExpr", i, i, literal=x.replace("_", ""), base=self.scope(i))
            elif x == "await" and t.kind == "word":
                self.add("AwaitExpr", i, self.line_end(i))
            elif t.kind == "mark" and x[0] == "@":
                self.add("Attribute", i, self.pair.get(i + 1, i) if self.at(i + 1) == "(" and not self.t[i + 1].spaced else i, name=x)
            elif (x == "=" or x in ("+=", "-=")) and i and (self.names(i - 1) or self.at(i - 1) in (")", "]", "?", "!")):
                self.assignment(i)
            elif x == "try" and self.at(i + 1) in ("!", "?") and not self.t[i + 1].spaced:
                self.add("TryExpr", i, self.line_end(i), bang=self.at(i + 1) == "!")
            elif x == "as" and i and self.at(i + 1) in ("!", "?") and not self.t[i + 1].spaced:
                self.add("AsExpr", self.chain_start(i - 1), min(i + 2, len(self.t) - 1), bang=self.at(i + 1) == "!")
            elif x == "!" and i and tight and self.at(i - 1) not in ("try", "as", "init") and (self.names(i - 1) or self.t[i - 1].kind == "string" or self.at(i - 1) in (")", "]", "?", "!", ">")):
                a = self.chain_start(i)
                self.add("ImplicitlyUnwrappedOptionalType" if self.is_type_position(a, i) else "ForceUnwrapExpr", a, i, bang=True)
            elif x == "." and i + 1 < len(self.t) and self.t[i + 1].kind == "word" and not self.t[i + 1].spaced:
                a = self.chain_start(i + 1)
                self.add("MemberAccessExpr", a, i + 1, base=self.span(a, i - 1) or None, member=self.at(i + 1))
            elif x == "(" and i and tight and i in self.pair and i not in self.params and (self.names(i - 1) or self.at(i - 1) in (")", "]", ">", "?", "!")):
                end = self.pair[i]
                if self.at(end + 1) == "{" and end + 1 in self.pair and end + 1 not in self.owned:
                    end = self.pair[end + 1]
                self.call(self.chain_start(i - 1), i - 1, end)
            elif x == "{" and i in self.pair and i not in self.owned:
                if self.names(i - 1) and self.at(i - 1) not in ACCESSORS:
                    self.call(self.chain_start(i - 1), i - 1, self.pair[i])
                if self.at(i - 1) not in _NO_CLOSURE or self.at(i - 1) in ("return", "in"):
                    self.add("ClosureExpr", i, self.pair[i], literal=self.span(i + 1, self.pair[i + 1]) if self.at(i + 1) == "[" and i + 1 in self.pair else None)

    def line_end(self, i: int) -> int:
        while i + 1 < len(self.t) and "\n" not in self.s[self.t[i].end : self.t[i + 1].start] and self.at(i + 1) not in ("}", ";"):
            i = self.pair.get(i + 1, i + 1) if self.at(i + 1) in _CLOSER else i + 1
        return i

    def call(self, a: int, callee_end: int, end: int) -> None:
        self.add("FunctionCallExpr", a, end, callee=self.span(a, callee_end), member=self.at(callee_end))

    def nodes(self, faithful: bool = True) -> list[dict]:
        """Rows in pre-order. With *faithful* a node's line is the one where the token before it ends."""
        columns = self.table(COLUMNS, None, faithful)
        return [dict(zip(columns, r, strict=True)) for r in zip(*columns.values(), strict=True)]

    def table(self, columns: list[str], kinds: set[str] | None = None, faithful: bool = True) -> dict[str, list]:
        """The nodes of some kinds or all, in pre-order, as a list for each column; only what is asked for is worked out."""
        self.declarations()
        if kinds is None or not kinds <= DECLARED or not FLAT.issuperset(columns):
            self.expressions()
        found = self.found
        found.sort(key=lambda f: (f["a"], -f["b"]))
        first, last, kind = [f["a"] for f in found], [f["b"] for f in found], [f["kind"] for f in found]
        up: list[int | None] = []
        func: list[int | None] = []
        outer: list[int | None] = []
        owner: list[int | None] = []
        stack: list[int] = []
        for n, a in enumerate(first):
            while stack and last[stack[-1]] < a:
                stack.pop()
            p = stack[-1] if stack else None
            up.append(p)
            # what is open around a node are its parent and what is open around that
            is_func = p is not None and kind[p] in FUNCTIONS
            func.append(p if is_func or p is None else func[p])
            outer.append(None if p is None else p if is_func and outer[p] is None else outer[p])
            owner.append(p if p is None or kind[p] in TYPE_DECLS else owner[p])
            stack.append(n)
        kept = [n for n, k in enumerate(kind) if kinds is None or k in kinds]
        get = _Columns(self, found, first, last, kind, up, func, outer, owner, faithful, kept)
        return {c: getattr(get, c)() if hasattr(get, c) else [found[n].get(c) for n in kept] for c in columns}


#: The columns of a node but for the path of its file.
COLUMNS = [
    "node_id", "parent_id", "end_id", "kind", "pos_line", "end_line", "name", "text", "line_text", "in_debug", "callee", "base", "member", "modifiers", "attrs", "inherits", "params", "return_type",
    "is_async", "throws", "bang", "literal", "doc", "comments", "visibility", "parent_kind", "parent_text", "ctx_func", "func_id", "outer_func_id", "ctx_type", "ctx_type_kind", "if_depth", "is_else_if",
    "complexity", "signature", "body", "calls", "types", "imports",
]

#: The kinds that declarations() finds by itself, and the columns that follow from them without the other nodes.
DECLARED = {"ImportDecl", "VariableDecl", "SubscriptDecl", "DeinitializerDecl", *FUNCTIONS, *TYPE_DECLS}
FLAT = {"kind", "pos_line", "end_line", "name", "text", "line_text", "modifiers", "attrs", "inherits", "params", "return_type", "is_async", "throws", "literal", "doc", "comments", "visibility", "signature", "body", "imports"}


@dataclass(slots=True)
class _Columns:
    """The columns that follow from the place of a node; each method gives one, of the kept nodes."""

    source: Source
    found: list[dict]
    first: list[int]
    last: list[int]
    kinds: list[str]
    up: list[int | None]
    func: list[int | None]
    outer: list[int | None]
    owner: list[int | None]
    faithful: bool
    kept: list[int]

    def of(self, nodes: list[int | None], key: str) -> list:
        return [None if nodes[n] is None else self.found[nodes[n]].get(key) for n in self.kept]

    def node_id(self) -> list[int]:
        return self.kept

    def parent_id(self) -> list[int | None]:
        return [self.up[n] for n in self.kept]

    def end_id(self) -> list[int]:
        end = list(range(len(self.found)))
        for n in range(len(end) - 1, -1, -1):
            if (p := self.up[n]) is not None and end[n] > end[p]:
                end[p] = end[n]
        return [end[n] for n in self.kept]

    def pos_line(self) -> list[int]:
        t, first = self.source.t, [self.first[n] for n in self.kept]
        return [self.source.line((t[a - 1].end - 1 if a else 0) if self.faithful else t[a].start) for a in first]

    def end_line(self) -> list[int]:
        return [self.source.line(self.source.t[self.last[n]].end - 1) for n in self.kept]

    def text(self) -> list[str]:
        return [self.source.span(self.first[n], self.last[n]) for n in self.kept]

    def line_text(self) -> list[str]:
        return [self.source.line_of(self.source.t[self.first[n]].start) for n in self.kept]

    def in_debug(self) -> list[bool]:
        if "#if" not in self.source.x:
            return [False] * len(self.kept)
        debug = self.source.debug_regions()
        return [debug[self.first[n]] for n in self.kept]

    def doc(self) -> list[list[str]]:
        return [[c for c in x if c.startswith(("///", "/**"))] for x in self.comments()]

    def comments(self) -> list[list[str]]:
        return [self.source.t[self.first[n]].comments for n in self.kept]

    def visibility(self) -> list[str]:
        return [next((m for m in self.found[n].get("modifiers", ()) if m in VISIBILITY), "internal") for n in self.kept]

    def parent_kind(self) -> list[str | None]:
        return self.of(self.up, "kind")

    def parent_text(self) -> list[str]:
        out = []
        for n in self.kept:
            p = self.up[n]
            out.append(self.source.line_of(self.source.t[self.first[n]].start) if p is None or self.kinds[p] in BODIES else self.source.span(self.first[p], self.last[p]))
        return out

    def ctx_func(self) -> list[str | None]:
        return self.of(self.func, "name")

    def func_id(self) -> list[int | None]:
        return [self.func[n] for n in self.kept]

    def outer_func_id(self) -> list[int | None]:
        return [self.outer[n] for n in self.kept]

    def ctx_type(self) -> list[str | None]:
        return self.of(self.owner, "name")

    def ctx_type_kind(self) -> list[str | None]:
        return self.of(self.owner, "kind")

    def if_depth(self) -> list[int]:
        depth: list[int] = []
        for n, p in enumerate(self.up):
            depth.append((0 if p is None else depth[p]) + (self.kinds[n] == "IfExpr" and not self.found[n].get("is_else_if")))
        return [depth[n] for n in self.kept]

    def complexity(self) -> list[int]:
        branch = [0] * (self.source.n + 1)
        for a, k in zip(self.first, self.kinds, strict=True):
            branch[a] += k in BRANCHES
        for i in range(1, len(branch)):
            branch[i] += branch[i - 1]
        return [1 + branch[self.last[n]] - (branch[self.first[n] - 1] if self.first[n] else 0) for n in self.kept]

    def within(self, kind: str, key: str) -> list[list[str] | None]:
        """For each function and initialiser the distinct values of *key* of the nodes of a kind that stand in it and in no inner one, sorted."""
        held: dict[int, set[str]] = {}
        for n, k in enumerate(self.kinds):
            if k == kind and self.func[n] is not None and (v := self.found[n].get(key)) is not None:
                held.setdefault(self.func[n], set()).add(v)
        return [sorted(held.get(n, ())) if self.kinds[n] in FUNCTIONS else None for n in self.kept]

    def calls(self) -> list[list[str] | None]:
        return self.within("FunctionCallExpr", "member")

    def types(self) -> list[list[str] | None]:
        return self.within("TypeReference", "name")

    def imports(self) -> list[list[str] | None]:
        """For each declaration of a function or type the modules that its file imports."""
        modules = sorted({f["name"] for f in self.found if f["kind"] == "ImportDecl"})
        return [modules if self.kinds[n] in FUNCTIONS or self.kinds[n] in TYPE_DECLS else None for n in self.kept]
