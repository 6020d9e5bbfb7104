"""What operators read of syntax nodes: kinds and columns, so that a parser need not hand over the rest."""

from __future__ import annotations

from quarry.operators.facts import CHUNK_KINDS, SMELL_KINDS, TYPE_KINDS

#: By operator the kinds and the columns that it reads; one that counts other kinds as well must not be here.
READS = {
    "smells": (SMELL_KINDS, "kind pos_line text literal bang parent_text callee in_debug params if_depth is_else_if base ctx_func"),
    "function_metrics": (["FunctionDecl"], "kind func_id name pos_line end_line complexity params is_async throws"),
    "imports": (["ImportDecl"], "kind name"),
    "ui_mix": (["ImportDecl"], "kind name"),
    "references": (["MemberAccessExpr", "FunctionCallExpr"], "kind text pos_line ctx_func"),
    "type_definitions": (TYPE_KINDS, "kind name inherits pos_line visibility"),
    "endpoints": (["StringLiteralExpr"], "kind literal pos_line parent_text ctx_func"),
    "delegates": (["VariableDecl"], "kind name func_id pos_line ctx_type modifiers"),
    "wirings": (["AssignExpr"], "kind callee base pos_line literal ctx_func"),
    "usages": ([*TYPE_KINDS, "FunctionCallExpr", "MemberAccessExpr", "TypeReference", "DeclReferenceExpr"], "kind inherits callee member name pos_line text"),
    "chunks": (CHUNK_KINDS, "kind pos_line end_line name text signature params return_type doc comments calls types imports inherits complexity visibility body throws ctx_type ctx_type_kind"),
    "finding_lines": (["AssignExpr", "FunctionCallExpr", "MemberAccessExpr", "StringLiteralExpr"], "kind callee base literal text pos_line"),
    "retain_cycles": (["VariableDecl", "FunctionCallExpr", "ClosureExpr", "Attribute"], "kind name modifiers return_type text literal callee member pos_line ctx_func"),
    "thread_issues": (["ClassDecl", "FunctionDecl", "MemberAccessExpr", "FunctionCallExpr"], "kind attrs name ctx_type node_id is_async func_id text callee pos_line ctx_func"),
    "reactive_leaks": (["VariableDecl", "FunctionCallExpr", "ClosureExpr"], "kind text parent_text callee func_id node_id pos_line"),
    "auth_accesses": (["MemberAccessExpr", "AssignExpr"], "kind text member base callee pos_line ctx_func"),
    "property_accesses": (["MemberAccessExpr", "AssignExpr"], "kind text member base callee parent_kind pos_line ctx_func"),
    "file_health": ([*SMELL_KINDS, "VariableDecl", "ClosureExpr", "Attribute"], "kind pos_line end_line text literal bang parent_text callee in_debug params if_depth is_else_if base member name modifiers func_id complexity body"),
    "project_summary": ([*SMELL_KINDS, *TYPE_KINDS, "VariableDecl", "ClosureExpr", "Attribute", "TypeReference", "DeclReferenceExpr", "MemberAccessExpr"], "kind pos_line end_line text literal bang parent_text callee in_debug params if_depth is_else_if base member name modifiers func_id complexity body inherits visibility"),
}


def reads(*operators: str) -> dict[str, list[str]]:
    """kinds and columns of nodes() for all of these operators."""
    each = [READS[o] for o in operators]
    return {"kinds": sorted({k for kinds, _ in each for k in kinds}), "columns": sorted({c for _, columns in each for c in columns.split()})}
