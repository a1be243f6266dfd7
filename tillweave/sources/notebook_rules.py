"""Exact rules from the dictionaries that notebooks assign in their code cells."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.config.errors import InputError
from tillweave.config.rules import Rule
from tillweave.functions.columns import bracket_to_path, path_head

#: The variables that hold categories, with the account each is for.
TARGETS = {"details_category_map": "boi_current", "rev_details_category_map": "revolut_current"}
#: First segments of categories that move money between own accounts.
TRANSFER_HEADS = ("savings", "top up", "top-up", "topup", "credit card repayment", "pocket withdrawal", "pocket deposit", "vault", "transfer")

class _NotConstant(Exception):
    """An expression whose value depends on running the notebook."""


def _constant(node: ast.expr) -> object:
    """The value of a key or entry that is written out: a scalar, or texts joined by + or by standing side by side."""
    match node:
        case ast.Constant(value=value):
            return value
        case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=int() | float() as number)):
            return -number
        case ast.BinOp(op=ast.Add(), left=left, right=right):
            joined = (_constant(left), _constant(right))
            if all(isinstance(side, str) for side in joined):
                return "".join(joined)
        case ast.Tuple(elts=parts):
            return tuple(map(_constant, parts))
        case ast.List(elts=parts):
            return list(map(_constant, parts))
    raise _NotConstant


class DictionaryReader(ast.NodeVisitor):
    """Follows the statements of a cell in source order and keeps the dictionaries bound to wanted names.

    Plain, chained, unpacking, annotated and := assignments count. A dictionary counts only if it is written out
    whole; spread entries (**) and computed ones make it unknown, and an unknown value leaves the name as it was.
    """

    def __init__(self, wanted: frozenset[str]) -> None:
        self.wanted = wanted
        self.bound: list[tuple[str, dict[str, str]]] = []

    def bind(self, target: ast.expr, value: ast.expr | None) -> None:
        if isinstance(target, (ast.Tuple, ast.List)) and isinstance(value, (ast.Tuple, ast.List)) and len(target.elts) == len(value.elts):
            for one, its in zip(target.elts, value.elts):
                self.bind(one, its)
        elif isinstance(target, ast.Name) and target.id in self.wanted and isinstance(value, ast.Dict):
            try:
                entries = {str(_constant(k)): str(_constant(v)) for k, v in zip(value.keys, value.values)}
            except _NotConstant:
                return
            self.bound.append((target.id, entries))

    def visit_Assign(self, node: ast.Assign) -> None:
        self.generic_visit(node)
        for target in node.targets:
            self.bind(target, node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.generic_visit(node)
        self.bind(node.target, node.value)

    def visit_NamedExpr(self, node: ast.NamedExpr) -> None:
        self.generic_visit(node)
        self.bind(node.target, node.value)


def assignments(source: str, wanted: frozenset[str]) -> list[tuple[str, dict[str, str]]]:
    """Dictionaries bound to a wanted name in one cell, in source order; code that isn't Python has none."""
    reader = DictionaryReader(wanted)
    try:
        reader.visit(ast.parse(source))
    except (SyntaxError, ValueError, RecursionError):
        return []
    return reader.bound


def code_cells(raw: DataFrame) -> DataFrame:
    """(notebook, cell, source) of the code cells of raw (notebook, cells); a source is one text or a list of lines."""
    cells = raw.select("notebook", F.posexplode("cells").alias("cell", "_c")).filter(F.col("_c.cell_type") == "code")
    lines = F.try_variant_get("_c.source", "$", "array<string>")
    whole = F.when(F.schema_of_variant("_c.source") == "STRING", F.try_variant_get("_c.source", "$", "string"))
    return cells.select("notebook", "cell", F.coalesce(F.array_join(lines, ""), whole, F.lit("")).alias("source"))


def read_code_cells(spark: SparkSession, path: str) -> DataFrame:
    """The code cells of notebook files; outputs are never read, as the schema leaves them out."""
    raw = spark.read.schema("cells array<struct<cell_type:string,source:variant>>").option("multiLine", True).json(path)
    return code_cells(raw.select(F.input_file_name().alias("notebook"), "cells"))


def rules_of(cells: DataFrame, targets: dict[str, str] = TARGETS) -> DataFrame:
    """Exact rules (notebook, place, match, pattern, category, account, transfer) from code cells.

    The last assignment of a variable counts, as a whole.
    """
    names = frozenset(targets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.notebook, r.cell, k, n, d) for r in batch.itertuples() for k, (n, d) in enumerate(assignments(r.source or "", names))]
            yield pd.DataFrame(rows, columns=["notebook", "cell", "nth", "variable", "entries"])

    found = cells.mapInPandas(run, "notebook string, cell int, nth int, variable string, entries map<string,string>")
    last = found.groupBy("notebook", "variable").agg(F.max_by("entries", F.struct("cell", "nth")).alias("entries"))
    account = F.element_at(F.create_map(*(F.lit(x) for kv in targets.items() for x in kv)), F.col("variable"))
    rows = last.select("notebook", "variable", account.alias("account"), F.posexplode(F.map_entries("entries")).alias("place", "_e"))
    category = bracket_to_path(F.col("_e.value"))
    return rows.select("notebook", "variable", "place", F.lit("exact").alias("match"), F.col("_e.key").alias("pattern"), category.alias("category"), "account", F.lower(F.trim(path_head(category))).isin(*TRANSFER_HEADS).alias("transfer"))


def migrate(spark: SparkSession, path: str, targets: dict[str, str] = TARGETS) -> list[Rule]:
    """The rules of one notebook, validated, in the order of the targets and of their entries."""
    rows = rules_of(read_code_cells(spark, path), targets).collect()
    if lost := sorted(set(targets) - {r.variable for r in rows}):
        raise InputError(f"the notebook does not assign {', '.join(lost)}")
    order = list(targets)
    rows.sort(key=lambda r: (order.index(r.variable), r.place))
    return [Rule(r.match, r.pattern, r.category, r.account, r.transfer) for r in rows]
