"""What can be seen without running anything: modules and plans."""

import ast
import re
from collections import Counter
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_no_name_is_defined_twice():
    for path in [*(ROOT / "ledgerlight").rglob("*.py"), *(ROOT / "tests").rglob("*.py"), *ROOT.glob("*.py")]:
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Module | ast.ClassDef):
                names = Counter(x.name for x in node.body if isinstance(x, ast.FunctionDef | ast.ClassDef))
                assert not [n for n, k in names.items() if k > 1], path


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"^[^A-Za-z]*Exchange hash", plan(df), re.M))


def test_exchanges_of_cases(spark):
    """Besides the join of the two tables that cases are made from: one for documents, one for facts, and as many for exhibits."""
    known, base = __spark_entry__.queries(), "/root/testdata/sf0.001"
    spread = exchanges(known["duplicate_ids"](spark, base)) - 2
    assert exchanges(known["letter_text"](spark, base)) - spread == 2
    assert exchanges(known["packet_facts"](spark, base)) - spread <= 2
    assert exchanges(known["packet_html"](spark, base)) - 2 * spread <= 4
