"""Fields that are named once with a canonical value are taken in generated code; the rules see the others, with the same results."""

import random

from test_sql_tables import PROPOSALS, TEXTS

import __spark_entry__
from ledgerlight.functions import constants as K
from ledgerlight.functions import tables
from ledgerlight.operators import extract

BASE = "/root/testdata/sf0.001"
VALUES = ["150.00", "$150.00", "$ 150.00", "00.50", "1,200.50", "150.001", "", "  ", "2025-03-05", "2024-02-29", "2025-02-29", "2025-04-31", "0000-01-01", "March 5, 2025", "Ann", "ann", "x" * 240, "x" * 241, "a: b", "é"]


def texts() -> list[str]:
    pick = random.Random(3)
    names = [a for v in K.ALIASES.values() for a in v] + [k.replace("_", " ") for k in K.FIELD_LABELS] + ["x", "Amount Due", "BALANCE"]
    line = lambda: pick.choice(["", " ", "\t"]) + pick.choice(names) + pick.choice([":", " = ", ": ", ""]) + pick.choice(VALUES) + pick.choice(["", " ", "\xa0"])
    made = ["".join(line() + pick.choice(ends) for _ in range(pick.choice([0, 2, 9]))) for ends in (["\n"], ["\n", "\r\n", "\f"]) for _ in range(150)]
    return TEXTS + made + ["".join(c for c in t if c.isascii() and c not in "\t\r\f") for t in made]


def test_local_fields_are_the_same_by_rules_alone(spark, monkeypatch):
    docs = spark.createDataFrame([(i, kind, t) for i, t in enumerate([None, *texts()]) for kind in ("bill", "eob", None)], "id int, kind string, text string").repartition(4)
    rows = lambda: sorted(map(repr, extract.local_fields(docs).collect()))
    taken = rows()
    monkeypatch.setattr(extract, "PLAIN", r"^(?!)")
    ruled = rows()
    assert taken == ruled and sum("Row(field" in r for r in taken) > 500 and sum("could not be" in r for r in taken) > 100


def test_validated_fields_are_the_same_by_rules_alone(spark, monkeypatch):
    pick, rows_ = random.Random(4), []
    for i, t in enumerate(texts()):
        lines = t.splitlines() or [""]
        given = [(pick.choice([*K.FIELD_LABELS, "nonsense", None]), *pick.choice([(v, x), (v, x), (v.upper(), x), (v, " " + x + " "), (v, x + "z"), (None, x), (v, v)]), pick.choice([1, 1, 1, 2, 0, None])) for x in lines for v in [x.replace("=", ":").partition(":")[2].strip()]]
        named = [(k, x.replace("=", ":").partition(":")[2].strip(), x.strip(), 1) for x in lines for k, a in K.ALIASES.items() if x.strip().lower().startswith(tuple(a))]
        rows_.append((i, t, pick.choice([given, named, named, named + given, named + [("collector", "Nobody", "no such line", 1)], None])))
    rows_ += [(1000 + i, t, p) for i, (t, p) in enumerate(zip(TEXTS, PROPOSALS, strict=True))] + [(2000, None, named)]
    docs = spark.createDataFrame(rows_, "id int, text string, proposals array<struct<key:string,value:string,quote:string,page:int>>").repartition(4)
    rows = lambda: sorted(map(repr, extract.validated_fields(docs).collect()))
    taken = rows()
    monkeypatch.setattr(extract, "PLAIN", r"^(?!)")
    assert taken == rows() and sum("fields=[Row(" in r for r in taken) > 150


def test_sql_functions_are_the_same_by_the_longer_way(spark, monkeypatch):
    rows_ = [(i, kind, t, [(k, x.replace("=", ":").partition(":")[2], x, 1) for x in (t or "").splitlines() for k in ("balance", "patient", "service_date")]) for i, t in enumerate([None, *texts()]) for kind in ("bill", "eob")]
    spark.createDataFrame(rows_, "id int, kind string, text string, proposals array<struct<key:string,value:string,quote:string,page:int>>").repartition(4).createOrReplaceTempView("taken_docs")

    def rows() -> list[str]:
        tables.register(spark)
        return sorted(map(repr, spark.sql("SELECT id, kind, ll_field_array(text, kind) AS a, ll_validated_array(text, proposals) AS b FROM taken_docs").collect()))

    short = rows()
    for name in ("PLAIN", "CANONICAL_MONEY", "CANONICAL_DATE"):
        monkeypatch.setattr(K, name, r"^(?!)")
    long = rows()
    monkeypatch.undo()
    tables.register(spark)
    assert short == long and sum("a=[Row(" in r for r in short) > 200 and sum("b=[Row(" in r for r in short) > 100


def test_proposals_are_made_where_documents_lie(spark):
    plan = __spark_entry__.queries()["validate_fields"](spark, BASE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate stack" not in plan and "SortMergeJoin" not in plan


def test_rules_see_few_lines(spark):
    known = __spark_entry__.queries()
    assert "array_position" in known["local_fields"](spark, BASE)._jdf.queryExecution().executedPlan().toString()
