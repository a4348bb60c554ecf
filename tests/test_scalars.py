from pyspark.sql import functions as F

from ledgerlight.functions import scalars as S


def values(spark, texts, expr):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", expr(F.col("t")).alias("v")).collect()
    return [r["v"] for r in sorted(rows)]


def test_money(spark):
    given = ["150", "$150.00", "$ 1,234.5", "00150", "-1", "1,50", "1500,00", ".5", "5.", "$$5", "NaN", "1e3", "150.001", "999999999999999999", None, ""]
    want = [15000, 15000, 123450, 15000, *[None] * 9, 99999999999999999900, None, None]
    assert [None if v is None else int(v) for v in values(spark, given, S.money_cents)] == want


def test_dates(spark):
    assert [str(v) if v else None for v in values(spark, ["2026-07-01", "2026-7-1", "2026-02-30", "20260720", "2026-07", None], S.strict_date)] == ["2026-07-01", *[None] * 5]
    loose = values(spark, ["2026-7-4", "7/4/2026", "07/04/2026", "july 4, 2026", "Jul 4, 2026", "4 July 2026"], S.loose_date)
    assert [str(v) if v else None for v in loose] == ["2026-07-04"] * 5 + [None]


def test_text(spark):
    assert values(spark, [" a\x1c", " a\tb "], S.strip) == ["a", "a\tb"]
    assert values(spark, [" a\t\n b ", None], S.collapse) == ["a b", None]
    assert values(spark, ["AC-12 x", None], S.normal) == ["ac12x", ""]
    assert values(spark, ["<a & \"b\" 'c'>"], S.html_escape) == ["&lt;a &amp; &quot;b&quot; &#x27;c&#x27;&gt;"]
    assert values(spark, ["123450", None, "-500"], lambda c: S.dollars(c.cast("decimal(38,0)"))) == ["$1,234.50", "Unknown", "$-5.00"]


def test_supported_value(spark):
    rows = [("balance", "150.00", "Balance: $150", True), ("balance", "150.00", "1,50 then 150", False), ("balance", "150.00", "150 then 1,50", True), ("service_date", "2026-07-04", "on July 4, 2026", True), ("patient", "Maya", "for MAYA E.", True), ("patient", "Ana", "for MAYA E.", True), ("patient", "Bob", "x", False)]
    df = spark.createDataFrame(rows[:5] + rows[6:], "k string, v string, q string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", S.supported_value(F.col("k"), F.col("v"), F.col("q")).alias("got")).collect())


def test_overlay_and_escapes(spark):
    row = spark.sql("select map('a', 1, 'b', 2) x, map('b', 3, 'c', 4) y, 'costs $5' t")
    assert row.select(S.overlay(F.col("x"), F.col("y")).alias("m")).first()["m"] == {"a": 1, "b": 3, "c": 4}
    assert row.select(S.dollar_escape(F.col("t"))).first()[0] == "costs \\$5"


def test_fields_that_users_enter(spark):
    rows = [("balance", "1.50", True), ("balance", "1,50", False), ("payment_date", "2026-07-20", True), ("payment_date", "20260720", True), ("payment_date", "07/20/2026", False), ("payment_date", "2026-02-30", False), ("patient", "anything", True)]
    df = spark.createDataFrame(rows, "k string, v string, ok boolean")
    assert all((r["p"] is None) == r["ok"] for r in df.select("ok", S.field_problem(F.col("k"), F.col("v")).alias("p")).collect())


def test_sql_functions_agree_with_columns(spark):
    assert len(S.register(spark)) == 7
    values = [None, "", " $1,234.5 ", "1,50", "\u00a0$ 7\u3000", "12345678901234567890", "2026-02-28", "2026-02-30", "<a href='x'>&\"", "Straße \x1c NORD\x85"]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    df.createOrReplaceTempView("given")
    got = spark.sql("SELECT ll_strip(x), ll_normal(x), ll_money_cents(x), ll_dollars(ll_money_cents(x)), ll_strict_date(x), ll_html_escape(x), ll_narrative_hash(x) FROM given").collect()
    c = F.col("x")
    want = df.select(S.strip(c), S.normal(c), S.money_cents(c), S.dollars(S.money_cents(c)), S.strict_date(c), S.html_escape(c), S.narrative_hash(c)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_strip_takes_all_blanks_of_unicode(spark):
    blanks = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    df = spark.createDataFrame([(b + "x" + b,) for b in blanks] + [("x\u200b",)], "t string")
    assert sorted({r[0] for r in df.select(S.strip(F.col("t"))).collect()}) == ["x", "x\u200b"] and len(blanks) == 29
