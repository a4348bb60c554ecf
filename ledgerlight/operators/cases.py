"""Reconciliation of cases in exact cents, with abstention.

Inputs: ``documents`` (case_id, doc_ordinal, doc_id, kind, title, text, included) and ``facts`` (case_id, doc_ordinal, field,
field_ordinal, value, quote, page, confirmed, origin). Both are grouped by case once; after that shuffle every rule is an
expression over the one row of a case, so the rules need no join, no further shuffle and no Python. A case holds a
handful of documents; cases are what runs in parallel.

Unknown never becomes zero: all comparisons of unknowns are made false explicitly, and any open question withholds the
supported balance.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import constants as K
from ledgerlight.functions import wording as W
from ledgerlight.functions.scalars import amount, amount_cents, barrier, collapse, dollars, money_cents, normal, strict_date, strip

BILL_AMOUNTS = ("charges", "adjustments", "insurer_paid", "patient_paid", "balance")
PAYMENT_KEYS = (*K.IDENTITY, "claim_id", "payment_date", "payment_amount", "payment_status")
FINDING = "array<struct<code:string,title:string,detail:string,severity:string,refs:array<string>>>"
LEDGER = "array<struct<label:string,cents:decimal(38,0),refs:array<string>>>"
NONE = "array<string>"


# ---------------------------------------------------------------- one row for each case


def confirmed(facts: DataFrame) -> Column:
    """The stripped value of a confirmed fact that isn't blank, else null."""
    return F.when(F.col("confirmed") & (strip(F.col("value")) != ""), strip(F.col("value")))


def case_rows(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, all_docs): documents in order, each a struct with its confirmed values and references."""
    facts = facts.withColumn("_v", confirmed(facts))
    # each value's normal form, day and cents are computed once, in generated code; the rules compare plain values
    facts = facts.withColumns({"_n": normal(F.col("_v")), "_day": F.when(F.col("field").isin(*K.DATE_FIELDS), strict_date(F.col("_v"))), "_cents": F.when(F.col("field").isin(*K.MONEY_FIELDS), money_cents(F.col("_v")))})
    value = F.when(F.col("_v").isNotNull(), F.struct(F.col("_v").alias("text"), F.col("_n").alias("n"), F.col("_day").alias("day"), F.col("_cents").alias("cents")))
    raw = F.when(F.col("confirmed") & F.col("field").isin("account", "provider"), F.col("value"))  # as it stands, for letters
    by_case = facts.groupBy("case_id").agg(
        F.collect_list(F.struct("doc_ordinal", "field_ordinal", "field", value.alias("v"), (F.col("confirmed") & (F.col("origin") != "document")).alias("own"), (~F.col("confirmed")).alias("pending"), raw.alias("raw"))).alias("facts")
    )
    # of the text only whether two receipts have the same matters: a digest, not the text, goes to the case
    content = F.when(F.col("kind") == "receipt", F.sha2(F.nullif(collapse(F.col("text")), F.lit("")), 256))
    docs = documents.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(F.col("doc_ordinal").alias("ord"), F.col("doc_id").alias("id"), "kind", "title", content.alias("content"), "included"))).alias("docs"))
    joined = docs.join(by_case, "case_id", "left")
    own = lambda d: F.array_sort(F.filter(F.coalesce(F.col("facts"), F.array().cast("array<struct<doc_ordinal:int,field_ordinal:int,field:string,v:struct<text:string,n:string,day:date,cents:decimal(38,0)>,own:boolean,pending:boolean,raw:string>>")), lambda f: f["doc_ordinal"] == d["ord"]))
    step = joined.select("case_id", F.transform("docs", lambda d: F.struct(d.alias("d"), own(d).alias("f"))).alias("pairs"))

    def doc(p: Column) -> Column:
        known = F.filter(p["f"], lambda f: f["v"].isNotNull())
        ref = lambda f: F.concat(p["d"]["id"], F.lit("."), f["field"])
        return F.struct(
            *[p["d"][c].alias(c) for c in ("ord", "id", "kind", "title", "content", "included")],
            F.map_from_entries(F.transform(known, lambda f: F.struct(f["field"], f["v"]))).alias("v"),
            F.array_sort(F.transform(known, lambda f: F.struct(f["field"], f["v"]["text"].alias("v")))).alias("signature"),
            F.transform(known, ref).alias("refs"),
            F.transform(F.filter(p["f"], lambda f: f["own"]), ref).alias("corrected"),
            F.transform(F.filter(p["f"], lambda f: f["raw"].isNotNull()), lambda f: F.struct(f["field"], f["raw"])).alias("addressed"),
            F.size(F.filter(p["f"], lambda f: f["pending"])).alias("pending"),
            F.size(p["f"]).alias("n_facts"),
        )

    return step.select("case_id", F.transform("pairs", doc).alias("all_docs"))


NORMAL_KEYS = (*K.IDENTITY, "claim_id", "payment_date", "payment_reference", "payment_status")  # compared by normal form
STATEMENTS = ("bill", "collection")


def pivoted_rows(documents: DataFrame, parts: tuple[str, ...] | None = None, shown: Column | None = None) -> DataFrame:
    """As ``case_rows``, from documents that hold their facts: a struct column ``facts`` with a struct (value, confirmed, origin)
    for each field of FIELD_LABELS, its value null where there is no such fact. All that a document's row can tell is worked out
    there, in generated code; rows are grouped once, and facts are never rows of their own. ``parts`` names those parts of a
    document that are read (``parts_of``); others are null, as Spark prunes no column inside a grouped list. ``shown`` is a
    struct of a document's row that goes along: those that aren't null are the column shown, an array in their own order."""
    fact = {k: F.col("facts")[k] for k in K.FIELD_LABELS}
    known = {k: F.col(f"_{k}") != "" for k in fact}
    ref = lambda k: F.concat("doc_id", F.lit(f".{k}"))
    some = lambda given: F.array_remove(F.array(*[F.coalesce(F.when(c, ref(k)), F.lit("")) for k, c in given.items()]), "")
    count = lambda conditions: reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in conditions])
    stripped = {k: strip(f["value"]) for k, f in fact.items()}
    # what is used more than once is a column first, so that it is worked out once: Spark shares nothing inside conditions
    docs = documents.withColumns(
        {f"_{k}": F.when(fact[k]["confirmed"], v) for k, v in stripped.items()}
        | {f"_amount_{k}": amount(stripped[k]) for k in K.MONEY_FIELDS}
        | {"_content": F.when(F.col("kind") == "receipt", collapse(F.col("text")))}
    )

    def value(k: str) -> Column:
        v = F.col(f"_{k}")
        given = [F.when(known[k], v).alias("text")]
        if k in NORMAL_KEYS:
            given.append(F.when(known[k], normal(v)).alias("n"))
        if k in K.DATE_FIELDS:
            given.append(strict_date(v).alias("day"))
        if k in K.MONEY_FIELDS:
            given.append(F.when(known[k], amount_cents(F.col(f"_amount_{k}"))).alias("cents"))
        return F.struct(*given).alias(k)

    raw = [F.when(fact[k]["value"].isNotNull() & fact[k]["confirmed"], F.array(F.struct(F.lit(k).alias("field"), fact[k]["value"].alias("raw")))).otherwise(F.array().cast("array<struct<field:string,raw:string>>")) for k in ("provider", "account")]
    whole = {
        "ord": F.col("doc_ordinal"),
        "id": F.col("doc_id"),
        "kind": F.col("kind"),
        "title": F.col("title"),
        "content": F.when(F.col("_content") != "", F.sha2("_content", 256)),
        "included": F.col("included"),
        "v": F.struct(*[value(k) for k in fact]),
        "signature": F.when(F.col("kind").isin(*STATEMENTS), F.struct(*[F.when(known[k], F.col(f"_{k}")).alias(k) for k in fact])),
        "refs": some(known),
        "corrected": some({k: f["value"].isNotNull() & f["confirmed"] & (f["origin"] != "document") for k, f in fact.items()}),
        "addressed": F.concat(*raw),
        "pending": count(f["value"].isNotNull() & ~f["confirmed"] for f in fact.values()),
        "n_facts": count(f["value"].isNotNull() for f in fact.values()),
    }
    types = {f.name: f.dataType for f in docs.select(*[c.alias(n) for n, c in whole.items()]).schema} if parts is not None else {}
    doc = F.struct(*[(c if parts is None or n in parts else F.lit(None).cast(types[n])).alias(n) for n, c in whole.items()])
    along = [] if shown is None else [shown.alias("s")]
    one = docs.select("case_id", F.col("doc_ordinal").alias("_ord"), doc.alias("d"), *along)
    held = one.groupBy("case_id").agg(F.collect_list(F.struct("_ord", "d", *([] if shown is None else ["s"]))).alias("_docs"))
    # ordered by the ordinal alone: documents as wholes aren't compared
    ordered = F.array_sort("_docs", lambda a, b: F.when(a["_ord"] < b["_ord"], -1).when(a["_ord"] > b["_ord"], 1).otherwise(0))
    rows = [F.array_sort(F.filter(F.transform("_docs", lambda x: x["s"]), lambda x: x.isNotNull())).alias("shown")] if along else []
    return held.select("case_id", F.transform(ordered, lambda x: x["d"]).alias("all_docs"), *rows)


CARDS = ("included", "id")
RULED = (*CARDS, "ord", "kind", "v", "signature")  # for what is known of statements
PAID = (*RULED, "content")  # and of payments
TOLD = (*PAID, "refs", "corrected")  # and for findings
#: the parts of documents that columns of a result are made of; all, if a column isn't named here
PARTS = {
    **{c: CARDS for c in ("duplicate_ids",)},
    "corrected": ("included", "corrected"),
    **{c: RULED for c in ("notice", "bill", "notice_copies", "bill_copies", "bill_notice_reason", "timeline_ok", "missing_amounts", "obligation", "expected", "m_balance", "m_patient_paid", "stop", "eobs", "collection_cents")},
    **{c: PAID for c in ("groups", "collisions", "ambiguous", "judged", "earlier", "applied_payments_cents", "supported_balance_cents", "uncertain", "ledger", "matched_document_ids", "excluded_document_ids")},
    **{c: TOLD for c in ("findings",)},
}


def parts_of(*columns: str) -> tuple[str, ...] | None:
    """The parts of documents that some columns of a result are made of, for ``pivoted_rows``; None for all."""
    return tuple(dict.fromkeys(p for c in columns for p in PARTS[c])) if columns and all(c in PARTS for c in columns) else None


def val(d: Column, key: str) -> Column:
    return d["v"][key]["text"]


def plain(d: Column, key: str) -> Column:
    """Lower-case letters and digits of a value; empty without one."""
    return F.coalesce(d["v"][key]["n"], F.lit(""))


def date(d: Column, key: str) -> Column:
    return d["v"][key]["day"]


def money(d: Column, key: str) -> Column:
    return d["v"][key]["cents"]


def refs(d: Column, *keys: str) -> Column:
    """References to the keys that have a confirmed value, in the order asked for."""
    return F.filter(F.array(*[F.when(val(d, k).isNotNull(), F.concat(d["id"], F.lit(f".{k}"))) for k in keys]), lambda x: x.isNotNull())


def mismatch(d: Column, anchor: Column) -> Column:
    """Why two documents are not securely of one account; null if they are."""
    checks = []
    for key in K.IDENTITY:
        a, b, name = val(d, key), val(anchor, key), key.replace("_", " ")
        checks.append(F.when(a.isNull() | b.isNull(), F.lit(f"Confirm {name} on both records.")))
        if key == "account":
            checks.append(F.when(a.rlike(K.MASKED) | b.rlike(K.MASKED), F.lit(W.MASKED_ACCOUNT_REFERENCES_NEED_MANUAL)))
        if key == "service_date":
            x, y = date(d, key), date(anchor, key)
            checks.append(F.when(x.isNull() | y.isNull(), F.lit(W.CONFIRM_AN_UNAMBIGUOUS_SERVICE_DATE)))
            equal = x == y
        else:
            equal = (plain(d, key) != "") & (plain(d, key) == plain(anchor, key))
        checks.append(F.when(~F.coalesce(equal, F.lit(False)), F.lit(f"The confirmed {name} values differ.")))
    a, b = val(d, "claim_id"), val(anchor, "claim_id")
    checks.append(F.when(a.isNotNull() & b.isNotNull() & (plain(d, "claim_id") != plain(anchor, "claim_id")), F.lit(W.THE_CONFIRMED_CLAIM_REFERENCES_DIFFER)))
    return F.coalesce(*checks)


def finding(code: str, title: str | Column, detail: str | Column, references: Column | None = None, severity: str = "warning") -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    given = F.array().cast(NONE) if references is None else F.array_distinct(references)
    return F.array(F.struct(F.lit(code).alias("code"), text(title).alias("title"), text(detail).alias("detail"), F.lit(severity).alias("severity"), given.alias("refs")))


def only(condition: Column, rows: Column, kind: str = FINDING) -> Column:
    return F.when(condition, rows).otherwise(F.array().cast(kind))


def joined(*arrays: Column) -> Column:
    return reduce(F.concat, arrays)


def flat(rows: Column, each, kind: str = FINDING) -> Column:
    return F.coalesce(F.flatten(F.transform(rows, each)), F.array().cast(kind))


def entry(label: str, cents: Column, references: Column) -> Column:
    return F.array(F.struct(F.lit(label).alias("label"), cents.cast("decimal(38,0)").alias("cents"), references.alias("refs")))


# ---------------------------------------------------------------- the rules


def _selected(df: Rules, kind: str, name: str) -> Rules:
    """Adds the applicable statement of a kind (null if none or unclear), copies left out, and findings."""
    df = df.withColumn("_c", F.filter("docs", lambda d: d["kind"] == kind))
    first = F.get("_c", F.lit(0))
    df = df.withColumn("_at", F.array_position(F.transform("_c", lambda d: ~d["signature"].eqNullSafe(first["signature"])), F.lit(True)).cast("int"))
    copies = F.slice("_c", F.lit(2), F.greatest(F.when(F.col("_at") > 0, F.col("_at") - 2).otherwise(F.size("_c") - 1), F.lit(0)))
    other = F.get("_c", F.col("_at") - 1)
    df = df.withColumn("_copies", copies)
    found = joined(
        only(F.size("_c") == 0, finding("insufficient_itemization", f"Add a {kind} record", W.A_CONFIRMED_PROVIDER_BILL_AND)),
        flat(F.col("_copies"), lambda d: finding("duplicate_document", W.DUPLICATE_STATEMENT_COUNTED_ONCE, W.THESE_RECORDS_HAVE_THE_SAME, F.concat(refs(first, "balance"), refs(d, "balance")), "info")),
        only(
            F.col("_at") > 0,
            finding(
                "conflicting_documents", f"Multiple {kind} records need review",
                W.THE_INCLUDED_VERSIONS_CONTAIN_DIFFERENT,
                F.concat(first["refs"], F.coalesce(other["refs"], F.array().cast(NONE))),
            ),
        ),
    )
    return df.withColumns({name: F.when(F.col("_at") == 0, first), f"{name}_copies": F.transform("_copies", lambda d: d["id"]), f"{name}_findings": found}).drop("_c", "_at", "_copies")


def _groups(receipts: Column) -> Column:
    """Receipts linked by a repeated reference or repeated content: arrays of receipts, in order of their first. A fold
    over the case's receipts: each joins, and so joins together, all earlier groups it shares a key with."""
    kind = "array<struct<i:int,root:int,ref:string,content:string>>"
    keys = F.transform(receipts, lambda d, i: F.struct(i.alias("i"), F.nullif(plain(d, "payment_reference"), F.lit("")).alias("ref"), d["content"].alias("content")))

    def add(state: Column, x: Column) -> Column:
        shares = lambda h: F.coalesce(h["ref"] == x["ref"], F.lit(False)) | F.coalesce(h["content"] == x["content"], F.lit(False))
        roots = F.transform(F.filter(state, shares), lambda h: h["root"])
        root = F.least(F.coalesce(F.array_min(roots), x["i"]), x["i"])
        moved = F.transform(state, lambda h: F.struct(h["i"].alias("i"), F.when(F.array_contains(roots, h["root"]), root).otherwise(h["root"]).alias("root"), h["ref"].alias("ref"), h["content"].alias("content")))
        return F.concat(moved, F.array(F.struct(x["i"].alias("i"), root.alias("root"), x["ref"].alias("ref"), x["content"].alias("content"))))

    state = F.aggregate(keys, F.array().cast(kind), add)
    roots = F.array_sort(F.array_distinct(F.transform(state, lambda h: h["root"])))
    return F.transform(roots, lambda r: F.transform(F.filter(state, lambda h: h["root"] == r), lambda h: F.get(receipts, h["i"])))


def _signature(d: Column) -> Column:
    def part(k: str) -> Column:
        if k == "payment_amount":
            return F.coalesce(money(d, k).cast("string"), F.lit("?"))
        n = plain(d, k)
        return F.when(n.isin(*K.SETTLED), F.lit("settled")).otherwise(n) if k == "payment_status" else n

    return F.concat_ws("|", *[part(k) for k in PAYMENT_KEYS])


def _receipt_state(r: Column, bill: Column, notice: Column, ambiguous: Column) -> Column:
    """What becomes of a receipt: (state, reason)."""
    why = mismatch(r, bill)
    paid, issued, bill_date = date(r, "payment_date"), date(r, "statement_date"), date(bill, "statement_date")
    bad_issue = val(r, "statement_date").isNotNull() & (issued.isNull() | F.coalesce(issued < paid, F.lit(False)))
    bad = money(r, "payment_amount").isNull() | paid.isNull() | F.coalesce(paid < date(bill, "service_date"), F.lit(True)) | F.coalesce(paid >= date(notice, "statement_date"), F.lit(True)) | F.coalesce(paid == bill_date, F.lit(True)) | bad_issue
    state = (
        F.when(F.array_contains(ambiguous, r["id"]), "ambiguous")
        .when(why.isNotNull(), "unmatched")
        .when(~plain(r, "payment_status").isin(*K.SETTLED), "unsettled")
        .when(bad, "untimely")
        .when(paid < bill_date, "earlier")
        .otherwise("applied")
    )
    return F.struct(r.alias("r"), state.alias("state"), why.alias("why"), money(r, "payment_amount").alias("cents"), refs(r, "payment_amount", "payment_date", "payment_status", "payment_reference").alias("refs"))


class Rules:
    """Steps that add columns, to be applied to any number of frames. Expressions are made once: each of some thousands is a
    call of the JVM, which takes longer than Spark's planning."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, tuple]] = []

    def withColumns(self, columns: dict[str, Column]) -> Rules:
        self.steps.append(("withColumns", (columns,)))
        return self

    def withColumn(self, name: str, column: Column) -> Rules:
        return self.withColumns({name: column})

    def drop(self, *names: str) -> Rules:
        self.steps.append(("drop", names))
        return self

    def applied(self, df: DataFrame) -> DataFrame:
        for name, given in self.steps:
            df = getattr(df, name)(*given)
        return df


def reconcile(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """One row for each case: findings, ledger, collection_cents, supported_balance_cents, applied_payments_cents,
    matched and excluded document ids, and the intermediate columns that the finer queries read."""
    return reconciled_rows(case_rows(documents, facts))


def reconciled_rows(rows: DataFrame) -> DataFrame:
    """As ``reconcile``, from ``case_rows`` or ``pivoted_rows``."""
    return _rules(rows.sparkSession.sparkContext._jvm).applied(rows)


@lru_cache(maxsize=1)
def _rules(jvm: object) -> Rules:
    """The rules, as expressions of one JVM."""
    df = Rules().withColumns({"docs": F.filter("all_docs", lambda d: d["included"]), "left_out": F.transform(F.filter("all_docs", lambda d: ~d["included"]), lambda d: d["id"])})
    ids = F.transform("docs", lambda d: d["id"])
    df = df.withColumn("duplicate_ids", F.size(F.array_distinct(ids)) != F.size(ids))
    df = df.withColumn("corrected", F.flatten(F.transform("docs", lambda d: d["corrected"])))
    df = _selected(_selected(df, "collection", "notice"), "bill", "bill")
    b, n = F.col("bill"), F.col("notice")
    df = df.withColumns({"bill_notice_reason": F.when(b.isNotNull() & n.isNotNull(), mismatch(b, n)), "collection_known": money(n, "balance"), "service_date": date(b, "service_date"), "bill_date": date(b, "statement_date"), "notice_date": date(n, "statement_date"), **{f"m_{k}": money(b, k) for k in BILL_AMOUNTS}})
    in_order = F.coalesce((F.col("service_date") <= F.col("bill_date")) & (F.col("bill_date") <= F.col("notice_date")), F.lit(False))
    missing = F.filter(F.array(*[F.when(F.col(f"m_{k}").isNull(), F.lit(k.replace("_", " "))) for k in BILL_AMOUNTS], F.when(F.col("collection_known").isNull(), F.lit("collection balance"))), lambda x: x.isNotNull())
    obligation = (F.col("m_charges") - F.col("m_adjustments") - F.col("m_insurer_paid")).cast("decimal(38,0)")
    df = df.withColumns({"timeline_ok": in_order, "missing_amounts": missing, "obligation": obligation, "expected": (obligation - F.col("m_patient_paid")).cast("decimal(38,0)")})
    # the step at which the case stops early; 99 if it runs to its end
    stop = (
        F.when(F.col("duplicate_ids"), 2)
        .when(b.isNull() | n.isNull(), 4)
        .when(F.col("bill_notice_reason").isNotNull(), 5)
        .when(~F.col("timeline_ok"), 6)
        .when(F.size("missing_amounts") > 0, 7)
        .when((F.col("expected") < 0) | (F.col("expected") != F.col("m_balance")), 8)
        .otherwise(99)
    )
    df = df.withColumn("stop", stop)
    reached = F.col("stop") == 99
    none = F.array()
    # insurance explanations
    eob_date = lambda d: date(d, "statement_date")
    df = df.withColumn("eobs", F.when(reached, F.transform(F.filter("docs", lambda d: d["kind"] == "eob"), lambda d: F.struct(d.alias("d"), mismatch(d, b).alias("why"), F.coalesce((F.col("service_date") <= eob_date(d)) & (eob_date(d) <= F.col("notice_date")), F.lit(False)).alias("timely")))))
    checks = {"charges": F.col("m_charges"), "adjustments": F.col("m_adjustments"), "allowed": F.col("m_charges") - F.col("m_adjustments"), "insurer_paid": F.col("m_insurer_paid"), "patient_responsibility": F.col("obligation")}
    differs = lambda d, k: val(d, k).isNotNull() & ~money(d, k).eqNullSafe(checks[k].cast("decimal(38,0)"))
    ok = lambda e: e["why"].isNull() & e["timely"]
    df = df.withColumn("eobs", F.transform("eobs", lambda e: F.struct(e["d"].alias("d"), e["why"].alias("why"), e["timely"].alias("timely"), F.when(ok(e), F.filter(F.array(*[F.when(differs(e["d"], k), F.lit(k)) for k in checks]), lambda x: x.isNotNull())).otherwise(F.array().cast(NONE)).alias("conflicts"))))
    # payments
    df = df.withColumn("receipts", F.when(reached, F.filter("docs", lambda d: d["kind"] == "receipt")))
    df = df.withColumn("groups", F.when(reached, _groups(F.col("receipts"))))
    raw_refs = lambda g: F.array_distinct(F.transform(F.filter(g, lambda d: val(d, "payment_reference").isNotNull()), lambda d: plain(d, "payment_reference")))
    clash = lambda g: (F.size(raw_refs(g)) > 1) | (F.size(F.array_distinct(F.transform(g, _signature))) > 1)
    df = df.withColumn("groups", F.transform("groups", lambda g: F.struct(g.alias("members"), clash(g).alias("conflict"))))
    df = df.withColumn("payments", F.transform(F.filter("groups", lambda g: ~g["conflict"]), lambda g: g["members"][0]))
    identity = lambda d: F.concat_ws("|", *[plain(d, k) for k in (*K.IDENTITY, "payment_date")], F.coalesce(money(d, "payment_amount").cast("string"), F.lit("?")))
    df = df.withColumn("prints", F.transform("payments", identity))
    alike = lambda p: F.filter("payments", lambda d: identity(d) == p)
    df = df.withColumn("collisions", F.filter(F.transform(F.array_distinct("prints"), alike), lambda g: (F.size(g) > 1) & F.exists(g, lambda d: val(d, "payment_reference").isNull())))
    df = df.withColumn("ambiguous", F.transform(F.flatten("collisions"), lambda d: d["id"]))
    df = df.withColumn("judged", F.transform("payments", lambda r: _receipt_state(r, b, n, F.col("ambiguous"))))
    of = lambda s: F.filter("judged", lambda j: j["state"] == s)
    zero = F.lit(0).cast("decimal(38,0)")
    total = lambda s: F.coalesce(F.aggregate(of(s), zero, lambda a, j: (a + j["cents"]).cast("decimal(38,0)")), zero)
    all_refs = lambda s: F.coalesce(F.flatten(F.transform(of(s), lambda j: j["refs"])), F.array().cast(NONE))
    df = df.withColumns({"applied": total("applied"), "earlier": total("earlier"), "applied_refs": all_refs("applied"), "earlier_refs": all_refs("earlier")})
    df = df.withColumn("remaining", F.when(reached, (F.col("m_balance") - F.col("applied")).cast("decimal(38,0)")))
    uncertain = (
        F.exists("eobs", lambda e: ~ok(e) | (F.size(e["conflicts"]) > 0))
        | F.exists("groups", lambda g: g["conflict"])
        | (F.size("collisions") > 0)
        | F.exists("judged", lambda j: j["state"].isin("unmatched", "unsettled", "untimely"))
        | (F.col("earlier") > F.col("m_patient_paid"))
        | (F.col("remaining") < 0)
    )
    df = df.withColumn("uncertain", F.coalesce(reached & uncertain, F.lit(False)))
    df = df.withColumn("supported", F.when(reached & ~F.col("uncertain"), F.col("remaining")))
    df = df.withColumn("difference", F.col("collection_known") - F.col("supported"))
    return _results(df, ok)


def _results(df: Rules, ok) -> Rules:
    b, n, reached, past = F.col("bill"), F.col("notice"), F.col("stop") == 99, lambda k: F.col("stop") > k
    ident = (*K.IDENTITY, "claim_id")
    early = joined(
        only(F.col("duplicate_ids"), finding("conflicting_documents", W.DOCUMENT_IDENTIFIERS_MUST_BE_UNIQUE, W.TWO_INCLUDED_RECORDS_SHARE_AN)),
        only(
            past(2) & (F.size("corrected") > 0),
            finding("user_corrected_facts", W.USING_YOUR_CONFIRMED_CORRECTIONS, W.THESE_VALUES_WERE_CORRECTED_BY, F.col("corrected"), "info"),
        ),
        F.when(past(2), F.concat("notice_findings", "bill_findings")).otherwise(F.array().cast(FINDING)),
        only(F.col("stop") == 5, finding("ambiguous_document_match", W.BILL_AND_COLLECTION_NOTICE_DO, F.col("bill_notice_reason"), F.concat(refs(b, *ident), refs(n, *ident)))),
        only(
            F.col("stop") == 6,
            finding(
                "ambiguous_document_dates", W.CONFIRM_THE_DOCUMENT_TIMELINE,
                W.USE_YYYY_MM_DD_DATES,
                F.concat(refs(b, "service_date", "statement_date"), refs(n, "statement_date")),
            ),
        ),
        only(
            F.col("stop") == 7,
            finding(
                "insufficient_itemization", W.CONFIRM_THE_ACCOUNT_AMOUNTS,
                F.concat(F.lit(W.MISSING_UNCONFIRMED_OR_INVALID), F.array_join("missing_amounts", ", "), F.lit(W.ENTER_EXACT_NONNEGATIVE_DOLLAR_AMOUNTS)),
                F.concat(refs(b, *BILL_AMOUNTS), refs(n, "balance")),
            ),
        ),
        only(
            F.col("stop") == 8,
            finding(
                "amount_mismatch", W.THE_PROVIDER_STATEMENT_DOES_NOT,
                F.concat(F.lit(W.CHARGES_MINUS_ADJUSTMENTS_POSTED_INSURER), dollars(F.col("expected")), F.lit(W.THE_STATEMENT_REPORTS), dollars(F.col("m_balance")), F.lit(W.REQUEST_AN_ITEMIZED_LEDGER_BEFORE)),
                refs(b, *BILL_AMOUNTS),
            ),
        ),
    )

    def eob_findings(e: Column) -> Column:
        d = e["d"]
        return joined(
            finding("eob_is_not_payment_proof", W.INSURANCE_RESPONSIBILITY_IS_NOT_PATIENT, W.AN_EOB_DESCRIBES_INSURANCE_PROCESSING, refs(d, "patient_responsibility", "insurer_paid"), "info"),
            only(~ok(e), finding("ambiguous_document_match", W.INSURANCE_RECORD_NEEDS_MATCHING_REVIEW, F.coalesce(e["why"], F.lit(W.CONFIRM_WHETHER_THIS_DATED_INSURANCE)), refs(d, *ident, "statement_date"))),
            flat(
                e["conflicts"],
                lambda k: finding(
                    "conflicting_documents", W.INSURANCE_AND_PROVIDER_AMOUNTS_DIFFER,
                    F.concat(F.lit("The insurance "), F.replace(k, F.lit("_"), F.lit(" ")), F.lit(W.DOES_NOT_AGREE_WITH_THE)),
                    F.concat(F.array(F.concat(d["id"], F.lit("."), k)), refs(b, *BILL_AMOUNTS)),
                ),
            ),
        )

    def group_findings(g: Column) -> Column:
        m = g["members"]
        copies = F.slice(m, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0)))
        return F.when(
            g["conflict"],
            finding(
                "conflicting_payment_evidence", W.PAYMENT_RECORDS_CONFLICT,
                W.RECORDS_FOR_THE_SAME_PAYMENT,
                F.flatten(F.transform(m, lambda d: refs(d, *PAYMENT_KEYS, "payment_reference"))),
            ),
        ).otherwise(
            flat(copies, lambda d: finding("duplicate_payment_evidence", W.SAME_PAYMENT_COUNTED_ONCE, W.THE_PAYMENT_REFERENCE_OR_IDENTICAL, F.concat(refs(m[0], "payment_reference", "payment_amount"), refs(d, "payment_reference", "payment_amount")), "info"))
        )

    def collision_finding(g: Column) -> Column:
        return finding(
            "ambiguous_payment_identity", W.POSSIBLE_DUPLICATE_PAYMENT_RECORDS,
            W.THE_SAME_ACCOUNT_AMOUNT_AND,
            F.flatten(F.transform(g, lambda d: refs(d, "payment_amount", "payment_date", "payment_reference"))),
        )

    def receipt_findings(j: Column) -> Column:
        r, s = j["r"], j["state"]
        return (
            F.when(s == "unmatched", finding("ambiguous_document_match", W.RECEIPT_CANNOT_BE_APPLIED_TO, j["why"], F.concat(refs(r, *ident), refs(b, *ident))))
            .when(s == "unsettled", finding("payment_not_settled", W.PAYMENT_STATUS_DOES_NOT_SUPPORT, W.THE_PAYMENT_IS_REVERSED_UNSUCCESSFUL, j["refs"]))
            .when(
                s == "untimely",
                finding(
                    "ambiguous_payment_timing", W.PAYMENT_AMOUNT_OR_TIMING_NEEDS,
                    W.CONFIRM_THE_AMOUNT_AND_YYYY,
                    F.concat(j["refs"], refs(r, "statement_date"), refs(b, "statement_date"), refs(n, "statement_date")),
                ),
            )
            .when(
                s == "earlier",
                finding(
                    "payment_already_in_statement", W.EARLIER_PAYMENT_NOT_SUBTRACTED_AGAIN,
                    W.THIS_RECEIPT_PREDATES_THE_PROVIDER,
                    F.concat(j["refs"], refs(b, "patient_paid")), "info",
                ),
            )
            .otherwise(F.array().cast(FINDING))
        )

    closed = F.coalesce(F.col("supported").isNotNull(), F.lit(False))
    late = joined(
        flat(F.col("eobs"), eob_findings),
        only(F.size("receipts") == 0, finding("missing_payment_evidence", W.PAYMENT_RECEIPT_NEEDED, W.NO_INCLUDED_PAYMENT_RECEIPT_SUPPORTS, refs(b, "balance"))),
        flat(F.col("groups"), group_findings),
        flat(F.col("collisions"), collision_finding),
        flat(F.col("judged"), receipt_findings),
        only(
            F.col("earlier") > F.col("m_patient_paid"),
            finding(
                "unresolved_payment_allocation", W.EARLIER_RECEIPTS_EXCEED_POSTED_PATIENT,
                W.THE_EARLIER_RECEIPTS_CANNOT_ALL,
                F.concat("earlier_refs", refs(b, "patient_paid")),
            ),
        ),
        only(
            F.col("remaining") < 0,
            finding(
                "payment_exceeds_statement_balance", W.PAYMENTS_EXCEED_THE_STATEMENT_BALANCE,
                W.MATCHING_RECEIPTS_EXCEED_THE_BALANCE,
                F.concat("applied_refs", refs(b, "balance")),
            ),
        ),
        only(
            F.col("uncertain"),
            finding("reconciliation_incomplete", W.RESOLVE_THE_HIGHLIGHTED_EVIDENCE_BEFORE, W.A_FINAL_SUPPORTED_BALANCE_IS),
        ),
        F.when(
            closed & (F.col("difference") > 0) & (F.col("applied") != 0),
            finding(
                "possible_uncredited_payment", W.A_PAYMENT_MAY_NOT_BE,
                F.concat(
                    F.lit(W.THE_MATCHING_COMPLETED_RECEIPT_S), dollars(F.col("applied")), F.lit(W.PAID_AFTER_THE_PROVIDER_STATEMENT), dollars(F.col("supported")),
                    F.lit(W.WHILE_THE_NOTICE_REQUESTS), dollars(F.col("collection_known")), F.lit(W.REQUEST_AN_UPDATED_ITEMIZED_LEDGER),
                ),
                F.concat("applied_refs", refs(b, "balance", "statement_date"), refs(n, "balance", "statement_date")),
            ),
        )
        .when(
            closed & (F.col("difference") != 0),
            finding(
                "amount_mismatch", W.THE_SUPPLIED_BALANCES_DIFFER,
                F.concat(F.lit(W.THE_NOTICE_REQUESTS), dollars(F.col("collection_known")), F.lit(W.THE_SUPPLIED_RECORD_CALCULATION_IS), dollars(F.col("supported")), F.lit(W.ASK_FOR_THE_TRANSACTIONS_EXPLAINING)),
                F.concat(refs(b, "balance"), refs(n, "balance"), F.col("applied_refs")),
            ),
        )
        .when(
            closed & (F.size("receipts") > 0),
            finding(
                "no_discrepancy_detected_in_supplied_records", W.SUPPLIED_AMOUNTS_RECONCILE,
                W.NO_BALANCE_DISCREPANCY_WAS_DETECTED,
                F.concat(refs(b, "balance"), refs(n, "balance"), F.col("applied_refs")), "info",
            ),
        )
        .otherwise(F.array().cast(FINDING)),
    )
    df = df.withColumns({"early_findings": early, "late_findings": F.when(reached, late).otherwise(F.array().cast(FINDING))})
    signed = joined(
        *[entry(label, sign * F.col(f"m_{k}"), refs(b, k)) for k, label, sign in (("charges", "Provider charges", 1), ("adjustments", W.CONTRACTUAL_ADJUSTMENT, -1), ("insurer_paid", W.POSTED_INSURER_PAYMENT, -1), ("patient_paid", W.PATIENT_PAYMENTS_ALREADY_POSTED, -1))],
        entry(W.PROVIDER_STATEMENT_BALANCE, F.col("m_balance"), refs(b, "balance")),
    )
    ledger = joined(
        only(past(7), signed, LEDGER),
        flat(F.filter("judged", lambda j: j["state"] == "applied"), lambda j: entry(W.MATCHING_COMPLETED_PAYMENT_AFTER_STATEMENT, -j["cents"], j["refs"]), LEDGER),
        only(closed, entry(W.BALANCE_SUPPORTED_BY_SUPPLIED_RECORDS, F.col("supported"), F.concat(refs(b, "balance"), F.col("applied_refs"))), LEDGER),
    )
    ids = lambda rows, f: F.coalesce(F.transform(rows, f), F.array().cast(NONE))
    matched = joined(
        F.when(past(5), F.array(b["id"], n["id"])).otherwise(F.array().cast(NONE)),
        ids(F.filter("eobs", ok), lambda e: e["d"]["id"]),
        ids(F.filter("judged", lambda j: j["state"].isin("unsettled", "untimely", "earlier", "applied")), lambda j: j["r"]["id"]),
    )
    in_group = lambda g: F.when(g["conflict"], F.transform(g["members"], lambda d: d["id"])).otherwise(F.transform(F.slice(g["members"], F.lit(2), F.greatest(F.size(g["members"]) - 1, F.lit(0))), lambda d: d["id"]))
    excluded = joined(
        F.col("left_out"),
        F.when(past(2), F.concat("notice_copies", "bill_copies")).otherwise(F.array().cast(NONE)),
        F.when(F.col("stop") == 5, F.array(b["id"])).otherwise(F.array().cast(NONE)),
        ids(F.filter("eobs", lambda e: ~ok(e)), lambda e: e["d"]["id"]),
        flat(F.col("groups"), in_group, NONE),
        ids(F.filter("judged", lambda j: j["state"].isin("ambiguous", "unmatched")), lambda j: j["r"]["id"]),
    )
    return df.withColumns(
        {
            "findings": F.concat("early_findings", "late_findings"),
            "ledger": ledger,
            "collection_cents": F.when(past(2), F.col("collection_known")),
            "supported_balance_cents": F.col("supported"),
            "applied_payments_cents": F.when(reached, F.col("applied")).otherwise(F.lit(0).cast("decimal(38,0)")),
            "matched_document_ids": F.array_distinct(matched),
            "excluded_document_ids": F.array_distinct(excluded),
        }
    ).drop("early_findings", "late_findings")


def settled(result: DataFrame, *columns: str) -> DataFrame:
    """Some columns of a result behind a barrier: filters on them aren't pushed below it, where they would be rewritten
    in terms of the inputs, over and over, for each of the rules they depend on."""
    return barrier(result.select("case_id", *columns), "case_id")


def _exploded(result: DataFrame, column: str) -> DataFrame:
    return settled(result, column).select("case_id", F.posexplode(column).alias("seq", "x")).select("case_id", "seq", "x.*")


def findings(result: DataFrame) -> DataFrame:
    """(case_id, seq, code, title, detail, severity, refs), seq from 0 in order of emission."""
    return _exploded(result, "findings")


def ledger(result: DataFrame) -> DataFrame:
    return _exploded(result, "ledger")
