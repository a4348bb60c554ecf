"""Letters and packet sections for reconciled cases: string aggregation in the JVM, escaped throughout."""

from __future__ import annotations

from functools import reduce
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import constants as K
from ledgerlight.functions import wording as W
from ledgerlight.functions.scalars import dollars, html_escape
from ledgerlight.operators import cases

LETTER_CODES = ("possible_uncredited_payment", "amount_mismatch", "insufficient_itemization", "ambiguous_document_match", "missing_payment_evidence", "user_corrected_facts")
RECIPIENTS = ("provider", "collector")
# Official guidance that a packet lists (fixed values).
SOURCES = {
    "CFPB: responding to a debt collector": "https://www.consumerfinance.gov/ask-cfpb/what-should-i-do-when-a-debt-collector-contacts-me-en-1695/",
    "CFPB: validation information": "https://www.consumerfinance.gov/ask-cfpb/what-information-does-a-debt-collector-have-to-give-me-about-the-debt-en-331/",
    "CMS: understanding an explanation of benefits": "https://www.cms.gov/initiatives/your-patient-rights/medical-bill-rights/get-help/medical-bill-guides-resources/how-read-health-insurance-explanation-benefits",
}


def single_confirmed(documents: DataFrame, facts: DataFrame, kind: str, key: str) -> DataFrame:
    """(case_id, value): the confirmed value if exactly one included document of the kind has one (blank ones count)."""
    docs = documents.where(F.col("included") & (F.col("kind") == kind)).select("case_id", "doc_ordinal")
    hits = facts.where((F.col("field") == key) & F.col("confirmed")).join(docs, ["case_id", "doc_ordinal"], "left_semi")
    return hits.groupBy("case_id").agg(F.when(F.count(F.lit(1)) == 1, F.min("value")).alias("value"))


LETTER_COLUMNS = ("all_docs", "findings", "collection_cents")
LETTER_PARTS = (*cases.TOLD, "addressed")


def letter_text(result: DataFrame, *, as_of: str, recipient: str = "provider") -> DataFrame:
    """(case_id, letter), from the result's LETTER_COLUMNS alone. The date is given, so that a letter can be made again."""
    return result.select("case_id", _letter(as_of, recipient).alias("letter"))


def _single(kind: str, key: str) -> Column:
    """As ``single_confirmed``, from a case's row."""
    documents = F.filter("all_docs", lambda d: d["included"] & (d["kind"] == kind))
    hits = F.flatten(F.transform(documents, lambda d: F.transform(F.filter(d["addressed"], lambda f: f["field"] == key), lambda f: f["raw"])))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def _letter(as_of: str, recipient: str) -> Column:
    """From a result's LETTER_COLUMNS."""
    account, provider = _single("collection", "account"), _single("bill", "provider")
    if recipient not in RECIPIENTS:
        raise ValueError("Choose provider or collector.")
    if recipient == "provider":
        greeting = F.concat(F.lit("To the billing team"), F.coalesce(F.concat(F.lit(" at "), F.nullif(provider, F.lit(""))), F.lit("")), F.lit(","))
        opening = W.I_AM_REQUESTING_A_REVIEW
    else:
        greeting = F.lit(W.TO_THE_DEBT_COLLECTOR)
        opening = W.I_AM_WRITING_ABOUT_YOUR
    useful = F.filter("findings", lambda f: f["code"].isin(*LETTER_CODES))
    bullet = lambda f: F.concat(F.lit("- "), f["detail"], F.when(F.size(f["refs"]) > 0, F.concat(F.lit(" [Evidence: "), F.array_join(f["refs"], ", "), F.lit("]"))).otherwise(F.lit("")))
    some = lambda c, *parts: F.when(c, F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise(F.array().cast("array<string>"))
    always = F.lit(True)
    body = F.flatten(
        F.array(
            some(always, as_of, "", greeting, "", opening),
            some(F.coalesce(account != "", F.lit(False)), "", F.concat(F.lit(W.ACCOUNT_REFERENCE_SHOWN_ON_THE), account, F.lit("."))),
            some(F.col("collection_cents").isNotNull(), F.concat(F.lit(W.THE_SUPPLIED_COLLECTION_NOTICE_REQUESTS), dollars(F.col("collection_cents")), F.lit("."))),
            some(F.size(useful) > 0, "", W.THE_FOLLOWING_POINTS_NEED_CLARIFICATION),
            F.transform(useful, bullet),
            some(
                always, "",
                W.PLEASE_IDENTIFY_THE_ORIGINAL_PROVIDER,
                "", W.THIS_REQUEST_IS_BASED_ON,
                "", "Sincerely,", "[Your name]", W.YOUR_PREFERRED_REPLY_ADDRESS,
            ),
        )
    )
    return F.array_join(body, "\n")


def attachments(documents: DataFrame) -> DataFrame:
    """(case_id, attachments): a list item for each included document, in order."""
    return _documents(documents).select("case_id", _joined("_d").alias("attachments"))


def fact_rows(documents: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(case_id, fact_rows): a table row for each confirmed fact of an included document, in order. Without ``facts``,
    documents hold them (as ``cases.pivoted_rows`` takes them, with quote and page)."""
    return _exhibits(documents, facts).where("size(_f) > 0").select("case_id", _joined("_f").alias("fact_rows"))


def _joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x["html"]), "")


def _item() -> Column:
    """A document's list item."""
    label = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in K.KINDS.items()], F.col("kind"))
    return F.concat(F.lit("<li>"), html_escape(F.col("title")), F.lit(" · "), html_escape(label), F.lit(" · "), html_escape(F.col("doc_id")), F.lit("</li>"))


def _documents(documents: DataFrame, *more: Column) -> DataFrame:
    return documents.where("included").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("doc_ordinal", "doc_id", _item().alias("html"), *more))).alias("_d"))


def _held_rows(name: Column) -> Column:
    """The rows of a document's confirmed facts, from a document that holds them, as one text; null without any."""
    fact = {k: F.col("facts")[k] for k in K.FIELD_LABELS}
    shown = {k: f["value"].isNotNull() & f["confirmed"] for k, f in fact.items()}

    def row(k: str, label: str) -> Column:
        note = F.when(fact[k]["origin"] == "user", escape(W.USER_CORRECTED_VALUE_ORIGINAL_SOURCE)).otherwise(escape(W.REVIEWED_DOCUMENT_EXTRACTION))
        return F.concat(
            F.lit("<tr><td>"), name, F.lit(f".{escape(k)}</td><td>{escape(label)}<br><strong>"), html_escape(fact[k]["value"]),
            F.lit("</strong></td><td>Page "), fact[k]["page"].cast("string"), F.lit(": "), html_escape(fact[k]["quote"]), F.lit("<br><small>"), note, F.lit("</small></td></tr>"),
        )

    return F.when(reduce(lambda a, b: a | b, shown.values()), F.concat_ws("", *[F.when(shown[k], row(k, label)) for k, label in K.FIELD_LABELS.items()]))


def _held_exhibits(documents: DataFrame) -> DataFrame:
    """As ``_exhibits``, from documents that hold their facts: a document's rows are written where it lies, in generated code,
    and go to the case as one text."""
    held = _documents(documents.withColumn("_id", html_escape(F.col("doc_id"))), _held_rows(F.col("_id")).alias("rows"))
    return held.select("case_id", "_d", F.transform(F.filter("_d", lambda d: d["rows"].isNotNull()), lambda d: F.struct(d["rows"].alias("html"))).alias("_f"))


def exhibited_rows(documents: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """``cases.pivoted_rows`` with what a packet shows of the documents, so that it comes from the one row of a case: attachments
    and fact_rows, in mark-up. Documents are grouped once and joined with nothing."""
    named = documents.withColumn("_id", html_escape(F.col("doc_id")))
    shown = F.when(F.col("included"), F.struct("doc_ordinal", "doc_id", _item().alias("html"), _held_rows(F.col("_id")).alias("rows")))
    rows = cases.pivoted_rows(named, parts, shown)
    facts = F.array_join(F.transform("shown", lambda d: d["rows"]), "")  # nulls aren't joined
    return rows.withColumns({"attachments": _joined("shown"), "fact_rows": facts}).drop("shown")


def _exhibits(documents: DataFrame, facts: DataFrame | None) -> DataFrame:
    """(case_id, _d, _f): mark-up of the included documents of a case and of their confirmed facts. Each table goes to its
    case once; facts find their document there."""
    if facts is None:
        return _held_exhibits(documents)
    label = F.coalesce(*[F.when(F.col("field") == k, F.lit(v)) for k, v in K.FIELD_LABELS.items()], F.col("field"))
    note = F.when(F.col("origin") == "user", W.USER_CORRECTED_VALUE_ORIGINAL_SOURCE).otherwise(W.REVIEWED_DOCUMENT_EXTRACTION)
    rest = F.concat(
        F.lit("</td><td>"), html_escape(label), F.lit("<br><strong>"), html_escape(F.col("value")),
        F.lit("</strong></td><td>Page "), F.col("page").cast("string"), F.lit(": "), html_escape(F.col("quote")), F.lit("<br><small>"), html_escape(note), F.lit("</small></td></tr>"),
    )
    rows = facts.where("confirmed").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("doc_ordinal", "field_ordinal", "field", rest.alias("rest")))).alias("_r"))
    held = _documents(documents).join(rows, "case_id", "left")
    name = lambda f: F.get(F.filter("_d", lambda d: d["doc_ordinal"] == f["doc_ordinal"]), F.lit(0))["doc_id"]
    item = lambda f: F.struct(F.concat(F.lit("<tr><td>"), html_escape(F.concat(name(f), F.lit("."), f["field"])), f["rest"]).alias("html"))
    known = F.filter(F.coalesce("_r", F.expr("array()")), lambda f: F.exists("_d", lambda d: d["doc_ordinal"] == f["doc_ordinal"]))
    return held.select("case_id", "_d", F.transform(known, item).alias("_f"))


def finding_sections(result: DataFrame) -> DataFrame:
    findings, ledger = _sections()
    return result.select("case_id", findings.alias("findings_html"), ledger.alias("ledger_html"))


def _sections() -> tuple[Column, Column]:
    """Mark-up of the columns findings and ledger."""
    one = lambda f: F.concat(F.lit("<article><h3>"), html_escape(f["title"]), F.lit("</h3><p>"), html_escape(f["detail"]), F.lit("</p><small>"), html_escape(F.array_join(f["refs"], ", ")), F.lit("</small></article>"))
    row = lambda x: F.concat(F.lit("<tr><td>"), html_escape(x["label"]), F.lit("</td><td>"), html_escape(dollars(x["cents"])), F.lit("</td><td>"), html_escape(F.array_join(x["refs"], ", ")), F.lit("</td></tr>"))
    return F.array_join(F.transform("findings", one), ""), F.array_join(F.transform("ledger", row), "")


PACKET_COLUMNS = (*LETTER_COLUMNS, "ledger")
EXHIBITS = ("attachments", "fact_rows")


def packets(result: DataFrame, documents: DataFrame | None = None, facts: DataFrame | None = None, *, as_of: str, recipient: str = "provider", override: DataFrame | None = None) -> DataFrame:
    """(case_id, html): the whole packet, from the result's PACKET_COLUMNS. ``override`` (case_id, letter) replaces drafted
    letters. Without ``facts``, documents hold them. Without ``documents``, the result has EXHIBITS too, and nothing is joined or grouped again (``exhibited_rows``).
    Letter, findings and ledger come from the one row of a case, so it is reconciled once; with exhibits of frames that is four exchanges, all by case."""
    findings, ledger = _sections()
    rows = result.select("case_id", findings.alias("findings_html"), ledger.alias("ledger_html"), _letter(as_of, recipient).alias("letter"), *(EXHIBITS if documents is None else ()))
    if override is not None:
        rows = rows.join(override.select("case_id", F.col("letter").alias("edited")), "case_id", "left")
    else:
        rows = rows.withColumn("edited", F.lit(None).cast("string"))
    all_ = rows
    if documents is not None:
        all_ = rows.join(_exhibits(documents, facts).select("case_id", _joined("_d").alias("attachments"), _joined("_f").alias("fact_rows")), "case_id", "left")
    note = F.when(F.col("edited").isNotNull(), W.EDITED_DRAFT_SUPPLIED_BY_THE).otherwise(W.DRAFT_ASSEMBLED_FROM_THE_CONFIRMED)
    sources = "".join(f'<li><a href="{u}">{t}</a></li>' for t, u in SOURCES.items())
    title = "Provider inquiry" if recipient == "provider" else W.COLLECTOR_DISPUTE_INFORMATION_REQUEST
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    html = F.concat(
        F.lit(f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>Evidence packet</title></head><body><main>\n<p>Prepared {as_of}</p>\n<h2>What needs clarification</h2>'),
        F.coalesce(F.nullif("findings_html", F.lit("")), F.lit("<p>No findings could be supported from the confirmed records.</p>")),
        F.lit("\n<h2>Reconstruction from supplied records</h2>\n<table><thead><tr><th>Entry</th><th>Amount</th><th>Evidence</th></tr></thead><tbody>"), text("ledger_html"),
        F.lit("</tbody></table>\n<h2>Attachment index</h2><ol>"), text("attachments"),
        F.lit("</ol>\n<h2>Reviewed facts and source passages</h2>\n<table><thead><tr><th>Evidence reference</th><th>Fact</th><th>Original source</th></tr></thead><tbody>"), text("fact_rows"),
        F.lit(f'</tbody></table>\n<section class="draft"><h2>{title} — draft</h2>\n<p><small>'), html_escape(note), F.lit("</small></p><pre>"), html_escape(F.coalesce("edited", "letter")),
        F.lit(f"</pre></section>\n<h2>Official guidance</h2><ul>{sources}</ul>\n</main></body></html>"),
    )
    return all_.select("case_id", html.alias("html"))
