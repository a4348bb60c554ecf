"""Labelled facts from paged text, and validation of proposed facts against their quotes.

A document's lines are one array in its row, and each field's history in it is judged by position, so extraction is a
projection: no shuffle, no Python. Rules for a field: the value must parse; a second, different value makes the field
conflicted from there on and removes it; a repeat of the same value moves the quote to the later line.

Lambdas are interpreted, an entry at a time, and most fields need no rule: they are named once, with a value in its canonical
form. Those are taken as columns, a field at a time, in generated code; only lines of other fields, and documents that aren't
plain text, go through the lambdas. Both ways give the same: a field that is taken has no other entry, so no history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import constants as K
from ledgerlight.functions import wording as W
from ledgerlight.functions.scalars import amount, amount_cents, barrier, let, loose_date, money_text, strip, supported_value

PLAIN, CANONICAL_MONEY, CANONICAL_DATE = K.PLAIN, K.CANONICAL_MONEY, K.CANONICAL_DATE
NO_TEXTS = "array<string>"


def _map(items: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in items.items() for x in kv])


def alias_key(label: Column, kind: Column) -> Column:
    """The field that a label names in a document of a kind, or null."""
    names = {a: k for k, labels in K.ALIASES.items() for a in labels} | {k.replace("_", " "): k for k in K.FIELD_LABELS}
    plain = F.try_element_at(_map(names), label)
    return F.when((kind == "eob") & (label == "amount due"), F.lit("patient_responsibility")).otherwise(plain)


def pages(text: Column) -> Column:
    return F.split(text, "\f")


def lines(text: Column) -> Column:
    """Array of (page, raw) for all lines of all pages; pages count from 1."""
    return F.flatten(F.transform(pages(text), lambda p, i: F.transform(F.split(p, K.LINE_END), lambda x: F.struct((i + 1).alias("page"), x.alias("raw")))))


def labelled(text: Column, kind: Column) -> Column:
    """Array of (pos, page, raw, field, given): lines that name a known field, up to their first colon or equals sign, and
    have text behind it."""

    def cut(x: Column, i: Column) -> Column:
        raw = x["raw"]
        colon, equals = F.locate(":", raw), F.locate("=", raw)
        at = F.when((colon > 0) & (equals > 0), F.least(colon, equals)).otherwise(F.greatest(colon, equals))
        return F.struct(i.alias("pos"), x["page"].alias("page"), raw.alias("raw"), at.alias("at"))

    def parse(x: Column) -> Column:
        label = F.lower(strip(F.substring(x["raw"], F.lit(1), x["at"] - 1)))
        return F.struct(x["pos"], x["page"], x["raw"], alias_key(label, kind).alias("field"), strip(F.substring(x["raw"], x["at"] + 1, F.length(x["raw"]))).alias("given"))

    parsed = F.transform(F.filter(F.transform(lines(text), cut), lambda x: x["at"] > 0), parse)
    return F.filter(parsed, lambda x: x["field"].isNotNull() & (x["given"] != ""))


def valued(entries: Column) -> Column:
    """Entries of ``labelled`` with the value of what is given; null if it can't be one."""
    return F.transform(entries, lambda x: F.struct(x["pos"], x["page"], x["raw"], x["field"], _normalized(x["field"], x["given"]).alias("value")))


def _normalized(key: Column, value: Column) -> Column:
    """``normalize_value`` for use inside lambdas."""
    money = lambda v: F.when(v.rlike(CANONICAL_MONEY), F.replace(v, F.lit("$"), F.lit(""))).otherwise(let(amount(v), lambda given: money_text(amount_cents(given))))
    day = lambda v: F.when(v.rlike(CANONICAL_DATE), v).otherwise(F.date_format(loose_date(v), "yyyy-MM-dd"))
    return let(strip(value), lambda v: F.when(key.isin(*K.MONEY_FIELDS), money(v)).when(key.isin(*K.DATE_FIELDS), day(v)).when(F.length(v) <= K.FIELD_CHARS, v))


def _judged(entries: str, quote: str) -> Column:
    """Per field of a column of entries in order: the kept fact, and where the field turned conflicted. In steps, each over
    what the one before has worked out: inside a lambda nothing is shared, so ``entries`` must lie behind a barrier."""
    named = F.array_intersect(F.array(*[F.lit(k) for k in K.FIELD_LABELS]), F.transform(entries, lambda x: x["field"]))
    fields = F.coalesce(named, F.array().cast(NO_TEXTS))
    held = F.transform(fields, lambda k: F.struct(k.alias("field"), F.filter(entries, lambda x: (x["field"] == k) & x["value"].isNotNull()).alias("own")))
    ends = F.transform(F.filter(held, lambda h: F.size(h["own"]) > 0), lambda h: F.struct(h["field"], h["own"], F.element_at(h["own"], 1)["value"].alias("value"), F.element_at(h["own"], -1).alias("last")))
    clash = lambda h: F.get(F.filter(h["own"], lambda x: x["value"] != h["value"]), F.lit(0))["pos"]
    return F.transform(ends, lambda h: F.struct(h["field"], h["value"], h["last"][quote].alias("quote"), h["last"]["page"].alias("page"), clash(h).alias("clash")))


def _canonical(key: str, value: Column) -> Column:
    """A stripped ASCII value if it is in its canonical form, else null."""
    if key in K.MONEY_FIELDS:
        return F.when(value.rlike(CANONICAL_MONEY), F.replace(value, F.lit("$"), F.lit("")))
    return F.when(value.rlike(CANONICAL_DATE) if key in K.DATE_FIELDS else F.octet_length(value) <= K.FIELD_CHARS, value)


def _once(names: str, back: str, key: str) -> Column:
    """The place of the one entry of a field in an array of names, from 1; 0 for none, null for more. ``back`` is the array reversed."""
    at = F.array_position(names, key)
    return F.when(at == 0, F.lit(0)).when(at + F.array_position(back, key) == F.size(names) + 1, at.cast("int"))


def _with_taken(out: DataFrame, fact) -> DataFrame:
    """Adds _quick (for each field in order the fact that is taken, or null) and _odd (the fields that need the rules) to
    documents with _names, the field of each entry. ``fact(key, at)`` is (value, quote, page) of the entry at a place; a null
    value is not taken."""
    out = out.withColumn("_back", F.reverse("_names"))
    out = out.withColumns({f"_at_{k}": _once("_names", "_back", k) for k in K.FIELD_LABELS})
    found = {k: fact(k, F.col(f"_at_{k}")) for k in K.FIELD_LABELS}
    out = out.withColumns({f"_v_{k}": F.when(F.col(f"_at_{k}") > 0, v) for k, (v, _, _) in found.items()})
    quick = [F.when(F.col(f"_v_{k}").isNotNull(), F.struct(F.lit(k).alias("field"), F.col(f"_v_{k}").alias("value"), q.alias("quote"), p.alias("page"))) for k, (_, q, p) in found.items()]
    odd = [F.when(F.coalesce(F.col(f"_at_{k}") == 0, F.lit(False)) | F.col(f"_v_{k}").isNotNull(), F.lit("")).otherwise(F.lit(k)) for k in K.FIELD_LABELS]
    out = out.withColumns({"_quick": F.array(*quick), "_odd": F.array_remove(F.array(*odd), "")})
    return out.drop("_back", *[f"_{c}_{k}" for c in ("at", "v") for k in K.FIELD_LABELS])


def _ruled() -> Column:
    """The facts that the rules keep of _seen."""
    return F.transform(F.filter("_seen", lambda h: h["clash"].isNull()), lambda h: F.struct(h["field"], h["value"], h["quote"], h["page"]))


def _kept() -> Column:
    """The facts of a document, in the fields' order: those that were taken, and those that the rules keep."""
    quick = F.filter("_quick", lambda f: f.isNotNull())
    ranks = _map({k: i for i, k in enumerate(K.FIELD_LABELS)})
    ranked = F.array_sort(F.transform(F.concat(quick, "_ruled"), lambda f: F.struct(F.element_at(ranks, f["field"]).alias("rank"), f.alias("f"))))
    return F.when(F.size("_ruled") == 0, quick).when(F.exists("_quick", lambda f: f.isNotNull()), F.transform(ranked, lambda x: x["f"])).otherwise(F.col("_ruled"))


def _text_sorted(notes: Column) -> Column:
    return F.transform(F.array_sort(notes), lambda x: x["text"])


def _given(raw: Column, head: Column) -> Column:
    """What stands behind the head of a line of plain text."""
    return F.trim(F.substring(raw, F.octet_length(head) + 2, F.octet_length(raw)))


def _plain_labels() -> Column:
    """The label of each line of plain text (_raw, and _head: what stands before its first colon or equals sign); empty for
    none, or without text behind it."""
    return F.zip_with("_raw", "_head", lambda x, h: F.when((F.octet_length(h) < F.octet_length(x)) & (_given(x, h) != ""), F.lower(F.trim(h))).otherwise(F.lit("")))


def _plain_names(labels: str, kind: Column) -> Column:
    """The fields of labels, as ``alias_key``; empty for none. Names are kept by their length: a map is searched from end to end."""
    names = {a: k for k, aliases in K.ALIASES.items() for a in aliases} | {k.replace("_", " "): k for k in K.FIELD_LABELS}
    by_size = F.array(*[_map({"": ""} | {a: k for a, k in names.items() if len(a) == n}) for n in range(max(map(len, names)) + 1)])
    plain = F.transform(labels, lambda n: F.coalesce(F.try_element_at(F.get(by_size, F.octet_length(n)), n), F.lit("")))
    eob = F.zip_with(labels, plain, lambda n, k: F.when(n == "amount due", F.lit("patient_responsibility")).otherwise(k))
    return F.when((kind == "eob") & F.array_contains(labels, "amount due"), eob).otherwise(plain)


def _unkept(docs: DataFrame, keep: tuple[str, ...] | None) -> list[str]:
    return [] if keep is None else [c for c in docs.columns if c not in keep]


def local_fields(docs: DataFrame, results: tuple[str, ...] = ("fields", "warnings"), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds fields (array of field, value, quote, page) and warnings, or one of these, to documents with text and kind. Of the
    documents' columns all stay, or those to ``keep``."""
    labels = _map(dict(K.FIELD_LABELS))
    text, kind = F.col("text"), F.col("kind")
    out = docs.withColumn("_plain", F.coalesce(text.rlike(PLAIN), F.lit(False)))
    out = out.withColumn("_raw", F.when(F.col("_plain"), F.split(text, "\n")))
    out = out.withColumn("_head", F.transform("_raw", lambda x: F.substring_index(F.substring_index(x, ":", 1), "=", 1)))
    out = out.withColumn("_labels", _plain_labels())
    out = out.withColumn("_names", _plain_names("_labels", kind)).drop("_labels")

    def line(k: str, at: Column) -> tuple[Column, Column, Column]:
        raw = F.get("_raw", at - 1)
        return _canonical(k, _given(raw, F.get("_head", at - 1))), raw, F.lit(1)

    out = _with_taken(out, line)
    places = F.filter(F.transform("_names", lambda k, i: F.when(F.array_contains("_odd", k), i)), lambda i: i.isNotNull())

    def entry(i: Column) -> Column:
        raw, head, field = F.get("_raw", i), F.get("_head", i), F.get("_names", i)
        return F.struct(i.alias("pos"), F.lit(1).alias("page"), raw.alias("raw"), field.alias("field"), _given(raw, head).alias("given"))

    left = F.when(~F.col("_plain"), labelled(text, kind)).otherwise(F.transform(F.when(F.size("_odd") > 0, places).otherwise(F.array().cast("array<int>")), entry))
    out = barrier(out.withColumn("_lines", valued(left)).drop("_plain", "_raw", "_head", "_names", "_odd", *_unkept(docs, keep)))
    out = out.withColumn("_seen", _judged("_lines", "raw")).withColumn("_ruled", _ruled())
    clash_of = F.map_from_entries(F.transform("_seen", lambda h: F.struct(h["field"], h["clash"])))
    out = out.withColumn("_clash", clash_of)
    open_ = lambda x: F.coalesce(x["pos"] < F.try_element_at(F.col("_clash"), x["field"]), F.lit(True))
    bad = F.transform(F.filter("_lines", lambda x: x["value"].isNull() & open_(x)), lambda x: F.struct(x["pos"].alias("pos"), F.concat(F.lit(W.REVIEW), F.element_at(labels, x["field"]), F.lit(W.COULD_NOT_BE_PARSED)).alias("text")))
    torn = F.transform(F.filter("_seen", lambda h: h["clash"].isNotNull()), lambda h: F.struct(h["clash"].alias("pos"), F.concat(F.lit(W.CONFLICTING), F.element_at(labels, h["field"]), F.lit(W.CONFIRM_MANUALLY)).alias("text")))
    empty = (F.size("_ruled") == 0) & ~F.exists("_quick", lambda f: f.isNotNull())
    none = F.when(empty, F.array(F.lit(W.NO_LABELED_FIELDS_FOUND))).otherwise(F.array().cast(NO_TEXTS))
    noted = F.when(F.size("_lines") == 0, F.array().cast(NO_TEXTS)).otherwise(_text_sorted(F.concat(bad, torn)))
    found = {"fields": _kept(), "warnings": F.concat(noted, none)}
    return barrier(out.withColumns({c: found[c] for c in results}).drop("_quick", "_lines", "_seen", "_ruled", "_clash"))


def _sure(key: str, value: Column, quote: Column) -> Column:
    """Whether a quote that stands in plain text surely bears out a value in its canonical form: it ends with it, nothing before
    it has a digit, and neither has blanks at its ends (these are less than an exclamation mark)."""
    ends = F.endswith(quote, F.concat(F.lit(" "), value)) & (quote >= "!")
    if key in (*K.MONEY_FIELDS, *K.DATE_FIELDS):
        return ends & ~F.substring(quote, F.lit(1), F.octet_length(quote) - F.octet_length(value)).rlike("[0-9]")
    return ends & (value >= "!") & ~F.endswith(value, F.lit(" ")) & ~F.endswith(value, F.lit("\n"))


def validated_fields(docs: DataFrame, results: tuple[str, ...] = ("fields", "warnings"), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds fields and warnings, or one of these, to documents with text and proposals (array of key, value, quote, page): a
    proposal counts only if its quote stands on its page and holds its value. Of the documents' columns all stay, or those to ``keep``."""
    out = docs.withColumns({"_plain": F.coalesce(F.col("text").rlike(PLAIN), F.lit(False)), "_pages": pages(F.col("text"))})
    out = out.withColumn("_names", F.transform("proposals", lambda x: x["key"]))

    def proposed(k: str, at: Column) -> tuple[Column, Column, Column]:
        x = F.get("proposals", at - 1)
        sure = F.col("_plain") & (x["page"] == 1) & F.contains("text", x["quote"]) & _sure(k, x["value"], x["quote"])
        return F.when(F.coalesce(sure, F.lit(False)), _canonical(k, x["value"])), x["quote"], x["page"]

    out = _with_taken(out, proposed)
    # _odd stands here twice, so that Spark doesn't work it out inside the lambda, for each proposal
    ruled = F.filter(F.transform("proposals", lambda x, i: F.when(F.array_contains("_odd", x["key"]), F.struct(i.alias("pos"), x.alias("x")))), lambda x: x.isNotNull())
    out = out.withColumn("_known", F.when(F.size("_odd") > 0, ruled).otherwise(F.slice(ruled, 1, 0)))

    def read(x: Column) -> Column:
        x, i = x["x"], x["pos"]
        return F.struct(i.alias("pos"), x["key"].alias("field"), x["page"].alias("page"), strip(x["quote"]).alias("quote"), _normalized(x["key"], x["value"]).alias("value"))

    def find(x: Column) -> Column:
        page = F.get(F.col("_pages"), x["page"] - 1)
        found = F.coalesce((x["quote"] != "") & (x["page"] >= 1) & F.contains(page, x["quote"]), F.lit(False))
        return F.struct(x["pos"], x["field"], x["page"], x["quote"], x["value"], found.alias("found"))

    def judge(x: Column) -> Column:
        ok = x["found"] & F.coalesce(x["value"].isNotNull() & supported_value(x["field"], x["value"], x["quote"]), F.lit(False))
        return F.struct(x["pos"], x["field"], x["page"], x["quote"], x["found"], F.when(ok, x["value"]).alias("value"))

    out = barrier(out.withColumn("_items", F.transform(F.transform(F.transform("_known", read), find), judge)).drop("_plain", "_pages", "_names", "_known", "_odd", *_unkept(docs, keep)))
    out = out.withColumn("_seen", _judged("_items", "quote")).withColumn("_ruled", _ruled())
    out = out.withColumn("_clash", F.map_from_entries(F.transform("_seen", lambda h: F.struct(h["field"], h["clash"]))))
    open_ = lambda x: F.coalesce(x["pos"] < F.try_element_at(F.col("_clash"), x["field"]), F.lit(True))
    bad = F.transform(
        F.filter("_items", lambda x: x["value"].isNull() & open_(x)),
        lambda x: F.struct(x["pos"].alias("pos"), F.concat(F.lit(W.DISCARDED), x["field"], F.when(x["found"], W.NOT_SUPPORTED).otherwise(W.NOT_VERIFIED)).alias("text")),
    )
    torn = F.transform(F.filter("_seen", lambda h: h["clash"].isNotNull()), lambda h: F.struct(h["clash"].alias("pos"), F.concat(F.lit(W.CONFLICTING), h["field"], F.lit(W.NEED_MANUAL_REVIEW)).alias("text")))
    found = {"fields": _kept(), "warnings": F.when(F.size("_items") == 0, F.array().cast(NO_TEXTS)).otherwise(_text_sorted(F.concat(bad, torn)))}
    return barrier(out.withColumns({c: found[c] for c in results}).drop("_quick", "_items", "_seen", "_ruled", "_clash"))


def document_ids(docs: DataFrame) -> DataFrame:
    """Adds new_id from kind and text, and a title of at most 180 characters; a repeated id in a case gets a suffix."""
    from pyspark.sql import Window

    plain = F.concat(F.lit("doc-"), F.substring(F.sha2(F.concat("kind", "text"), 256), 1, 12))
    rank = F.row_number().over(Window.partitionBy("case_id", "plain_id").orderBy("doc_ordinal"))
    return docs.withColumn("plain_id", plain).withColumn("_k", rank).withColumns({"new_id": F.when(F.col("_k") == 1, F.col("plain_id")).otherwise(F.concat("plain_id", F.lit("-"), (F.col("doc_ordinal") + 1).cast("string"))), "title": F.substring("title", 1, 180)}).drop("_k", "plain_id")


METHODS = {"local": "Local labeled-field parser", "proposals": "Structured extraction, validated"}


def extract_documents(docs: DataFrame, method: str = "local") -> DataFrame:
    """Documents (case_id, doc_ordinal, kind, title, text; with ``proposals`` also proposals) with new_id, a cut title,
    fields, warnings, the method's name and a problem. A document with a problem has neither fields nor warnings; no fact is
    confirmed before review."""
    if method not in METHODS:
        raise ValueError(f"Choose one of {', '.join(METHODS)}.")
    size = F.length("text")
    problem = (
        F.when(~F.coalesce(F.col("kind").isin(*K.KINDS), F.lit(False)), "Choose one supported document type.")
        .when(F.coalesce(strip(F.col("text")) == "", F.lit(True)) | (size > K.UPLOAD_CHARS), f"Provide between 1 and {K.UPLOAD_CHARS:,} characters of document text.")
    )
    found = local_fields(docs) if method == "local" else validated_fields(docs)
    found = document_ids(found.withColumn("problem", problem))
    usable = F.col("problem").isNull()
    return found.withColumns({"fields": F.when(usable, F.col("fields")), "warnings": F.when(usable, F.col("warnings")), "extraction_method": F.lit(METHODS[method])})
