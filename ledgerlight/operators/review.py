"""Review state: fact grids, document cards and status, edits and switches, and what a case still needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import constants as K
from ledgerlight.functions.scalars import barrier, dollars, let, money_cents, normalize_value, strip

CARD_FIELD = {"eob": "patient_responsibility", "bill": "balance", "collection": "balance", "receipt": "payment_amount"}


def fact_grid(facts: DataFrame) -> DataFrame:
    label = F.coalesce(*[F.when(F.col("field") == k, F.lit(v)) for k, v in K.FIELD_LABELS.items()], F.col("field"))
    source = F.when(F.coalesce(F.col("quote") != "", F.lit(False)), F.concat(F.lit("p. "), F.col("page").cast("string"), F.lit(" · "), F.col("quote"))).otherwise("User-supplied; no document passage")
    return facts.select("case_id", "doc_ordinal", "field", label.alias("label"), "value", F.col("confirmed").alias("reviewed"), source.alias("source"))


def document_cards(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, doc_ordinal, headline): the key amount of each document, or what it waits for."""
    wanted = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in CARD_FIELD.items()])
    docs = documents.select("case_id", "doc_ordinal", wanted.alias("field"))
    rows = docs.join(facts.select("case_id", "doc_ordinal", "field", "value", "confirmed"), ["case_id", "doc_ordinal", "field"], "left")
    cents = money_cents(F.col("value"))
    return rows.select("case_id", "doc_ordinal", F.when(F.col("confirmed") & cents.isNotNull(), dollars(cents)).when(F.col("confirmed"), "Amount needs correction").otherwise("Awaiting review").alias("headline"))


def document_status(result: DataFrame) -> DataFrame:
    """(case_id, doc_ordinal, doc_id, status) of each document of each case."""
    d = F.col("d")
    status = F.when(~d["included"], "Switched off").when(F.array_contains("matched_document_ids", d["id"]), "Connected").when(F.array_contains("excluded_document_ids", d["id"]), "Not applied").otherwise("Reviewed for context")
    rows = result.select("case_id", "matched_document_ids", "excluded_document_ids", F.explode("all_docs").alias("d"))
    return rows.select("case_id", d["ord"].alias("doc_ordinal"), d["id"].alias("doc_id"), status.alias("status"))


def pending_facts(documents: DataFrame, facts: DataFrame) -> DataFrame:
    return facts.where(~F.col("confirmed")).join(documents.where("included").select("case_id", "doc_ordinal", "doc_id"), ["case_id", "doc_ordinal"]).select("case_id", "doc_id", "field")


def missing_fields(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, doc_ordinal, missing): fields that a document doesn't have, in label order."""
    has = facts.groupBy("case_id", "doc_ordinal").agg(F.collect_set("field").alias("has"))
    rows = documents.select("case_id", "doc_ordinal").join(has, ["case_id", "doc_ordinal"], "left")
    every = F.array(*[F.lit(k) for k in K.FIELD_LABELS])
    return rows.select("case_id", "doc_ordinal", F.array_join(F.array_except(every, F.coalesce("has", F.array().cast("array<string>"))), ",").alias("missing"))


def merge_edits(facts: DataFrame, edits: DataFrame, *, bulk: bool = False) -> DataFrame:
    """Facts after edits (case_id, doc_ordinal, field, new_value, reviewed). Blank deletes; a changed value is the user's
    and confirmed; an unchanged one is confirmed if reviewed (or all are); a document with an edit that can't be read keeps
    its facts as they are."""
    keys = ["case_id", "doc_ordinal", "field"]
    text = strip(F.col("new_value"))
    read = edits.select(*keys, text.alias("new_value"), "reviewed", F.lit(True).alias("edited"), normalize_value(F.col("field"), F.col("new_value")).alias("canonical"))
    broken = read.where((F.col("new_value") != "") & F.col("canonical").isNull()).select("case_id", "doc_ordinal").distinct()
    good = read.join(broken, ["case_id", "doc_ordinal"], "left_anti")
    ordinal = F.coalesce(*[F.when(F.col("field") == k, F.lit(i)) for i, k in enumerate(K.FIELD_LABELS)])
    rows = facts.join(good, keys, "full_outer").where(~(F.coalesce(F.col("edited"), F.lit(False)) & (F.col("new_value") == "")))
    is_new, changed = F.col("value").isNull() & F.col("edited"), F.coalesce(F.col("new_value") != F.col("value"), F.lit(False))
    own = F.coalesce(is_new | changed, F.lit(False))
    return rows.select(
        *keys,
        F.coalesce("field_ordinal", ordinal).alias("field_ordinal"),
        F.when(own, F.col("new_value")).otherwise(F.col("value")).alias("value"),
        F.coalesce("quote", F.lit("")).alias("quote"),
        F.coalesce("page", F.lit(1)).alias("page"),
        F.when(own, True).when(F.col("edited"), F.lit(bulk) | F.col("reviewed")).otherwise(F.col("confirmed")).alias("confirmed"),
        F.when(own, "user").otherwise(F.col("origin")).alias("origin"),
    )


def toggle_documents(documents: DataFrame, switches: DataFrame) -> DataFrame:
    """Documents with ``included`` set by (case_id, doc_ordinal, on)."""
    return documents.join(switches, ["case_id", "doc_ordinal"], "left").withColumn("included", F.coalesce("on", "included")).drop("on")


def evidence(result: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, seq, ref, doc_ordinal, field): what each reference of each finding points at; nulls if nothing."""
    held = facts.groupBy("case_id").agg(F.collect_list(F.struct("doc_ordinal", "field")).alias("_held"))
    rows = result.select("case_id", "all_docs", "findings").join(held, "case_id", "left")  # by case alone: both sides lie so

    def resolved(seq: Column, ref: Column) -> Column:
        found = F.get(F.filter("all_docs", lambda d: (ref == d["id"]) | F.startswith(ref, F.concat(d["id"], F.lit(".")))), F.lit(0))
        part = let(F.struct(found["ord"].alias("ord"), found["id"].alias("id")), lambda d: F.struct(d["ord"].alias("ord"), F.when(ref != d["id"], F.substring(ref, F.length(d["id"]) + 2, F.length(ref))).alias("field")))
        known = lambda d: F.coalesce(F.exists("_held", lambda h: (h["doc_ordinal"] == d["ord"]) & (h["field"] == d["field"])), F.lit(False))
        return let(part, lambda d: F.struct(seq.alias("seq"), ref.alias("ref"), d["ord"].alias("doc_ordinal"), F.when(known(d), d["field"]).alias("field")))

    refs = F.flatten(F.transform("findings", lambda f, i: F.transform(F.array_distinct(f["refs"]), lambda x: resolved(i, x))))
    return barrier(rows.select("case_id", refs.alias("refs")), "case_id").select("case_id", F.explode("refs").alias("x")).select("case_id", "x.*")


OVERVIEW_PARTS = ("included", "pending", "n_facts")


def overview(result: DataFrame) -> DataFrame:
    """(case_id, documents, active, pending, exportable)."""
    active = F.filter("all_docs", lambda d: d["included"])
    total = lambda f: F.aggregate(active, F.lit(0), lambda a, d: a + f(d))
    pending = total(lambda d: d["pending"])
    has_fields = F.exists(active, lambda d: d["n_facts"] > 0)
    return result.select("case_id", F.size("all_docs").alias("documents"), F.size(active).alias("active"), pending.alias("pending"), (has_fields & (pending == 0)).alias("exportable"))


LANES = 4  # of 32 bits


def row_marks(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, marks): of each document and fact, LANES numbers of 32 bits from the digest of all its fields, null ones
    told from empty ones."""

    def marked(rows: DataFrame, kind: str, *columns: str) -> DataFrame:
        text = F.concat_ws("\x1e", F.lit(kind), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
        digest = rows.select("case_id", F.sha2(text, 256).alias("d"))
        return digest.select("case_id", F.array(*[F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("long") for i in range(LANES)]).alias("marks"))

    docs = marked(documents, "document", "doc_ordinal", "doc_id", "kind", "title", "text", "included")
    return docs.unionByName(marked(facts, "fact", "doc_ordinal", "field_ordinal", "field", "value", "quote", "page", "confirmed", "origin"))


def summed(marks: DataFrame) -> DataFrame:
    """(case_id, marks): their sums, lane by lane, combined before the shuffle."""
    lanes = [F.pmod(F.sum(F.col("marks")[i]), F.lit(1 << 32)).alias(f"m{i}") for i in range(LANES)]
    return marks.groupBy("case_id").agg(*lanes).select("case_id", F.array(*[f"m{i}" for i in range(LANES)]).alias("marks"))


def updated(sums: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The sums of cases after some rows (as of ``row_marks``) came in and others went: no other row is read."""
    less = removed.select("case_id", F.transform("marks", lambda m: -m).alias("marks"))
    return summed(sums.unionByName(added).unionByName(less))


def fingerprint(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, token): a token that changes with any field of a document or fact of a case, whatever order they come in.
    Digests of rows are added up, so no text is moved, and a token can be kept current (``updated``)."""
    return tokens(summed(row_marks(documents, facts)))


def tokens(sums: DataFrame) -> DataFrame:
    return sums.select("case_id", F.lower(F.concat(*[F.lpad(F.hex(F.col("marks")[i]), 8, "0") for i in range(LANES)])).alias("token"))


def headline(result: DataFrame) -> DataFrame:
    """The finding to show first: a possibly uncredited payment if there is one, else the first."""
    best = F.coalesce(F.get(F.filter("findings", lambda f: f["code"] == "possible_uncredited_payment"), F.lit(0)), F.get("findings", F.lit(0)))
    return result.select("case_id", best["code"].alias("code"), best["title"].alias("title"))
