"""The vocabulary that inputs and results are written in. They must stay as they are for results to agree."""

# Document kinds, with their labels (fixed values).
KINDS = {"eob": "Insurance explanation", "bill": "Provider bill", "receipt": "Payment receipt", "collection": "Collection notice"}

# Field keys in their display order, with labels (fixed values).
FIELD_LABELS = {
    "provider": "Provider / original creditor",
    "patient": "Patient",
    "account": "Account reference",
    "claim_id": "Claim reference",
    "service_date": "Date of service",
    "statement_date": "Document date",
    "charges": "Provider charges",
    "adjustments": "Contractual adjustment",
    "allowed": "Allowed amount",
    "insurer_paid": "Insurer payment",
    "patient_responsibility": "Patient responsibility",
    "patient_paid": "Patient payments already in statement",
    "balance": "Statement / collection balance",
    "payment_amount": "Receipt payment",
    "payment_date": "Payment date",
    "payment_reference": "Payment reference",
    "payment_status": "Payment status",
    "collector": "Collector",
    "validation_end": "Stated dispute deadline",
}
MONEY_FIELDS = ("charges", "adjustments", "allowed", "insurer_paid", "patient_responsibility", "patient_paid", "balance", "payment_amount")
DATE_FIELDS = ("service_date", "statement_date", "payment_date", "validation_end")
IDENTITY = ("provider", "patient", "account", "service_date")
SETTLED = ("paid", "completed", "settled", "posted", "successful", "succeeded")

# Labels that stand for a field in a document's text, in lower case (fixed values).
ALIASES = {
    "provider": ["provider", "provider name", "original creditor", "creditor", "payee"],
    "patient": ["patient", "patient name", "consumer", "consumer name"],
    "account": ["account", "account number", "account reference", "account ending", "account id"],
    "claim_id": ["claim id", "claim number", "claim reference"],
    "service_date": ["date of service", "service date", "visit date"],
    "statement_date": ["statement date", "document date", "notice date", "bill date", "issued"],
    "charges": ["provider charges", "total charges", "charges", "billed charges"],
    "adjustments": ["contractual adjustment", "contractual adjustments", "adjustments", "adjustment"],
    "allowed": ["allowed amount", "allowed charges"],
    "insurer_paid": ["insurer payment", "insurance payment", "insurance paid", "posted insurance payment", "paid by insurer", "plan payment"],
    "patient_responsibility": ["patient responsibility", "patient balance", "your share", "what you owe"],
    "patient_paid": ["patient payments already in statement", "patient payments credited", "posted patient payments", "patient payments"],
    "balance": ["balance", "balance due", "remaining balance", "amount due", "current balance", "total amount due", "collection balance"],
    "payment_amount": ["payment amount", "receipt payment", "amount paid", "payment received"],
    "payment_date": ["payment date", "date paid", "paid on"],
    "payment_reference": ["payment reference", "payment id", "transaction id", "transaction reference", "receipt number"],
    "payment_status": ["payment status", "status"],
    "collector": ["collector", "collection agency", "debt collector"],
    "validation_end": ["stated dispute deadline", "validation end", "validation end date", "dispute by", "dispute deadline"],
}

# Complaint keywords (fixed values): id, label, pattern, searched without regard to case.
PATTERNS = [
    ("paid_language", "Already-paid language", r"\b(?:already|previously)\s+(?:been\s+)?paid\b|\bpaid\s+in\s+full\b|\b(?:zero|0(?:\.00)?)\s+balance\b|\bbalance\s+(?:was|is|of)\s+(?:zero|\$?0(?:\.00)?)\b"),
    ("insurance_language", "Insurance / coverage language", r"\b(?:insurance|insurer|coverage|eob)\b|\bexplanation\s+of\s+benefits\b"),
    ("identity_language", "Identity / recognition language", r"\bidentity\s+theft\b|\bnot\s+(?:my\s+debt|mine)\b|\bwrong\s+person\b"),
    ("verification_language", "Verification / documentation language", r"\b(?:validat\w*|verif\w*|documentation)\b|\bproof\s+of\b"),
    ("amount_language", "Amount / duplicate-billing language", r"\b(?:wrong|incorrect|inaccurate)\s+(?:amount|balance)\b|\bovercharg\w*\b|\bduplicate\s+(?:bill\w*|charg\w*)\b"),
]
DOCUMENT_MENTIONS = [
    ("eob", "Explanation of benefits", r"\beob\b|\bexplanation\s+of\s+benefits\b"),
    ("bill", "Bill / invoice / statement", r"\bbills?\b|\binvoices?\b|\b(?:billing|itemized)\s+statements?\b"),
    ("receipt", "Receipt / payment proof", r"\breceipts?\b|\bpayment\s+confirmation\b|\bproof\s+of\s+payment\b|\bbank\s+statements?\b|\bcancel(?:l)?ed\s+checks?\b"),
    ("collection_notice", "Collection / validation notice", r"\b(?:collection|dunning|validation)\s+(?:notice|letter)\b"),
]
PRODUCT, SUB_PRODUCT, NOT_OWED = "Debt collection", "Medical debt", "Attempts to collect debt not owed"
COMPLAINT_COLUMNS = ("Product", "Sub-product", "Consumer complaint narrative", "Complaint ID", "Date received", "Issue", "Sub-issue")

# Formats (fixed values): an amount of money, a masked reference, an ISO date, the line ends of text, blanks.
MONEY = r"^(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]{1,2})?\z"
MASKED = r"\*|[xX]{3,}"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
BLANKS = r"(?U)[\s\x1c-\x1f]+"
BLANK_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
QUOTED_NUMBER = r"(?<![\w.])\$?\d[\d,]*(?:\.\d{1,2})?(?![\w.])"
QUOTED_DATE = r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|[A-Za-z]+ \d{1,2}, \d{4}"
# Not fixed: what is surely in one form, so that it can be taken by a shorter way.
PLAIN = r"^[\n -~]*\z"  # one page of ASCII, in which lines end at line feeds and the only blanks are spaces
NOT_PLAIN = r"[^\n -~]"
#: values that are their own canonical form, but for an amount's dollar sign; there are others (29 February)
CANONICAL_MONEY = r"^\$?(?:0|[1-9][0-9]{0,12})\.[0-9]{2}\z"
CANONICAL_DATE = r"^[1-9][0-9]{3}-(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1[0-9]|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)\z"
# Bounds (fixed values).
UPLOAD_BYTES, UPLOAD_PAGES, UPLOAD_CHARS, FIELD_CHARS, MONEY_CHARS = 10 * 1024 * 1024, 12, 60_000, 240, 18
DOWNLOAD_BYTES, EXPANDED_BYTES = 90_000_000, 600_000_000
