"""What findings, letters and packets say. All are fixed values: a letter or finding must read so, word for word."""

# Findings of a reconciliation (fixed values), in the order of the rules.
MASKED_ACCOUNT_REFERENCES_NEED_MANUAL = "Masked account references need manual account verification."
CONFIRM_AN_UNAMBIGUOUS_SERVICE_DATE = "Confirm an unambiguous service date in YYYY-MM-DD format."
THE_CONFIRMED_CLAIM_REFERENCES_DIFFER = "The confirmed claim references differ."
A_CONFIRMED_PROVIDER_BILL_AND = "A confirmed provider bill and collection balance are needed for account arithmetic."
DUPLICATE_STATEMENT_COUNTED_ONCE = "Duplicate statement counted once"
THESE_RECORDS_HAVE_THE_SAME = "These records have the same confirmed facts."
THE_INCLUDED_VERSIONS_CONTAIN_DIFFERENT = "The included versions contain different confirmed facts. Select one applicable statement or resolve the differences; the engine does not guess which is final."
DOCUMENT_IDENTIFIERS_MUST_BE_UNIQUE = "Document identifiers must be unique"
TWO_INCLUDED_RECORDS_SHARE_AN = "Two included records share an identifier. Resolve this before linking evidence."
USING_YOUR_CONFIRMED_CORRECTIONS = "Using your confirmed corrections"
THESE_VALUES_WERE_CORRECTED_BY = "These values were corrected by the user. Original document quotes remain available; check each corrected value against the record before sharing the packet."
BILL_AND_COLLECTION_NOTICE_DO = "Bill and collection notice do not securely match"
CONFIRM_THE_DOCUMENT_TIMELINE = "Confirm the document timeline"
USE_YYYY_MM_DD_DATES = "Use YYYY-MM-DD dates. The service must precede the bill, and the bill cannot postdate the collection notice used in this comparison."
CONFIRM_THE_ACCOUNT_AMOUNTS = "Confirm the account amounts"
MISSING_UNCONFIRMED_OR_INVALID = "Missing, unconfirmed or invalid: "
ENTER_EXACT_NONNEGATIVE_DOLLAR_AMOUNTS = ". Enter exact nonnegative dollar amounts; do not assume omitted payments are zero."
THE_PROVIDER_STATEMENT_DOES_NOT = "The provider statement does not reconcile"
CHARGES_MINUS_ADJUSTMENTS_POSTED_INSURER = "Charges minus adjustments, posted insurer payments and posted patient payments equal "
THE_STATEMENT_REPORTS = "; the statement reports "
REQUEST_AN_ITEMIZED_LEDGER_BEFORE = ". Request an itemized ledger before applying additional payments."
INSURANCE_RESPONSIBILITY_IS_NOT_PATIENT = "Insurance responsibility is not patient payment evidence"
AN_EOB_DESCRIBES_INSURANCE_PROCESSING = "An EOB describes insurance processing and patient responsibility. No patient payment is subtracted from the EOB."
INSURANCE_RECORD_NEEDS_MATCHING_REVIEW = "Insurance record needs matching review"
CONFIRM_WHETHER_THIS_DATED_INSURANCE = "Confirm whether this dated insurance record applies to this collection balance."
INSURANCE_AND_PROVIDER_AMOUNTS_DIFFER = "Insurance and provider amounts differ"
DOES_NOT_AGREE_WITH_THE = " does not agree with the provider's posted accounting. This may involve a revision or posting delay; resolve it first."
PAYMENT_RECORDS_CONFLICT = "Payment records conflict"
RECORDS_FOR_THE_SAME_PAYMENT = "Records for the same payment reference or content disagree about amount, date, identity or status. A reversal or corrected receipt must be resolved before subtraction."
SAME_PAYMENT_COUNTED_ONCE = "Same payment counted once"
THE_PAYMENT_REFERENCE_OR_IDENTICAL = "The payment reference or identical receipt content repeats; its amount is not added again."
POSSIBLE_DUPLICATE_PAYMENT_RECORDS = "Possible duplicate payment records"
THE_SAME_ACCOUNT_AMOUNT_AND = "The same account, amount and payment date appear on multiple documents without distinct confirmed transaction references. Confirm whether these are separate payments."
RECEIPT_CANNOT_BE_APPLIED_TO = "Receipt cannot be applied to this account"
PAYMENT_STATUS_DOES_NOT_SUPPORT = "Payment status does not support subtraction"
THE_PAYMENT_IS_REVERSED_UNSUCCESSFUL = "The payment is reversed, unsuccessful, pending or lacks a confirmed completed status. Obtain the current transaction record."
PAYMENT_AMOUNT_OR_TIMING_NEEDS = "Payment amount or timing needs review"
CONFIRM_THE_AMOUNT_AND_YYYY = "Confirm the amount and YYYY-MM-DD payment date. A payment must follow the service; same-day ordering is unknown, and a payment on/after the notice cannot establish that the notice missed an earlier payment. A receipt issue date cannot precede its reported payment date."
EARLIER_PAYMENT_NOT_SUBTRACTED_AGAIN = "Earlier payment not subtracted again"
THIS_RECEIPT_PREDATES_THE_PROVIDER = "This receipt predates the provider statement. The statement's posted-payment total is the baseline; confirm individual payment allocation in the provider ledger."
PAYMENT_RECEIPT_NEEDED = "Payment receipt needed"
NO_INCLUDED_PAYMENT_RECEIPT_SUPPORTS = "No included payment receipt supports a patient payment. The EOB alone cannot show that the patient paid. Add a matching completed-payment record."
EARLIER_RECEIPTS_EXCEED_POSTED_PATIENT = "Earlier receipts exceed posted patient payments"
THE_EARLIER_RECEIPTS_CANNOT_ALL = "The earlier receipts cannot all be accounted for by the statement's posted patient payments. Request a transaction ledger; do not subtract them again by assumption."
PAYMENTS_EXCEED_THE_STATEMENT_BALANCE = "Payments exceed the statement balance"
MATCHING_RECEIPTS_EXCEED_THE_BALANCE = "Matching receipts exceed the balance in this statement. Allocation, refunds, reversals or other charges need review; this calculation does not establish an account credit."
RESOLVE_THE_HIGHLIGHTED_EVIDENCE_BEFORE = "Resolve the highlighted evidence before comparing balances"
A_FINAL_SUPPORTED_BALANCE_IS = "A final supported balance is withheld because included records have unresolved identity, timing, status or accounting questions. Subtotals are not a debt-validity determination."
A_PAYMENT_MAY_NOT_BE = "A payment may not be reflected in the collection balance"
THE_MATCHING_COMPLETED_RECEIPT_S = "The matching completed receipt(s) show "
PAID_AFTER_THE_PROVIDER_STATEMENT = " paid after the provider statement and before the notice. Supplied-record arithmetic gives "
WHILE_THE_NOTICE_REQUESTS = ", while the notice requests "
REQUEST_AN_UPDATED_ITEMIZED_LEDGER = ". Request an updated itemized ledger and confirmation of payment allocation; later reversals or account activity are not established by these records."
THE_SUPPLIED_BALANCES_DIFFER = "The supplied balances differ"
THE_NOTICE_REQUESTS = "The notice requests "
THE_SUPPLIED_RECORD_CALCULATION_IS = "; the supplied-record calculation is "
ASK_FOR_THE_TRANSACTIONS_EXPLAINING = ". Ask for the transactions explaining this difference."
SUPPLIED_AMOUNTS_RECONCILE = "Supplied amounts reconcile"
NO_BALANCE_DISCREPANCY_WAS_DETECTED = "No balance discrepancy was detected in these confirmed records. This does not verify the current account ledger, later activity or legal liability."
CONTRACTUAL_ADJUSTMENT = "Contractual adjustment"
POSTED_INSURER_PAYMENT = "Posted insurer payment"
PATIENT_PAYMENTS_ALREADY_POSTED = "Patient payments already posted"
PROVIDER_STATEMENT_BALANCE = "Provider statement balance"
MATCHING_COMPLETED_PAYMENT_AFTER_STATEMENT = "Matching completed payment after statement"
BALANCE_SUPPORTED_BY_SUPPLIED_RECORDS = "Balance supported by supplied records"

# Letters and packets (fixed values), in the order of a letter.
CHOOSE_PROVIDER_OR_COLLECTOR = "Choose provider or collector."
I_AM_REQUESTING_A_REVIEW = "I am requesting a review of my account and a current, itemized billing ledger."
TO_THE_DEBT_COLLECTOR = "To the debt collector,"
I_AM_WRITING_ABOUT_YOUR = "I am writing about your collection notice. I dispute the balance as presented and request verification and an itemized explanation of how it was calculated."
ACCOUNT_REFERENCE_SHOWN_ON_THE = "Account reference shown on the notice: "
THE_SUPPLIED_COLLECTION_NOTICE_REQUESTS = "The supplied collection notice requests "
THE_FOLLOWING_POINTS_NEED_CLARIFICATION = "The following points need clarification based on the attached records:"
PLEASE_IDENTIFY_THE_ORIGINAL_PROVIDER = "Please identify the original provider, account, and dates of service, and explain how the balance reflects contractual adjustments, insurance payments, patient payments, and any reversals. Please confirm how the attached payment records were allocated."
THIS_REQUEST_IS_BASED_ON = "This request is based on the records currently available to me; please provide any missing or updated account information so the discrepancy can be reconciled."
YOUR_PREFERRED_REPLY_ADDRESS = "[Your preferred reply address]"
USER_CORRECTED_VALUE_ORIGINAL_SOURCE = "User-corrected value; original source retained"
REVIEWED_DOCUMENT_EXTRACTION = "Reviewed document extraction"
EDITED_DRAFT_SUPPLIED_BY_THE = "Edited draft supplied by the user; review every change against the evidence."
DRAFT_ASSEMBLED_FROM_THE_CONFIRMED = "Draft assembled from the confirmed fields and the findings below."
COLLECTOR_DISPUTE_INFORMATION_REQUEST = "Collector dispute / information request"

# Warnings of extraction and validation (fixed values).
REVIEW, COULD_NOT_BE_PARSED = "Review ", ": the source value could not be parsed."
CONFLICTING, CONFIRM_MANUALLY, NEED_MANUAL_REVIEW = "Conflicting ", " values; confirm the applicable one manually.", " values need manual review."
NO_LABELED_FIELDS_FOUND = "No labeled fields found. Add the relevant facts in review, or enable AI extraction."
DISCARDED, NOT_SUPPORTED, NOT_VERIFIED = "Discarded ", ": its value was not supported by the quoted text.", ": its source quote could not be verified."
