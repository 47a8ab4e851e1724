"""Content rules as data: category, rule, pattern, case ignored."""

from __future__ import annotations

#: Patterns in the order in which categories win ties.
EMAIL = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
RULES = (
    ("EMAIL_THREAD", "email_headers", r"(?im)^(from|to|sent|subject|cc|bcc):"),
    ("EMAIL_THREAD", "original_message", r"(?i)-{2,}\s*original message\s*-{2,}"),
    ("EMAIL_THREAD", "email_address", r"(?i)" + EMAIL),
    ("EMAIL_THREAD", "timestamp", r"(?i)\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b\d{1,2}:\d{2}\s?(am|pm)?"),
    ("LEGAL_PROCEEDING", "case_no", r"(?i)\bcase\s+no\.?"),
    ("LEGAL_PROCEEDING", "docket", r"(?i)\bdocket\b"),
    ("LEGAL_PROCEEDING", "party_roles", r"(?i)\bplaintiff\b|\bdefendant\b"),
    ("LEGAL_PROCEEDING", "court_terms", r"(?i)\bcourt\b|\bhon\.\b"),
    ("LEGAL_PROCEEDING", "motions", r"(?i)\bmotion\b|\baffidavit\b|\bdeposition\b"),
    ("LEGAL_PROCEEDING", "caption", r"(?i)\bin the .* court\b"),
    ("LEGAL_PROCEEDING", "versus", r"\b v\. \b"),
    ("LETTER_MEMO", "salutation", r"(?im)^dear\s"),
    ("LETTER_MEMO", "signoff", r"(?im)^(sincerely|respectfully)\b"),
    ("LETTER_MEMO", "memo_header", r"(?im)^(to|from|date|subject|re):"),
    ("FINANCIAL", "invoice", r"(?i)\binvoice\b"),
    ("FINANCIAL", "payment", r"(?i)\bpayment\b|\bamount due\b"),
    ("FINANCIAL", "account", r"(?i)\baccount\b|\bwire\b"),
    ("FINANCIAL", "currency", r"\$\s?\d|\bUSD\b|\bEUR\b"),
    ("CONTACT_LIST", "email_address", r"(?i)" + EMAIL),
    ("CONTACT_LIST", "phone_number", r"\b\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b"),
    ("FORM_TEMPLATE", "underscore_blank", r"_{3,}"),
    ("FORM_TEMPLATE", "checkbox", r"\[\s*\]|☐|☑"),
    ("FORM_TEMPLATE", "field_blank", r"(?i)(name|date|signature|address|phone|email):\s*_{2,}"),
)

CATEGORIES = tuple(dict.fromkeys(c for c, _, _ in RULES))

#: For rules that cannot match without certain characters: some of them, one of which the folded text has to hold.
GUARDS = {
    "email_headers": (":",), "original_message": ("original message",), "email_address": ("@",), "timestamp": ("/", ":"), "case_no": ("case",), "docket": ("docket",),
    "party_roles": ("plaintiff", "defendant"), "court_terms": ("court", "hon."), "motions": ("motion", "affidavit", "deposition"), "caption": (" court",), "versus": (" v. ",),
    "salutation": ("dear",), "signoff": ("sincerely", "respectfully"), "memo_header": (":",), "invoice": ("invoice",), "payment": ("payment", "amount due"), "account": ("account", "wire"),
    "currency": ("$", "usd", "eur"), "underscore_blank": ("___",), "checkbox": ("[", "☐", "☑"), "field_blank": ("__",),
}
