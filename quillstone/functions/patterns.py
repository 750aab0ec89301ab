"""Identifier patterns, label aliases, vocabularies. Java syntax; (?U) makes classes Unicode."""

from __future__ import annotations

import re

# Patterns of identifiers, with the token they become and its first number.
NRIC = r"(?iU)\b[STFGM]\s?\d{7}\s?[A-Z]\b"
PHONE = r"(?U)(?<!\d)(?:\+65[ -]?)?[689]\d{3}[ -]?\d{4}(?!\d)"
EMAIL = r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
TOKENED = ((NRIC, "NRIC", 2), (PHONE, "PHONE", 2), (EMAIL, "EMAIL", 1))
INSTITUTION = r"(?U)\b[A-Z][\w'-]*(?:\s+[A-Z][\w'-]*){0,4}\s+(?:Hospital|Polyclinic|Clinic|Medical\s+Cent(?:re|er)|Specialist\s+Cent(?:re|er))\b"
STRICT_PHONE = r"(?U)(?<![A-Za-z0-9\-/#])(?:\+65[ -]?)?[689]\d{3}[ -]?\d{4}(?![A-Za-z0-9\-/#])"
POLICY = r"(?U)\b[A-Z]{2,5}[-/]?\d{4,}\b"
TOKEN = r"\[[A-Z][A-Z0-9_]*\]"
LABELLED = r"^\s*([A-Za-z][A-Za-z .#/]{0,23})\s*[:\-–]\s*(.+?)\s*$"
DATE = r"\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b|\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}\s+[A-Za-z]{3,9}\.?\s+\d{4}\b"

# Postal codes, separators that always part two values, and words before a policy number.
POSTAL = r"(?U)\bSingapore\s*\d{6}\b|\bS\d{6}\b|(?<!\d)\d{6}(?!\d)"
HARD_GAP = r"(?U)\s*[·|;]\s*|\s{2,}|\s+—\s+"
POLICY_WORD = r"(?iU)^(policy|member|certificate)\s*(no\.?|number|#)?\s*[:.]?\s*"
# Words that give a value on the same line to somebody else.
OWNER = (
    r"(?iU)\b(?:clinic|polyclinic|hospital|medical\s+cent(?:re|er)|practice|pharmacy|employer|company|workplace|next\s+of\s+kin|nok|kin|caregiver|carer|guardian"
    r"|spouse|husband|wife|father|mother|son|daughter|brother|sister|sibling|emergency|doctor|physician|referring)\b"
)
# Particles of names in lower case, and words around a label that still mean the patient's own field.
PARTICLES = ("bin", "binte", "bte", "b", "s/o", "d/o", "a/l", "a/p", "van", "von", "de", "del", "der", "di", "da", "la", "le")
QUALIFIERS = ("patient", "patients", "patientsown", "thepatient", "ofpatient", "ofthepatient", "the", "please", "enter")
# What goes from the labels of a page, in this order.
LABEL_RULES = (
    (r"(?i)\b[STFGM]\s?\d{7}\s?[A-Z]\b", "[NRIC]"),
    (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[EMAIL]"),
    (r"(?<!\d)(?:\+65[ -]?)?[689]\d{3}[ -]?\d{4}(?!\d)", "[PHONE]"),
    (r"(?<![\d-])\d[\d-]{7,}\d(?![\d-])", "[NUMBER]"),
)

# What a label may be called.
LABELS = {
    "full_name": ("name", "patient", "patientname", "fullname", "ptname", "pt"),
    "nric": ("nric", "fin", "nricfin", "nricno", "ic", "icno", "idno", "identitycard"),
    "dob": ("dob", "dateofbirth", "birthdate", "born"),
    "phone": ("phone", "tel", "telephone", "mobile", "hp", "handphone", "contact", "contactno"),
    "address": ("address", "addr", "residentialaddress"),
    "policy_number": ("policy", "policyno", "policynumber", "memberno", "certificateno"),
    "insurer": ("insurer", "insurance", "insurancecompany"),
}
ALIASES = {alias: field for field, names in LABELS.items() for alias in names}

# Words that vary without changing a question.
NOISE = ("please", "the", "a", "an", "of", "for", "to", "in", "and", "or", "your", "any", "if", "is", "are", "was", "were", "give", "state", "indicate", "provide", "specify", "enter", "advise")
# Options that mean none of the others, after normalising.
NONE_OPTIONS = (
    "none", "none of the above", "none of these", "none of them", "none of the options", "none apply", "none applies", "none applicable", "none of the above apply", "not applicable", "not applicable na",
    "does not apply", "do not apply", "not relevant", "not any of the above", "not any of these", "nil", "neither", "na", "n a",
)
# Ticks in words, and months.
TICK = ("true", "yes", "y", "on", "checked", "1")
UNTICK = ("false", "no", "n", "off", "unchecked", "0")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

# Insurers by the name a form wants, and what notes call them.
INSURERS = {
    "AIA": ("AIA", "AIA Singapore"),
    "Great Eastern": ("Great Eastern", "Great Eastern Life", "Great Eastern Life Assurance"),
    "HSBC Life": ("HSBC Life", "HSBC Insurance", "HSBC Life Singapore"),
    "Income": ("Income Insurance", "NTUC Income"),
    "Prudential": ("Prudential", "Prudential Assurance", "Prudential Singapore"),
    "Raffles Health Insurance": ("Raffles Health Insurance",),
    "Singlife": ("Singlife", "Singapore Life", "Singlife with Aviva"),
    "Aviva": ("Aviva", "Aviva Singapore"),
    "AXA": ("AXA", "AXA Insurance", "AXA Singapore"),
    "Aetna": ("Aetna", "Aetna International"),
    "Allianz": ("Allianz", "Allianz Partners"),
    "Bupa": ("Bupa", "Bupa Global"),
    "China Life": ("China Life",),
    "China Taiping": ("China Taiping",),
    "Chubb": ("Chubb", "Chubb Insurance"),
    "Cigna": ("Cigna", "Cigna Healthcare"),
    "Etiqa": ("Etiqa", "Etiqa Insurance"),
    "FWD": ("FWD Insurance", "FWD Singapore"),
    "Henner": ("Henner", "Henner Group"),
    "Liberty": ("Liberty Insurance",),
    "Manulife": ("Manulife", "Manulife Singapore"),
    "MSIG": ("MSIG", "MSIG Insurance"),
    "QBE": ("QBE", "QBE Insurance"),
    "Sompo": ("Sompo", "Sompo Insurance"),
    "Tokio Marine": ("Tokio Marine", "Tokio Marine Life"),
}
INSURER_NAMES = {called.lower(): name for name, calls in INSURERS.items() for called in calls}
#: Longest first, so that a match covers the whole phrase.
INSURER = r"(?iU)\b(?:" + "|".join(n.replace(" ", r"\s+") for n in sorted(INSURER_NAMES, key=len, reverse=True)) + r")\b"


def whole(pattern: str) -> str:
    """The pattern for a whole string."""
    flags = pattern[: pattern.index(")") + 1] if pattern.startswith("(?") and pattern[2] in "iU" else ""
    return f"{flags}^(?:{pattern[len(flags) :]})$"


def compiled(pattern: str) -> re.Pattern[str]:
    """The same pattern for Python, whose classes are Unicode without a flag."""
    flags = pattern[: pattern.index(")") + 1] if pattern.startswith("(?") and pattern[2] in "iU" else ""
    return re.compile(pattern[len(flags) :], re.IGNORECASE if "i" in flags else 0)
