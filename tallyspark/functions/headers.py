"""Statement headers to canonical columns: a fixed table of patterns, first match in declaration order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical column and the pattern of its headers.
HEADERS = [
    ("time", r"(tm|trn|trans|book|posting)?\s*time"),
    ("date", r"(trn|trans|book|post|posting)?\s*date"),
    ("value_date", r"(v|value)\s*date"),
    ("description", r"(trans|trn|transaction)?\s*(description|desc|detail|narration|narrative|particular|remark)s?|transaction"),
    ("trans_type", r"(trn|trans|transaction)\s*(type|mod)"),
    ("credit", r"(cr|cr?edit|deposit)s?\s*(amt|amount)?\s*(\(cr\)|\(credit\))?"),
    ("debit", r"(dr|debit|withdraw(al)?)s?\s*(amt|amount)?\s*(\(dr\)|\(debit\))?"),
    ("balance", r"(curr|current)?\s*(bal|balanced?)\s*(amt|amount)?"),
    ("reference", r"(trn)?\s*(ref|ref#?|references?)\s*(#|no)?"),
    ("cheque", r"(chq|cheque|check)\s*(#|no)?"),
    ("serial", r"(sl|si)#?"),
    ("branch_code", r"(trn|transaction)?\s*(branch|brn?)\s*(code|id|no)?"),
    ("branch_name", r"(originating)\s*(branch|brn?)\s*(name|title)?"),
    ("instrument_number", r"(trn|trans|transaction)?\s*(instrument|instr?)\s*(#|no|number)?"),
    ("trans_code", r"(trn|trans|transaction)?\s*(code)"),
    ("batch_number", r"(trn|trans|transaction)?\s*(batch)\s*(no|number)?"),
    ("tracer_number", r"(trn|trans|transaction)?\s*(tracer|trace)\s*(no|number)?"),
    ("bank_name", r"(bank|banking)_?\s*(name|title)?"),
    ("account_no", r"(stmt|statement)?_?\s*(acc|account)_?\s*(no|number)?"),
    ("file_id", r"(file)_?\s*(id|identifier|#)?"),
    ("passed_validation", r"(passed)?_?\s*(validation|check)?"),
    ("page", r"(page|pg)_?\s*(#|no|index)?"),
]
#: Patterns of values that tell the halves of a double column apart.
VALUES = {"cheque": r"\d{6,}", "account_no": r"\d{6,}"}


def cleaned(c: Column) -> Column:
    return F.trim(F.translate(c, "/.", "  "))


def match_header(c: Column) -> Column:
    """The canonical name of a header, null for none or an empty one."""
    t = cleaned(c)
    out = F.lit(None).cast("string")
    for name, pattern in reversed(HEADERS):
        out = F.when(t.rlike(f"^(?i:{pattern})$"), name).otherwise(out)
    return F.when(t != "", out)


def match_name(header: str) -> str | None:
    """The same for one header on the driver."""
    t = re.sub("[/.]", " ", header).strip()
    return next((n for n, p in HEADERS if t and re.fullmatch(p, t, re.I)), None)


def resolve(header: str) -> tuple[str, ...] | None:
    """A header to its columns: one for a plain one, two for 'A/B' (either) and 'A and B' (both); null for none.

    Plain matches come first, so "Ref/Cheque No" is only split if it has no plain match. It never raises.
    """
    if one := match_name(header):
        return (one,)
    for sign in ("/", " and ", " & "):
        parts = [match_name(p) for p in header.split(sign)]
        if len(parts) >= 2 and parts[0] and parts[1]:
            return (parts[0], parts[1])
    return None


def split_union(c: Column, first: str, second: str) -> tuple[Column, Column]:
    """Values of an 'A/B' column: text around a slash, else the first kind whose pattern fits the whole value."""
    parts = F.split(c, "/")
    slash, t = F.size(parts) >= 2, F.trim(c)
    fits = t.rlike(f"^(?:{VALUES.get(first, '.*')})$")
    return F.when(slash, F.trim(parts[0])).when(fits, t), F.when(slash, F.trim(F.get(parts, F.lit(1)))).when(~fits & t.rlike(f"^(?:{VALUES.get(second, '.*')})$"), t)


def split_composite(c: Column, first: str, second: str) -> tuple[Column, Column]:
    """Values of an 'A and B' column: the first match of A's pattern is taken out once, B is looked for in the rest."""
    a = F.regexp_extract(c, VALUES.get(first, r"\S+"), 0)
    rest = F.trim(F.concat(F.substring_index(c, a, 1), F.expr("''"), F.when(a != "", F.substring(c, F.length(F.substring_index(c, a, 1)) + F.length(a) + 1, 1 << 30)).otherwise("")))
    b = F.regexp_extract(rest, VALUES.get(second, r"(?s).+"), 0)
    return F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))
