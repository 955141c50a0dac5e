"""Value parsers as Column functions: no exception for any input, null where a value can't be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words read as null, and signs of currencies that amounts may carry.
NULL_WORDS = ["", "none", "null", "na", "n/a"]
CURRENCY = "$£€¥₹฿₽₩,"
TRUE_WORDS, FALSE_WORDS = ["true", "yes", "t", "y", "1", "on"], ["false", "no", "f", "n", "0", "off"]
# Date formats, day first.
DATE_FORMATS = ["d-M-yyyy", "d/M/yyyy", "d M yyyy", "d-M-yy", "d/M/yy", "d M yy", "d-MMM-yyyy", "d/MMM/yyyy", "d MMM yyyy", "d MMM yy", "d-MMM-yy", "d/MMM/yy", "yyyy-M-d", "yyyy/M/d", "yyyy M d", "yyyy-M-d H:m:s", "yyyy/M/d H:m:s", "yyyy M d H:m:s"]
TIME_FORMATS = ["H:m:s", "H:m", "h:m:s a", "h:m a", "h:ma"]
FLOAT = r"^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
# Letters that lose a mark by more than decomposition, and the accented letters of western Europe.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
SPELT = {"Æ": "AE", "æ": "ae", "Ø": "O", "ø": "o", "ß": "ss", "Œ": "OE", "œ": "oe", "Đ": "D", "đ": "d", "Ł": "L", "ł": "l", "Þ": "TH", "þ": "th"}
# The columns that make up the search text, in order.
SEARCH_COLUMNS = ["description", "trans_type", "bank_name", "branch_name", "account_no", "cheque", "reference", "batch_number", "tracer_number", "instrument_number", "trans_code", "branch_code"]


# Characters that Python's strip() takes away.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """c without white space of any kind at its ends."""
    return F.btrim(c, F.lit(WHITE))


def present(c: Column) -> Column:
    """c trimmed, null where it is one of the words for null."""
    t = strip(c)
    return F.when(~F.lower(t).isin(NULL_WORDS), t)


def is_float(c: Column) -> Column:
    """Whether Python's float() takes the text once trimmed and rid of commas; false for null."""
    return F.coalesce(F.regexp_replace(strip(c), ",", "").rlike(FLOAT), F.lit(False))


def to_float(c: Column) -> Column:
    """That number, null where there is none. Digits grouped by underscores count, a trailing d or f doesn't."""
    t = F.regexp_replace(strip(c), "[,_]", "")
    return F.when(is_float(c), t.try_cast("double"))


def parse_decimal(c: Column, scale: int = 2) -> Column:
    """Amounts with currency signs, thousands commas and accounting parentheses."""
    t = present(c)
    minus = t.contains("(") & t.contains(")")
    digits = F.translate(F.when(minus, F.concat(F.lit("-"), F.translate(t, "()", ""))).otherwise(t), CURRENCY, "")
    return F.when(digits.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), digits.try_cast(f"decimal(38,{scale + 6})")).try_cast(f"decimal(18,{scale})")


def parse_integer(c: Column) -> Column:
    """Whole numbers; digits after a point are cut off."""
    t = F.translate(present(c), ",", "")
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("long")).when(t.rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"), F.try_divide(F.signum(t.try_cast("double")) * F.floor(F.abs(t.try_cast("double"))), F.lit(1)).try_cast("long"))


def parse_boolean(c: Column) -> Column:
    t = F.lower(strip(c))
    return F.when(t.isin(TRUE_WORDS), True).when(t.isin(FALSE_WORDS), False)


def parse_date(c: Column) -> Column:
    """The first of DATE_FORMATS that fits; for numeric dates the day comes first unless the year does."""
    t = present(c)

    def read(f: str) -> Column:
        d = F.to_date(F.try_to_timestamp(t, F.lit(f)))
        # years of two digits: 69 to 99 are of the twentieth century
        return d if "yyyy" in f else F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)

    return F.coalesce(*map(read, DATE_FORMATS))


def parse_time(c: Column) -> Column:
    t = F.upper(present(c))
    return F.date_format(F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in TIME_FORMATS)), "HH:mm")


def truncate_string(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def amount_text(c: Column) -> Column:
    """An amount as 1,234.50."""
    return F.format_number(c, 2)


def unaccent(c: Column) -> Column:
    out = F.translate(c, ACCENTED, PLAIN)
    for a, b in SPELT.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def search_text(**columns: Column) -> Column:
    """lower(unaccent(...)) of SEARCH_COLUMNS joined by one space each; a missing column or null leaves its space."""
    parts = []
    for name in SEARCH_COLUMNS:
        parts += [F.coalesce(columns[name].cast("string"), F.lit("")) if name in columns else F.lit(""), F.lit(" ")]
    return F.lower(unaccent(F.concat(*parts[:-1])))
