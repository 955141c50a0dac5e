"""PostgreSQL text to Spark SQL, and the read-only check on parsed plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Words that a read-only query may not hold outside of literals and names.
FORBIDDEN = ["update", "delete", "drop", "insert", "alter", "truncate", "create", "grant", "revoke", "replace"]
# Format letters of to_char and those of date_format.
FORMATS = [("YYYY", "yyyy"), ("HH24", "HH"), ("MI", "mm"), ("SS", "ss"), ("DD", "dd"), ("Mon", "MMM")]


def pieces(sql: str) -> list[tuple[bool, str]]:
    """(is a literal or quoted name, text), comments gone."""
    out, at = [], 0
    for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", sql, re.S):
        out.append((False, sql[at : m.start()]))
        out.append((True, m[0]) if m[0][0] in "'\"" else (False, " "))
        at = m.end()
    return [*out, (False, sql[at:])]


#: A literal or quoted name that translate() has put aside, by its number.
ASIDE = "\ue000(\\d+)\ue001"
#: What is an integer by its look: numerals, counts, parts of dates, differences of dates, casts.
INTEGER = r"(?:(?<![\w.])\d+(?![\w.])|\b(?:count|extract|dayofweek|year|month|day|datediff)\s*\([^()]*\)|[\w.]+\s*::\s*(?:int|integer|bigint|smallint)\b)"


def translate(sql: str, date_columns: tuple[str, ...] = ("date", "value_date")) -> str:
    """Rewrites what means something else, or nothing, in Spark: day of week, month ends, to_char, date differences,
    casts, ILIKE and regex signs, division of integers, and the place of nulls in ORDER BY. Literals and quoted names are
    put aside first, so nothing in them changes but the formats and patterns that a rewritten call takes."""
    aside: list[str] = []

    def put(text: str) -> str:
        aside.append(text)
        return f"\ue000{len(aside) - 1}\ue001"

    s = "".join(put(t) if quoted else t for quoted, t in pieces(sql)).strip().rstrip(";")
    text = lambda m, i: aside[int(m[i])]
    d = "|".join(rf"(?:\w+\.)?{c}" for c in date_columns)
    s = re.sub(r"\bextract\s*\(\s*dow\s+from\s+([^()]+?)\s*\)", r"(dayofweek(\1) - 1)", s, flags=re.I)

    def month_end(m: re.Match) -> str:
        fits = text(m, 1).lower() == "'month'" and re.fullmatch(r"'1 month\s*-\s*1 day'", text(m, 3), re.I)
        return f"last_day({m[2]})" if fits else m[0]

    s = re.sub(rf"\(\s*date_trunc\s*\(\s*{ASIDE}\s*,\s*([^()]+?)\s*\)\s*\+\s*interval\s*{ASIDE}\s*\)(?:\s*::\s*date)?", month_end, s, flags=re.I)

    def to_char(m: re.Match) -> str:
        f = text(m, 2)
        for x, y in FORMATS:
            f = f.replace(x, y)
        return f"date_format({m[1]}, {put(f)})"

    s = re.sub(rf"\bto_char\s*\(\s*([^(),]+?)\s*,\s*{ASIDE}\s*\)", to_char, s, flags=re.I)
    s = re.sub(rf"(?<![\w.])({d})\s*-\s*({d})(?!\w)", r"datediff(\1, \2)", s, flags=re.I)
    s = re.sub(r"::\s*numeric\b(?!\s*\()", "::decimal(38,6)", s, flags=re.I)
    for sign, how, flags in ((r"\s*!~\*\s*", "NOT rlike", "(?i)"), (r"\s*~\*\s*", "rlike", "(?i)"), (r"\s*!~\s*", "NOT rlike", ""), (r"\s*~\s*", "rlike", "")):
        s = re.sub(rf"([^\s!~]+){sign}{ASIDE}", lambda m, how=how, flags=flags: f"{how}({m[1]}, {put(bounds(text(m, 2), flags))})", s)
    s = re.sub(rf"({INTEGER})\s*/\s*({INTEGER})(?!\s*\()", r"\1 div \2", s, flags=re.I)
    s = null_places(s)
    return re.sub(ASIDE, lambda m: text(m, 1), s)


def bounds(literal: str, flags: str) -> str:
    """A regex literal with word bounds spelled as here; as a raw string."""
    pattern = re.sub(r"\\[mMy]", lambda m: r"\b", literal[1:-1])
    return f"r{literal[0]}{flags}{pattern}{literal[-1]}"


def null_places(s: str) -> str:
    """Nulls are greatest: first when falling, last when rising, unless the term says otherwise."""

    def terms(m: re.Match) -> str:
        out, depth, term = [], 0, ""
        for ch in m[2] + ",":
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                if not re.search(r"\bnulls\s+(first|last)\s*$", term, re.I):
                    term = f"{term.rstrip()} NULLS {'FIRST' if re.search(r'desc\s*$', term.strip(), re.I) else 'LAST'}"
                out.append(term)
                term = ""
            else:
                term += ch
        return m[1] + ",".join(out)

    return re.sub(r"(\border\s+by\b)((?:(?!\border\s+by\b|\blimit\b|\boffset\b|\brows\b|\brange\b).)*?)(?=\blimit\b|\boffset\b|\brows\b|\brange\b|$|\)(?![^()]*\())", lambda m: terms(m) + " ", s, flags=re.I | re.S)


def keyword_check(sql: str) -> str | None:
    """The first forbidden word outside of literals and quoted names, or None."""
    text = " ".join(t for quoted, t in pieces(sql) if not quoted)
    return next((w for w in FORBIDDEN if re.search(rf"\b{w}\b(?!\s*\()", text, re.I)), None)


def read_only(spark: SparkSession, sql: str) -> str | None:
    """Why a statement may not run: it isn't one query that only reads. None if it may. Judged by its parsed plan."""
    if w := keyword_check(sql):
        return f"the query holds the word {w}"
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(translate(sql))
    except Exception as e:
        return f"it can't be parsed: {str(e).splitlines()[0]}"
    text = plan.treeString()
    heads = re.findall(r"^[\s:+|'-]*(\w+)", text, re.M)
    bad = next((h for h in heads if re.search(r"Command|Insert|Create|Drop|Alter|Merge|Delete|Update|Overwrite|Append|Truncate|SetCatalog|Describe|Show|Explain|Call|Cache|Refresh", h)), None)
    return f"the statement is a {bad}" if bad else None


def run(spark: SparkSession, sql: str) -> DataFrame:
    if why := read_only(spark, sql):
        raise ValueError(why)
    return spark.sql(translate(sql))
