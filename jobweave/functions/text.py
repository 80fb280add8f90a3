"""PRJ and STRF: cleaning, parsing and building of text columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave.functions.rules import bind, has_word_of

# ---------------------------------------------------------------- fixed values
STATE_CODES = {
    "massachusetts": "MA", "california": "CA", "new york": "NY", "texas": "TX", "florida": "FL",
    "illinois": "IL", "washington": "WA", "georgia": "GA", "virginia": "VA", "north carolina": "NC",
    "new jersey": "NJ", "pennsylvania": "PA", "ohio": "OH", "michigan": "MI", "colorado": "CO",
    "arizona": "AZ", "boston": "MA", "cambridge": "MA", "san francisco": "CA", "san jose": "CA",
    "bay area": "CA", "palo alto": "CA", "los angeles": "CA", "seattle": "WA", "nyc": "NY",
    "new york city": "NY", "austin": "TX", "dallas": "TX", "houston": "TX", "chicago": "IL",
    "atlanta": "GA", "denver": "CO", "miami": "FL", "philadelphia": "PA",
}
DATE_JUNK = ["N/A", "", "None", "null", "Apply"]
# Format and the shape of text it is tried on. Order matters: month first is
# tried before day first.
DATE_FORMATS = [
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3}\s+\d{1,2},\s+\d{4}$"),
    ("MMMM d, yyyy", r"^[A-Za-z]{3,}\s+\d{1,2},\s+\d{4}$"),
    ("yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyy-M-d'T'H:m:s", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyy-M-d'T'H:m:s.SSSSSS'Z'", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}Z$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("d MMM yyyy", r"^\d{1,2}\s+[A-Za-z]{3}\s+\d{4}$"),
    ("d MMMM yyyy", r"^\d{1,2}\s+[A-Za-z]{3,}\s+\d{4}$"),
]
JOB_ID_PATTERNS = [
    r"[Jj]ob\s*[IiDd#]+[\s:]*([A-Z0-9\-]+)",
    r"[Rr]eq(?:uisition)?[\s#:]*([A-Z0-9\-]+)",
    r"[IiDd]+[\s:]*([0-9]{5,})",
]
COMPANY_SIZES = [
    "1-10", "11-50", "51-200", "201-500", "501-1000", "1000+", "10000+", "1001-5000", "5001-10000", "101-250",
]
NEW_GRAD_TERMS = ["new grad", "new-grad", "entry level"]
# ------------------------------------------------------------ end fixed values


def strip(col: Column) -> Column:
    """Leading and trailing white space of any kind removed; ``trim`` takes blanks only."""
    return F.btrim(col, F.lit(" \t\n\r\f\x0b"))


def null_clean(col: Column) -> Column:
    """PRJ2: trimmed text, with blanks and the text ``nan`` as NULL."""
    text = strip(col)
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def null_clean_number(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def truncate_ellipsis(col: Column, limit: int) -> Column:
    """PRJ3"""
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit - 3), F.lit("..."))).otherwise(col)


def truncate_at_sentence(col: Column, limit: int = 1500) -> Column:
    """PRJ4: cut after the last full stop if it lies in the last fifth of the limit."""
    head = F.substring(col, 1, limit)
    from_end = F.locate(".", F.reverse(head))
    last_stop = limit - from_end  # zero-based position of the last full stop
    cut = F.when((from_end > 0) & (last_stop > limit * 0.8), F.substring(head, F.lit(1), last_stop + 1)).otherwise(
        F.concat(head, F.lit("..."))
    )
    return F.when(F.length(col) > limit, cut).otherwise(col)


def norm_key(col: Column) -> Column:
    """PRJ5"""
    return F.upper(F.trim(col))


def near_key(*cols: Column) -> list[Column]:
    """SET4 key parts: lower-cased and trimmed, NULL as empty."""
    return [F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in cols]


def days_since(date: Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), date)


def relative_day_label(days: Column, within: int = 7) -> Column:
    """PRJ7"""
    return (
        F.when(days == 0, "Today")
        .when(days == 1, "Yesterday")
        .when((days >= 0) & (days <= within), F.concat(days.cast("string"), F.lit(" days ago")))
    )


def salary_text_from_range(low: Column, high: Column) -> Column:
    """PRJ8: ``$low-$high`` when both bounds are present."""
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("$"), low, F.lit("-$"), high))


def format_us_phone(phone: Column) -> Column:
    """STRF2"""
    digits = F.regexp_replace(phone, r"\D", "")
    ten = F.when(F.length(digits) == 10, digits).when(
        (F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)
    )
    pretty = F.concat(
        F.lit("+1 ("), F.substring(ten, 1, 3), F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4)
    )
    return F.when(phone != "", F.coalesce(pretty, phone))


def state_code(location: Column, codes: dict[str, str] = STATE_CODES) -> Column:
    """STRF3"""
    table = F.create_map(*map(F.lit, chain.from_iterable(codes.items())))
    return F.coalesce(table[F.lower(F.trim(location))], F.substring(F.upper(location), 1, 2))


def parse_posted_date(col: Column, as_of: str) -> Column:
    """STRF4: posting time from free text, relative to ``as_of``; junk gives NULL."""
    now = F.lit(as_of).cast("timestamp_ntz")

    def parse(text: Column, fmt: str) -> Column:
        return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")

    def read(text: Column) -> Column:
        low = F.lower(text)
        amount = F.regexp_extract(low, r"^(\d+)\s", 1).try_cast("int")
        # a format is tried only on text of its shape, as a failed parse is slow
        parsed = [F.when(text.rlike(shape), parse(text, fmt)) for fmt, shape in DATE_FORMATS]
        first_word = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}\s"), parse(F.split(text, r"\s+")[0], "yyyy-M-d"))
        ago = low.contains("ago")
        relative = (
            F.when(ago & low.contains("day") & amount.isNotNull(), now - F.make_dt_interval(days=amount))
            .when(
                ago & ~low.contains("day") & low.contains("hour") & amount.isNotNull(),
                now - F.make_dt_interval(hours=amount),
            )
            .when(low.contains("yesterday"), now - F.expr("INTERVAL 1 DAY"))
            .when(low.contains("today"), now)
        )
        return F.coalesce(*parsed, first_word, relative)

    return bind(F.when(~col.isin(DATE_JUNK), F.regexp_replace(strip(col), r"\s+", " ")), read)


def company_size_in(text: Column, sizes: list[str] = COMPANY_SIZES) -> Column:
    """STRF6: whether the text names a company-size band."""
    return has_word_of(text, sizes)


def is_new_grad_text(text: Column) -> Column:
    """STRF6"""
    return has_word_of(F.lower(text), NEW_GRAD_TERMS)


def extract_job_id(text: Column) -> Column:
    """STRF7: the first pattern that matches gives the id, else empty."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in JOB_ID_PATTERNS], F.lit(""))


def clean_model_json(response: Column, labels: list[str]) -> Column:
    """STRF8: validated classification from a model reply, else NULL.

    Code fences are dropped, the outermost braces are parsed, and the label
    and the confidence must be valid.
    """
    bare = strip(F.regexp_replace(response, r"```(json)?\n?", ""))
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "visa_category string, confidence double, signals array<string>, reasoning string")
    valid = parsed["visa_category"].isin(labels) & parsed["confidence"].between(0.0, 1.0)
    return F.when(valid, parsed)


def composite_key(*parts: Column) -> Column:
    """STRF9"""
    return F.concat_ws("_", *parts)


def cache_key(question: Column, resume: Column | None = None, last_turn: Column | None = None) -> Column:
    """STRF9: digest of the question, the résumé and the last user turn, all whole."""
    pieces = [strip(F.lower(question))]
    if resume is not None:
        pieces.append(F.when(resume != "", F.concat(F.lit("|resume:"), resume)))
    if last_turn is not None:
        pieces.append(F.concat(F.lit("|history:"), last_turn))
    return F.md5(F.concat(*[F.coalesce(p, F.lit("")) for p in pieces]))


def embedding_text(title: Column, company: Column, description: Column, longest: int | None = None) -> Column:
    """STRF10: the whole text, or the first ``longest`` characters of the description for a model that takes no more."""
    body = description if longest is None else F.substring(description, 1, longest)
    return F.concat(title, F.lit(". "), company, F.lit(". "), body)


def skills_text(skills: Column, title: Column) -> Column:
    return F.coalesce(skills, title)


def flatten_skill_map(skills: Column) -> Column:
    """STRF14: map of category to list of skills as one list."""
    return F.flatten(F.map_values(skills))
