"""Text expressions: names, codes and labels of irregular statistical tables."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values that sources use: look-alike letters, total labels, month names, revenue concepts.
CYRILLIC_SECTIONS, LATIN_SECTIONS = "АВСЕН", "ABCEH"
TOTAL_CODES = ("TOTAL", "ALL", "B-E", "B–E", "B—E", "ВСЕГО")
TOTAL_NAMES = ("total", "all industries", "всего", "итого")
MONTHS_RU = ("январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь")
#: Concept, code suffix, name parts; the first that fits counts.
REVENUE_CONCEPTS = (
    ("PIT", "10102000010000110", ("personal income", "налог на доходы физических лиц")),
    ("CIT", "10101000000000110", ("corporate income", "налог на прибыль")),
    ("Own-source revenue", "10000000000000000", ("tax and non-tax", "налоговые и неналоговые")),
    ("Transfers from other budgets", "20200000000000000", ("transfers from other budgets",)),
    ("Non-repayable receipts", "20000000000000000", ("gratuitous", "transfers", "безвозмездные поступления")),
    ("Total revenue", "00000000000000000", ("total revenue", "доходы бюджета - всего")),
)
WHOLE_NAMES_OF_TOTAL = ("доходы", "revenue")
#: Shapes of text that must not be published, in any case: name, regular expression.
SECRETS = (
    ("github_token", r"(?i)gh[pousr]_[A-Za-z0-9]{20,}"),
    ("github_pat", r"(?i)github_pat_[A-Za-z0-9_]{20,}"),
    ("sk_token", r"(?i)sk-(?:proj-)?[A-Za-z0-9_-]{24,}"),
    ("access_key", r"(?i)AKIA[A-Z0-9]{16}"),
    ("private_key", r"(?i)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("user_info_url", r"(?i)https?://[^\s/]+:[^\s/@]+@"),
    ("signed_url", r"(?i)[?&](?:access_token|token|api_key|signature|X-Amz-Signature)=[^\s&]+"),
)
MACHINE_FOLDERS = ("Users", "home", "private", "tmp", "var/folders")
DRIVE_PATH = r"(?:^|[^A-Za-z0-9])[A-Za-z]:[\\/]"
PATH_FIELD = r"(?:^|_)(?:local_path|path|file|filename|candidate)$"


@F.pandas_udf(StringType())
def folded(x: pd.Series) -> pd.Series:
    """Compatibility forms made plain (NFKC), case folded; Spark has no function for either."""
    return x.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(x: Column | str) -> Column:
    """Lower case, outer blanks gone, inner white space one blank each."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), r"[\s\u00a0]+", " "))


def name_key(x: Column | str) -> Column:
    """Equal for names that differ in typography alone: case, compatibility forms, blanks, dots, dashes or ё."""
    return F.regexp_replace(F.translate(folded(_c(x)), "ё", "е"), r"[\s\u00a0.\-–—]+", "")


def latin_section(x: Column | str) -> Column:
    return F.translate(F.upper(F.trim(_c(x))), CYRILLIC_SECTIONS, LATIN_SECTIONS)


def code_key(x: Column | str) -> Column:
    """Without leading zeros; all zeros are one."""
    stripped = F.regexp_replace(F.trim(_c(x)), "^0+", "")
    return F.when(_c(x).isNotNull(), F.coalesce(F.nullif(stripped, F.lit("")), F.lit("0")))


def pad_code(x: Column | str, length: int) -> Column:
    return F.lpad(_c(x), length, "0")


def digits(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), "[^0-9]", "")


def code_endswith(x: Column | str, suffix: str) -> Column:
    return F.coalesce(digits(x).endswith(suffix), F.lit(False))


def join_code_parts(cells: Column | str, start: int = 4, length: int = 5) -> Column:
    """The parts as one code if all are numbers, else null."""
    parts = F.slice(_c(cells), start, length)
    return F.when((F.size(parts) == length) & F.forall(parts, lambda x: F.coalesce(x.rlike("^[0-9]+$"), F.lit(False))), F.array_join(parts, ""))


def first_nonempty(*columns: Column | str, default: str | None = None) -> Column:
    values = [F.nullif(F.trim(_c(c).cast("string")), F.lit("")) for c in columns]
    return F.coalesce(*values, F.lit(default))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(F.replace(_c(path), F.lit("\\"), F.lit("/")), "/"), -1)


def is_total(codes: tuple = (), names: tuple = ()) -> Column:
    """Whether any of the code columns or of the name columns holds a label of the whole."""
    plain = lambda c: F.trim(F.coalesce(_c(c), F.lit("")))
    found = [F.upper(plain(c)).isin(*TOTAL_CODES) for c in codes] + [F.lower(plain(c)).isin(*TOTAL_NAMES) for c in names]
    return F.greatest(*found, F.lit(False), F.lit(False))


def window_month(header: Column | str) -> Column:
    """Last month of a published window such as "январь-март3": footnote digits at its end are ignored. Null for all other texts: a
    year or digits elsewhere, a window that doesn't begin in January, January repeated, a month but January by itself."""
    plain = F.regexp_replace(F.lower(F.trim(_c(header))), r"\d+$", "")
    plain = F.trim(F.regexp_replace(plain, "\\s*[-–—]\\s*", "-"))
    first = MONTHS_RU[0]
    windows = {first: 1} | {f"{first}-{name}": i + 1 for i, name in enumerate(MONTHS_RU) if i}
    return F.coalesce(*[F.when(plain == name, F.lit(i)) for name, i in windows.items()])


def classify_revenue(code: Column | str, *names: Column | str) -> Column:
    """The revenue concept of a row, by code suffix or by what its names contain."""
    text = F.lower(F.concat_ws(" ", *[F.trim(_c(n)) for n in names])) if names else F.lit("")
    out = F.lit(None).cast("string")
    for concept, suffix, parts in reversed(REVENUE_CONCEPTS):
        fits = code_endswith(code, suffix)
        for part in parts:
            fits = fits | F.contains(text, F.lit(part))
        if concept == "Total revenue":
            fits = fits | F.trim(text).isin(*WHOLE_NAMES_OF_TOTAL)
        out = F.when(fits, concept).otherwise(out)
    return out


def territory_scope(code: Column | str, name: Column | str) -> Column:
    """national (code 643), federal_district, region (by its code's zeros, or an autonomous district), else surveyed_city."""
    c, n = F.coalesce(_c(code), F.lit("")), F.lower(F.coalesce(_c(name), F.lit("")))
    return (
        F.when(c == "643", "national")
        .when(n.contains("федеральный округ"), "federal_district")
        .when(c.endswith("00000000") | n.contains("автономный округ"), "region")
        .otherwise("surveyed_city")
    )


def sensitive(x: Column | str) -> dict[str, Column]:
    """For each shape of SECRETS, and for machine_path, whether the text has it."""
    t = _c(x)
    # Folders and drives begin with fixed characters, which are found much faster than by an expression that may start anywhere.
    drive = (t.contains(":/") | t.contains(":\\")) & t.rlike(DRIVE_PATH)
    machine = reduce(lambda a, b: a | b, [t.contains(f"/{folder}/") for folder in MACHINE_FOLDERS]) | drive
    return {name: F.coalesce(t.rlike(shape), F.lit(False)) for name, shape in SECRETS} | {"machine_path": F.coalesce(machine, F.lit(False))}


def sanitized(x: Column | str, field: str = "") -> Column:
    """The text as it may be published, null where it may not: a secret or a machine's path within prose. A path in a
    field of paths, or that is the whole text, is cut to its file's name; web addresses stay."""
    t = _c(x)
    found = sensitive(t)
    machine = found.pop("machine_path")
    secret = reduce(lambda a, b: a | b, found.values())
    whole = F.lit(re.search(PATH_FIELD, field) is not None) | t.rlike(r"^[/\\]|^[A-Za-z]:")
    name = basename(F.regexp_replace(F.replace(t, F.lit("\\"), F.lit("/")), "/+$", ""))
    out = F.when(secret, None).when(t.rlike("^https?://"), t).when(machine, F.when(whole, name))
    return out.otherwise(basename(t) if field == "local_path" else t)


def publishable(x: Column | str, field: str = "") -> Column:
    """sanitized, failing when read where a text may not be published."""
    clean = sanitized(x, field)
    refused = F.raise_error(F.lit(f"a credential, a signed URL or a machine's path is in {field or 'a text'}")).cast("string")
    return F.when(_c(x).isNotNull() & clean.isNull(), refused).otherwise(clean)


def json_array(x: Column | str) -> Column:
    return F.to_json(_c(x))
