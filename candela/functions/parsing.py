"""Column expressions for closed domains. Unlike plain casts they accept nothing else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHA256 = "^[0-9a-f]{64}$"
OPEN_DIALECT, NARROW_DIALECT = (("true", "1", "yes"), ("false", "0", "no")), (("true", "1"), ("false", "0"))


def parse_bool(column: Column, dialect=OPEN_DIALECT, name: str = "value") -> Column:
    """true or false of the trimmed text, case ignored; anything else, null included, fails."""
    text = F.lower(F.trim(column.cast("string")))
    return F.when(text.isin(*dialect[0]), True).when(text.isin(*dialect[1]), False).otherwise(F.raise_error(F.concat(F.lit(f"{name} is no boolean: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def dataset_of(person: Column, prefixes: dict[str, str]) -> Column:
    """The label of the first prefix that the id starts with; other ids fail."""
    out = F.raise_error(F.concat(F.lit("no dataset for "), F.coalesce(person, F.lit("null")))).cast("string")
    for prefix, label in reversed(list(prefixes.items())):
        out = F.when(person.startswith(prefix), label).otherwise(out)
    return out


def finite(column: Column) -> Column:
    """The number, or null for NaN; infinities stay, as checks tell them apart."""
    return F.when(~F.isnan(column), column)


def is_finite(column: Column) -> Column:
    return F.coalesce(F.abs(column) < F.lit(float("inf")), F.lit(False)) & ~F.coalesce(F.isnan(column), F.lit(False))


def safe_identifier(column: Column, reserved=("con", "prn", "aux", "nul")) -> Column:
    """Portable as a file name: letters, digits, . _ -; no . or .. and no trailing dot."""
    low = F.lower(column)
    stem = F.split(low, r"\.")[0]
    return F.coalesce(column.rlike(r"^[A-Za-z0-9._-]+$") & ~column.isin(".", "..") & ~column.endswith(".") & ~stem.isin(*reserved) & ~stem.rlike("^(com|lpt)[1-9]$"), F.lit(False))


def absolute_path(column: Column, base: str) -> Column:
    """Relative paths resolved against base."""
    return F.when(column.startswith("/"), column).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), column))


def share_text(part: Column, whole: Column) -> Column:
    """part/whole (percent), the percent rounded half to even."""
    return F.format_string("%d/%d (%s%%)", part.cast("long"), whole.cast("long"), F.bround(100.0 * part / whole, 1).cast("decimal(5,1)").cast("string"))
