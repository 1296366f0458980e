"""Flag, type and rating derivations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from profilebook.functions import dates
from profilebook.functions.nulls import empty_to_null

# Fixed values from the reference's rules.
BANK_CUSTOMER_TYPES = (2, 5, 7)        # types that keep their SWIFT code
EXPORT_TYPES = (4, 5)                  # customer types whose limit type is 'E'
NY_DEFAULT_COUNTRIES = ("BR", "ARG")   # incorporation countries defaulting NY agency to 1
NO_RELATION_PURPOSE = 7                # purpose that blanks the relation type
NOT_APPLICABLE_LABELS = ("Not aplicable", "NA")
NOT_GIVEN = "NA"
NO_RATING = "NC"
EXPORT_TEXT_LIMIT = 105


def limit_type(customer_type: Column) -> Column:
    """``DECODE(type, '4','E', '5','E', 'C')``."""
    return F.when(customer_type.cast("string").isin(*[str(t) for t in EXPORT_TYPES]), F.lit("E")).otherwise(F.lit("C"))


def customer_type(segment: Column, letter: Column) -> Column:
    """Type code from client segment (user field 42) and master letter C/B."""
    up = F.upper(letter)
    def pair(c_val: int, b_val: int) -> Column:
        return F.when(up == "C", F.lit(c_val)).when(up == "B", F.lit(b_val))
    return (F.when(segment.isNull(), pair(1, 2))
            .when(segment == "02", pair(4, 5))
            .when(segment == "07", pair(6, 7))
            .otherwise(pair(1, 2))).cast("int")


def ny_agency(flag: Column, incorp_country: Column) -> Column:
    """YES -> '1', NO -> '0', otherwise '1' for the default countries."""
    by_country = F.when(incorp_country.isin(*NY_DEFAULT_COUNTRIES), F.lit("1")).otherwise(F.lit("0"))
    return F.when(flag == "YES", F.lit("1")).when(flag == "NO", F.lit("0")).otherwise(by_country)


def pep_flag(text: Column) -> Column:
    """``CASE TRIM(NVL(x,'N')) WHEN 'N' THEN '0' WHEN 'Y' THEN '1' ELSE '0'``."""
    t = F.trim(F.coalesce(text, F.lit("N")))
    return F.when(t == "Y", F.lit("1")).otherwise(F.lit("0"))


def counterpart_flag(text: Column) -> Column:
    """``CASE UPPER(x) WHEN 'SI' THEN 1 ELSE 0``."""
    return F.when(F.upper(text) == "SI", F.lit(1)).otherwise(F.lit(0))


def main_flag(core_id: Column, main_id: Column) -> Column:
    return F.when(core_id == main_id, F.lit(1)).otherwise(F.lit(0))


def aml_rating_search(ny: Column, ny_rating: Column, rating: Column) -> Column:
    """Search form: '1' -> NY rating, '0' -> local rating, else '' (= NULL)."""
    return F.when(ny == "1", ny_rating).when(ny == "0", rating)


def aml_rating_export(ny: Column, ny_rating: Column, rating: Column) -> Column:
    """Export form: NY agency 1 -> NY rating, else local rating."""
    return F.when(ny.cast("string") == "1", ny_rating).otherwise(rating)


def yes_no(flag: Column, yes: str = "Y", no: str = "N") -> Column:
    """``CASE NVL(x,'0') WHEN '0' THEN 'N' WHEN '1' THEN 'Y' ELSE 'N'``."""
    return F.when(F.coalesce(flag.cast("string"), F.lit("0")) == "1", F.lit(yes)).otherwise(F.lit(no))


def agency_text(ny: Column) -> Column:
    """``DECODE(NY_AGENCY, 1,'YES', '0','NO', NULL)``."""
    s = ny.cast("string")
    return F.when(s == "1", F.lit("YES")).when(s == "0", F.lit("NO"))


def exporter_text(flag: Column) -> Column:
    """``DECODE(SALES_MORE_30_PERCENT, 1,'SI', '0','NO', 'NO')``."""
    return F.when(flag.cast("string") == "1", F.lit("SI")).otherwise(F.lit("NO"))


def si_no(flag: Column) -> Column:
    """``CASE x WHEN 1 THEN 'SI' ELSE 'NO'``."""
    return F.when(flag == 1, F.lit("SI")).otherwise(F.lit("NO"))


def swift_for_banks(ctype: Column, swift: Column) -> Column:
    return F.when(ctype.isin(*BANK_CUSTOMER_TYPES), swift)


def relation_type_for_purpose(purpose: Column, relation: Column) -> Column:
    return F.when(purpose == NO_RELATION_PURPOSE, F.lit(NOT_GIVEN)).otherwise(relation)


def bank_type_label(label: Column) -> Column:
    """'Not aplicable' and 'NA' -> 'NA', anything else unchanged."""
    return F.when(label.isin(*NOT_APPLICABLE_LABELS), F.lit(NOT_GIVEN)).otherwise(label)


def main_ref_unless_sentinel(limit_date: Column, main_core: Column) -> Column:
    """Main customer's core id, except on rows carrying the sentinel date."""
    return F.when(dates.fmt_compact(limit_date) == "19800101", F.lit(None).cast("string")).otherwise(main_core)


def pad_month(m: Column) -> Column:
    """``CASE WHEN m < 10 THEN '0'||m ELSE TO_CHAR(m)`` (NULL stays NULL)."""
    s = m.cast("string")
    return F.when(m < 10, F.concat(F.lit("0"), s)).otherwise(s)


def split_pick(text: Column, part: int, sep: str = " ") -> Column:
    """``FN_SPLIT_STRING(text, part, sep)``: 1-based piece, NULL when absent."""
    return empty_to_null(F.split_part(text, F.lit(sep), F.lit(part)))


def rating_part(packed: Column, part: int) -> Column:
    """Agency rating from 'MOODYS:x SP:y FITCH:z', 'NC' when missing."""
    return F.coalesce(split_pick(split_pick(packed, part), 2, ":"), F.lit(NO_RATING))


def truncate_default(text: Column, default: str = NOT_GIVEN, width: int = EXPORT_TEXT_LIMIT) -> Column:
    """``SUBSTR(RTRIM(NVL(x, 'NA')), 1, 105)``."""
    return empty_to_null(F.substring(F.rtrim(F.coalesce(text, F.lit(default))), 1, width))


def number_text(n: Column) -> Column:
    """Oracle's number-to-text form: no trailing zeros, no leading zero ('.5')."""
    s = n.cast("string")
    s = F.when(F.instr(s, ".") > 0, F.regexp_replace(F.regexp_replace(s, "0+$", ""), "\\.$", "")).otherwise(s)
    return F.regexp_replace(s, "^(-?)0\\.", "$1.")
