from __future__ import annotations

from pyspark.sql import Column, functions as F

# Letters folded to their plain form for name matching.
ACCENTED = "ąćęłńóśźżäöüàâçéèêëîïôûùáíúñ"
PLAIN = "acelnoszzaouaaceeeeiiouuaiun"

# Groups of three behind commas are thousands; any other comma between digits is a decimal one. A minus counts
# only where no letter or digit stands before it, so ranges and dates keep their figures.
THOUSANDS = r"[0-9]{1,3}(?:,[0-9]{3})+(?![0-9,])(?:[.][0-9]+)?"
NUMBER = rf"(?:(?<![0-9A-Za-z])[-\u2212])?(?:(?<![0-9.,]){THOUSANDS}|[0-9]+(?:[.,][0-9]+)?)"


def fold(name: Column) -> Column:
    """Case and accent folding with outer blanks removed."""
    return F.translate(F.lower(F.trim(name)), ACCENTED, PLAIN)


def numbers_in(text: Column) -> Column:
    """All numbers in a text as doubles, in order; with decimal point or comma, and with their sign."""
    def value(s: Column) -> Column:
        plain = F.when(s.rlike(rf"^[-\u2212]?{THOUSANDS}$"), F.replace(s, F.lit(","), F.lit(""))).otherwise(F.translate(s, ",", "."))
        return F.translate(plain, "\u2212", "-").cast("double")
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), value)
