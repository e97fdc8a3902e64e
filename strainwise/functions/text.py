"""Text expressions that behave like Python's string methods."""

from pyspark.sql import Column, functions as F

# A number as a data-frame reader would accept it: blanks around, optional
# sign and exponent, no unit suffix, no hex, no digit separators, no inf/nan.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# The white space of Unicode, as text methods strip it.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove any leading and trailing white space, tabs and newlines included."""
    return F.btrim(col(c), F.lit(BLANKS))


def capitalize(c) -> Column:
    """First character upper case, the rest lower case."""
    x = col(c)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.length(x))))


def title(c) -> Column:
    """Upper-case after *every* non-letter.

    ``initcap`` only restarts after a space. Where other non-letters occur, a space
    is inserted behind each non-letter first and taken out again afterwards.
    """
    x = col(c)
    spaced = F.regexp_replace(x, r"([^\p{L}])", "$1 ")
    restarted = F.regexp_replace(F.initcap(spaced), r"([^\p{L}]) ", "$1")
    return F.when(x.rlike(r"^[\p{L} ]*$"), F.initcap(x)).otherwise(restarted)


def as_number(c) -> Column:
    """Double, or NULL for anything that is not a plain finite number."""
    x = col(c).cast("string")
    value = F.when(x.rlike(NUMBER), x.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def normal_id(c) -> Column:
    """Lookup key of an id: stripped and lower case."""
    return F.lower(strip(col(c).cast("string")))


def recode(c, mapping: dict, keep_others: bool = False) -> Column:
    """Dictionary lookup; unmapped values become NULL unless ``keep_others``."""
    x = col(c)
    found = F.element_at(F.create_map(*[F.lit(y) for pair in mapping.items() for y in pair]), x)
    return F.coalesce(found, x) if keep_others else found
