"""Cleaning and classification of labels found in report grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark total rows, label keywords and sub-header literals
# as they appear in the reports.
TOTAL_WORDS = ("всього", "усього")
REGION_WORDS = ("по області",)
SUBTOTAL_WORDS = ("разом", "в тому числі", "у тому числі")
OTHER_SPECIES = "Інші"
INCLUDING_WORDS = ("в тому числі", "у тому числі")
TOTAL_SUFFIXES = ("-всього", "-усього")
SUBHEADER_LITERAL = "Код тварини"
SHOT_WORD, TONS_WORD = "добуто", "тонн"
LABEL_METRICS = (
    ("загальна кількість", "count"),
    ("розселено", "relocated"),
    ("відловлено", "caught"),
    ("виявлено загиблими", "found_dead"),
)
EARLY_SYNONYMS = {"Байбак": "Бабак"}

_EDGE_SPACE = r"(?U)^\s+|\s+$"
_EDGE_SPACE_AND_STARS = r"(?U)^\s+|\s*\**\s*$"


def _one_of(words: Sequence[str]) -> str:
    """Regular expression matching any of the literal words."""
    return "|".join(f"\\Q{word}\\E" for word in words)


def _no_space(char: Column) -> Column:
    """Is the first character one of the ranges without any Unicode white space?"""
    code = F.ascii(char)
    return code.between(0x21, 0x84) | code.between(0xA1, 0x167F)


def strip_text(c: Column) -> Column:
    """Trim any Unicode white space; ``trim`` alone only removes U+0020.

    Most texts have none at their ends, which their first and last character tell.
    """
    tidy = _no_space(c) & _no_space(F.substring(c, -1, 1))
    return F.when(tidy, c).otherwise(F.regexp_replace(c, _EDGE_SPACE, ""))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Does the text hold one of the (lower-case) words, whatever its case? One pass over the text."""
    return F.lower(c).rlike(_one_of(words))


def is_aggregate(c: Column, extended: bool = False) -> Column:
    """Does the name denote a total row rather than an entity?"""
    words = TOTAL_WORDS + REGION_WORDS + (SUBTOTAL_WORDS if extended else ())
    return contains_any(c, words)


def is_contaminant(c: Column, denylist: Sequence[str] = ()) -> Column:
    """Phone numbers (a run of ten or more digits) or a denylisted name in an entity field."""
    phone = c.rlike(r"\p{Nd}{10,}")
    return phone | contains_any(c, [word.lower() for word in denylist]) if denylist else phone


def _tidy_species(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, _EDGE_SPACE_AND_STARS, ""), " {2,}", " ")
    return F.translate(F.replace(bare, F.lit("- "), F.lit("-")), '"', "'")


def norm_species_v1(c: Column) -> Column:
    """Species name of the middle era; NULL for totals and the remainder group."""
    name = _tidy_species(c)
    void = name.rlike(f"^{OTHER_SPECIES}$|(?iu:{_one_of(TOTAL_WORDS)})")
    return F.when(~void, name)


def norm_species_v2(c: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Species name of the later eras.

    Only the first letter is upper-cased (``initcap`` would touch every word). A
    total prefix or an "including" phrase voids the name; a total suffix is cut.
    Conditions are folded into one pattern, so the tidied text is built few times.
    """
    tidy = _tidy_species(c)
    other = f"[{OTHER_SPECIES[0]}{OTHER_SPECIES[0].lower()}]{OTHER_SPECIES[1:]}"
    void = tidy.rlike(f"^$|^{other}$|(?iu:^(?:{_one_of(TOTAL_WORDS)})|{_one_of(INCLUDING_WORDS)})")
    name = F.concat(F.upper(F.substring(tidy, 1, 1)), F.substr(tidy, F.lit(2)))
    for raw, canonical in (EARLY_SYNONYMS if synonyms is None else synonyms).items():
        name = F.regexp_replace(name, f"^\\Q{raw}\\E$", canonical)
    cut = F.regexp_replace(name, f"(?iuU)\\s*(?:{_one_of(TOTAL_SUFFIXES)})$", "")
    return F.when(~void, cut)


def species_from_label(c: Column) -> Column:
    """The species part of a label such as ``"<species> - <what was counted>"``."""
    head = F.when(F.contains(c, F.lit(" - ")), F.substring_index(c, " - ", 1)).otherwise(
        F.substring_index(c, " -", 1)
    )
    return strip_text(head)


def detect_metric(name: Column, unit: Column) -> Column:
    """Metric from a row label; the harvest word wins and its unit splits tons from heads."""
    lowered = F.lower(name)
    metric = F.when(
        F.contains(lowered, F.lit(SHOT_WORD)),
        F.when(F.contains(F.lower(unit), F.lit(TONS_WORD)), "shot_tons").otherwise("shot_heads"),
    )
    for keyword, value in LABEL_METRICS:
        metric = metric.when(F.contains(lowered, F.lit(keyword)), value)
    return metric


def is_species_header(code: Column) -> Column:
    """A row with an animal code opens a species block."""
    text = strip_text(code)
    return F.coalesce((text != "") & (text != SUBHEADER_LITERAL), F.lit(False))


def is_group_code(code: Column) -> Column:
    """Codes divisible by 100 are group totals. A code that is no number is no group."""
    number = code.try_cast("double").try_cast("bigint")
    return F.coalesce(number % 100 == 0, F.lit(False))
