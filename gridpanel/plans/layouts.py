"""Report layouts by era. All values here are fixed: they describe the reports themselves."""

from __future__ import annotations

# Keywords that locate headers and sections.
USER_WORD = "Користувач"
NAME_WORD = "Найменування"
SECTION_FOUR_WORDS = ("ІV", "ШТУЧНЕ РОЗВЕДЕННЯ")
COUNT_SHEET_WORD = "чисельн"
RELOCATION_SHEET_WORD = "озселенн"
COUNT_TOTAL_WORD = "Чисельність всього"

# Keywords that open the species sections, later eras.
COUNT_SECTIONS = {
    "ungulates": "Чисельність копитних",
    "fur": "Чисельність хутрових",
    "birds": "Чисельність пернатих",
}
HARVEST_SECTIONS = {
    "ungulates": "Кількість добутих (вилучених) копитних",
    "fur": "Кількість добутих (вилучених) хутрових",
    "birds": "Кількість добутих (вилучених) пернатих",
}

# Sheet names.
MIDDLE_MAIN_SHEET = "2-тп 1"
MIDDLE_COUNT_SHEETS = ("облік\n", "облік ", "облік1", "облік")
LATEST_COUNT_SHEET = "Чисельність"
LATE_MAIN_SHEETS = ("8. ОП користувачів ", "8. ОП користувачів {year}", "8.ОП користувачів {year}")

# Row offsets below the header, early era.
EARLY_ENTITY_ROWS = {
    2: "area_total",
    3: "area_managed",
    4: "area_counted",
    5: "staff_total",
    6: "staff_biologists",
    7: "staff_rangers",
}
EARLY_FINANCE_ROWS = {
    11: "total_expenses",
    12: "gov_funding",
    13: "salary",
    16: "expense_counting",
    17: "expense_protection",
    22: "expense_feeding",
    25: "revenue",
}
EARLY_SPECIES_OFFSET = 29
EARLY_FIRST_HOST_COL = 3

# Columns, middle era.
MIDDLE_ENTITY_COLS = {
    1: "area_total",
    2: "area_forest",
    3: "area_field",
    4: "area_water",
    5: "area_managed",
    6: "area_managed_this_year",
    7: "staff_total",
    8: "staff_biologists",
    9: "staff_rangers",
}
MIDDLE_FINANCE_COLS = {
    10: "total_expenses",
    11: "gov_funding",
    12: "salary",
    14: "expense_counting",
    15: "expense_protection",
    20: "expense_arrangement",
    21: "revenue",
}
MIDDLE_COL_RANGES = (
    (80, 99, "relocated"),
    (99, 114, "caught"),
    (114, 124, "found_dead"),
    (124, 181, "shot_heads"),
    (181, 238, "illegal_shot"),
)
MIDDLE_SPECIES_ROW = 2

# Columns, transitional year (entity columns as in the middle era).
HYBRID_FINANCE_COLS = {
    10: "total_expenses",
    11: "gov_funding",
    12: "salary",
    13: "expense_protection",
    14: "expense_breeding",
    15: "expense_arrangement",
    16: "revenue",
}
HYBRID_SECTION_ROW = 0
HYBRID_SPECIES_ROW = 2

# Rows and the host column of the latest count sheet.
LATEST_SPECIES_ROW = 3
LATEST_SUB_ROW = 4
LATEST_FIRST_ROW = 5
LATEST_HOST_COL = 1

# Columns, late and latest eras.
LATE_ENTITY_COLS = {
    1: "area_total",
    2: "area_forest",
    3: "area_field",
    4: "area_water",
    5: "area_managed",
    6: "staff_total",
    7: "staff_biologists",
    8: "staff_rangers",
}
LATE_FINANCE_COLS = {
    10: "total_expenses",
    12: "gov_funding",
    14: "salary",
    16: "expense_protection",
    18: "expense_breeding",
    20: "revenue",
}

# Area metrics the 2025 reports give in hectares under a thousand-hectare heading.
AREA_RULES = tuple(
    (metric, 2025, 2025, 1000.0)
    for metric in ("area_total", "area_forest", "area_field", "area_water", "area_managed")
)
