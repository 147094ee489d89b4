"""Label tables of the domain. All are fixed values: they order and name the output."""

from __future__ import annotations

# Region code -> member label.
REGION_LABELS = {
    "AUS": "Aust",
    "1": "NSW",
    "2": "Vic",
    "3": "Qld",
    "4": "SA",
    "5": "WA",
    "6": "Tas",
    "7": "NT",
    "8": "ACT",
}

# Sheet label -> column label of the school counts.
SCHOOL_AGES = {
    "a 4 years and under": "Aged_4",
    "b 5 years": "Aged_5",
    "c 6 years": "Aged_6",
    "d 7 years": "Aged_7",
    "e 8 years": "Aged_8",
}
SCHOOL_MEMBERS = {
    "a NSW": "NSW",
    "b Vic.": "Vic",
    "c Qld": "Qld",
    "d SA": "SA",
    "e WA": "WA",
    "f Tas.": "Tas",
    "g NT": "NT",
    "h ACT": "ACT",
}
FOUNDATION_GRADE = "a Pre-Year 1 (Foundation Year)"

# Age reached -> label of the step that led to it.
AGE_STEPS = {
    1: "0 to 1 yr",
    2: "1 to 2 yr",
    3: "2 to 3 yr",
    4: "3 to 4 yr",
    5: "4 to 5 yr",
    6: "5 to 6 yr",
}

# Migration age codes and the bands they stand for.
MIGRATION_BANDS = {"A04": "0-4", "A59": "5-9"}

# Growth scenarios and their share of the full historic growth.
SCENARIO_SHARES = {"Zero": 0.0, "Med": 0.5, "High": 1.0}
NO_SCENARIO = "N.A."
