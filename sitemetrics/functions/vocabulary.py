"""Header vocabulary. Business value vocabularies (sites, segments, outlets) are arguments, not constants."""

from __future__ import annotations

from dataclasses import dataclass, field

# Header synonyms with weights per role.
HEADER_SYNONYMS: dict[str, list[tuple[str, float]]] = {
    "date": [
        ("date", 1.0), ("report date", 1.0), ("txn date", 1.0), ("txn dt", 1.0), ("transaction date", 1.0),
        ("business date", 1.0), ("bill date", 1.0), ("invoice date", 0.9), ("day", 0.7), ("dt", 0.6),
        ("period", 0.5), ("as on", 0.5), ("month", 0.4),
    ],
    "location": [
        ("location", 1.0), ("city", 1.0), ("airport", 1.0), ("station", 0.9), ("branch", 0.8), ("site", 0.8),
        ("region", 0.7), ("geography", 0.7), ("geographical segment", 0.9), ("airport code", 0.9), ("loc", 0.7), ("place", 0.6),
    ],
    "segment": [
        ("segment", 1.0), ("business segment", 1.0), ("business line", 1.0), ("business", 0.9), ("line of business", 1.0),
        ("lob", 0.9), ("division", 0.8), ("category", 0.7), ("vertical", 0.8), ("business vertical", 0.9), ("dept", 0.5),
        ("department", 0.6),
    ],
    "outlet": [
        ("outlet", 1.0), ("outlet name", 1.0), ("unit", 0.8), ("unit name", 0.9), ("unit id", 0.8), ("sub business", 0.9),
        ("sub-business", 0.9), ("service", 0.7), ("service point", 0.8), ("store", 0.8), ("shop", 0.7), ("counter", 0.7),
        ("facility", 0.7), ("property", 0.6), ("cost center", 0.6), ("profit center", 0.6), ("lounge name", 0.9),
    ],
    "business_unit": [("business unit", 1.0), ("bu", 0.7), ("sub segment", 0.9), ("sub-segment", 0.9)],
    "pax": [
        ("pax", 1.0), ("passengers", 1.0), ("passenger count", 1.0), ("guests", 1.0), ("guest count", 1.0), ("footfall", 1.0),
        ("covers", 0.9), ("visitors", 0.9), ("headcount", 0.8), ("no of pax", 1.0), ("no. of pax", 1.0), ("pax count", 1.0),
        ("qty", 0.5), ("quantity", 0.5), ("count", 0.4), ("nos", 0.4), ("users", 0.6), ("customers", 0.7),
    ],
    "revenue": [
        ("revenue", 1.0), ("total revenue", 1.0), ("net revenue", 1.0), ("gross revenue", 1.0), ("rev", 0.9), ("sales", 0.9),
        ("net sales", 0.95), ("gross sales", 0.95), ("total sales", 0.95), ("amount", 0.8), ("total amount", 0.85),
        ("net amount", 0.85), ("value", 0.6), ("income", 0.8), ("turnover", 0.9), ("collection", 0.8), ("billing", 0.75),
        ("earned", 0.6), ("inr", 0.6), ("rs", 0.5),
    ],
    "aop": [
        ("aop", 1.0), ("budget", 1.0), ("target", 0.95), ("aop target", 1.0), ("plan", 0.7), ("budgeted revenue", 1.0),
        ("target revenue", 1.0), ("annual operating plan", 1.0),
    ],
    "traffic": [
        ("traffic", 1.0), ("airport traffic", 1.0), ("total traffic", 1.0), ("atm", 0.5), ("throughput", 0.7), ("passenger traffic", 0.95),
    ],
}
ROLES = list(HEADER_SYNONYMS)
REQUIRED = ["date", "location", "segment", "outlet", "revenue"]
METRICS = ["pax", "revenue", "aop", "traffic"]

# Header hints that exclude a column from every role but the customer count.
EXCLUDING_HINTS = ["%", "percent", "growth", "variance", "serial", "s no", "s.no", "sno", "sl no", "sr no"]

# Column aliases of the plain long layout.
COLUMN_ALIASES: dict[str, list[str]] = {
    "date": ["date", "report date", "day"],
    "segment": ["segment", "business", "business segment", "category"],
    "outlet": ["outlet", "sub-business", "sub business", "sub_business", "outlet name", "service"],
    "location": ["location", "city", "airport"],
    "pax": ["pax", "passengers", "footfall", "guests"],
    "revenue": ["revenue", "rev", "amount", "total revenue"],
    "aop": ["aop", "budget", "target", "aop target"],
    "traffic": ["traffic", "airport traffic", "total traffic"],
}
# Thresholds of the inference step.
HEADER_DEPTH, HEADER_FLOOR = 40, 0.35
ASSIGN_FLOOR, ACCEPT = 0.30, 0.55


@dataclass(frozen=True)
class Vocab:
    """Business vocabulary of one installation."""

    places: dict[str, str] = field(default_factory=dict)
    segments: dict[str, str] = field(default_factory=dict)
    outlet_keywords: list[tuple[str, str]] = field(default_factory=list)
    default_segment: str = "Others"
    years: tuple[int, int] = (2000, 2050)
