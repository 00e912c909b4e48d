"""Tariffs, weights, dimensions, thresholds and word lists.

These must equal the published reference values for results to agree, so they are
stated plainly and in natural order. All are bounded by the number of airports,
carriers, sources, sectors or booking windows of the basket.
"""

from __future__ import annotations

# --- fixed values: booking windows and their share of bookings -------------------
WINDOWS = [1, 7, 15, 30, 45]
WINDOW_WEIGHTS = {1: 0.05, 7: 0.20, 15: 0.30, 30: 0.30, 45: 0.15}

# --- fixed values: city pairs ----------------------------------------------------
# (one end, other end, km, minutes, tier, raw two-way traffic weight,
#  million passengers a year each way)
CITY_PAIRS = [
    ("DEL", "BOM", 1148, 130, "Trunk", 0.15, 6.25),
    ("DEL", "BLR", 1740, 165, "Trunk", 0.10, 4.1),
    ("BOM", "BLR", 842, 105, "Trunk", 0.09, 3.75),
    ("DEL", "HYD", 1253, 135, "Trunk", 0.075, 3.05),
    ("DEL", "CCU", 1305, 135, "Trunk", 0.07, 2.9),
    ("HYD", "BOM", 617, 90, "High-Density", 0.05, 2.1),
    ("PNQ", "DEL", 1173, 130, "High-Density", 0.05, 1.95),
    ("AMD", "DEL", 775, 95, "High-Density", 0.045, 1.85),
    ("HYD", "BLR", 500, 75, "High-Density", 0.045, 1.75),
    ("MAA", "DEL", 1760, 170, "High-Density", 0.04, 1.65),
    ("DEL", "JAI", 241, 55, "Regional", 0.035, 1.05),
    ("BOM", "GOI", 435, 75, "Regional", 0.04, 1.4),
    ("DEL", "LKO", 418, 70, "Regional", 0.035, 1.25),
    ("DEL", "SXR", 650, 90, "Seasonal", 0.04, 1.0),
    ("CCU", "GAU", 510, 75, "Regional", 0.035, 0.95),
]

# --- fixed values: airports ------------------------------------------------------
# (code, city, latitude, longitude, annual income per head)
AIRPORTS = [
    ("DEL", "Delhi", 28.5562, 77.1000, 444768.0),
    ("BOM", "Mumbai", 19.0896, 72.8656, 385000.0),
    ("BLR", "Bengaluru", 13.1986, 77.7066, 365000.0),
    ("HYD", "Hyderabad", 17.2403, 78.4294, 348000.0),
    ("CCU", "Kolkata", 22.6547, 88.4467, 168000.0),
    ("PNQ", "Pune", 18.5822, 73.9197, 370000.0),
    ("AMD", "Ahmedabad", 23.0734, 72.6347, 310000.0),
    ("MAA", "Chennai", 12.9941, 80.1709, 320000.0),
    ("JAI", "Jaipur", 26.8242, 75.8122, 185000.0),
    ("GOI", "Goa", 15.3808, 73.8313, 520000.0),
    ("LKO", "Lucknow", 26.7606, 80.8893, 115000.0),
    ("SXR", "Srinagar", 33.9871, 74.7742, 145000.0),
    ("GAU", "Guwahati", 26.1061, 91.5859, 140000.0),
]
DEFAULT_INCOME = 250000.0
DEFAULT_POINT_FROM = (28.55, 77.10)
DEFAULT_POINT_TO = (19.08, 72.86)

# --- fixed values: carriers (code, name, type, market share, direct source) ------
CARRIERS = [
    ("6E", "IndiGo", "LCC", 0.62, "indigo"),
    ("AI", "Air India", "FSC", 0.14, "airindia"),
    ("IX", "Air India Express", "LCC", 0.07, "airindiaexpress"),
    ("QP", "Akasa Air", "LCC", 0.05, "akasa"),
    ("SG", "SpiceJet", "LCC", 0.04, "spicejet"),
]
OTHER_CARRIERS_SHARE = ("OTHERS", 0.08)
UNKNOWN_CARRIER_SHARE = 0.05

# --- fixed values: user development fee by origin --------------------------------
# cleaning, primary schedule
UDF_PRIMARY = {
    "DEL": 650.0, "BOM": 450.0, "BLR": 550.0, "HYD": 480.0, "CCU": 420.0,
    "PNQ": 390.0, "AMD": 350.0, "MAA": 380.0, "JAI": 320.0, "GOI": 400.0,
    "LKO": 350.0, "SXR": 300.0, "GAU": 280.0,
}
# cleaning, baseline schedule for airports the primary one lacks
UDF_BASELINE = {
    "DEL": 450.0, "BOM": 380.0, "BLR": 450.0, "HYD": 410.0, "CCU": 400.0,
    "PNQ": 390.0, "AMD": 350.0, "MAA": 380.0, "JAI": 390.0, "GOI": 350.0,
    "LKO": 350.0, "SXR": 300.0, "GAU": 320.0,
}
UDF_DEFAULT = 380.0
# page extraction
UDF_EXTRACTION = {
    "DEL": 450.0, "BOM": 380.0, "BLR": 450.0, "HYD": 410.0, "CCU": 390.0,
    "PNQ": 360.0, "AMD": 350.0, "MAA": 370.0, "JAI": 390.0, "GOI": 420.0,
    "LKO": 350.0, "SXR": 340.0, "GAU": 350.0,
}
UDF_EXTRACTION_DEFAULT = 400.0
PSF = 180.0
GST_RATE = 0.05

# --- fixed values: booking fee by source -----------------------------------------
SOURCE_FEES = {
    "easemytrip": 0.0, "emt": 0.0, "makemytrip": 350.0, "mmt": 350.0,
    "cleartrip": 300.0, "ct": 300.0, "ixigo": 250.0, "ixi": 250.0,
    "indigo": 0.0, "6e": 0.0, "airindia": 0.0, "ai": 0.0,
    "airindiaexpress": 0.0, "ix": 0.0, "akasa": 0.0, "qp": 0.0,
    "spicejet": 0.0, "sg": 0.0,
}
DIRECT_SOURCES = [
    "indigo", "airindia", "airindiaexpress", "akasa", "spicejet",
    "6e", "ai", "ix", "qp", "sg",
]
AGENCY_SOURCES = [
    "makemytrip", "cleartrip", "easemytrip", "ixigo", "mmt", "ct", "ixi", "emt",
]
AGENCIES = ["makemytrip", "cleartrip", "ixigo", "easemytrip"]

# --- fixed values: fare limits ----------------------------------------------------
FARE_FLOOR = 999.0
FARE_CEILING = 25000.0
EXTRACT_FARE_MAX = 35000.0
SOLD_OUT_FARE = 16500.0

# --- fixed values: monthly base fare, forecast, pass-through ----------------------
BASE_MONTH_FARE = 4800.0
WEEKDAY_FACTORS = [1.02, 0.96, 0.97, 1.01, 1.06, 1.03, 1.07]  # Monday first
FUEL_ELASTICITY = 0.42
DEMAND_ELASTICITY = 0.55
AIRFARE_SHARE_OF_TRANSPORT = 0.032
TRANSPORT_SHARE_OF_HEADLINE = 0.0943
TRANSPORT_WEIGHT_PCT = 9.43

# --- fixed values: consumer price statistics --------------------------------------
CPI_AIRFARE_CODE = "07.3.3.1.2.01"
CPI_TRANSPORT_CODE = "07"
CPI_AIRFARE_DEFAULT = (135.49, 20.85)
CPI_TRANSPORT_DEFAULT = (105.90, 4.60)
CPI_DEFAULTS = {
    "base_year": "2024", "series": "Current", "year": "2026",
    "month": "August", "state": "All India", "sector": "Combined",
}

# --- fixed values: query tagging --------------------------------------------------
# city names in the order they are looked for; codes themselves follow
CITY_WORDS = [
    ("delhi", "DEL"), ("mumbai", "BOM"), ("bangalore", "BLR"), ("bengaluru", "BLR"),
    ("hyderabad", "HYD"), ("kolkata", "CCU"), ("pune", "PNQ"), ("ahmedabad", "AMD"),
    ("chennai", "MAA"), ("jaipur", "JAI"), ("goa", "GOI"), ("lucknow", "LKO"),
    ("srinagar", "SXR"), ("guwahati", "GAU"),
]
CARRIER_WORDS = [
    ("indigo", "6E"), ("6e", "6E"), ("air india", "AI"), ("ai", "AI"),
    ("air india express", "IX"), ("aix", "IX"), ("ix", "IX"), ("akasa", "QP"),
    ("qp", "QP"), ("spicejet", "SG"), ("sg", "SG"),
]
INTENT_WORDS = [
    ("simulation", ["what if", "simulate", "atf", "fuel shock", "oil price"]),
    ("lead_time_elasticity",
     ["elasticity", "lead time", "advance", "t+1", "t+45", "curve", "yield"]),
    ("anomalies", ["anomaly", "surge", "unusual", "spike", "cartel", "investigate"]),
    ("index_query", ["index", "cpi", "inflation", "trend", "today", "current"]),
    ("carrier_comparison",
     ["cheapest", "compare", "carrier", "airline", "indigo", "air india"]),
]

# --- fixed values: trunk sectors watched hourly -----------------------------------
TRUNK_SECTORS = [
    "DEL-BOM", "BOM-DEL", "DEL-BLR", "BLR-DEL", "BOM-BLR", "BLR-BOM",
    "DEL-HYD", "HYD-DEL", "DEL-CCU", "CCU-DEL",
]


def _both_ways() -> list[tuple]:
    cities = {code: city for code, city, *_ in AIRPORTS}
    raw_total = sum(pair[5] for pair in CITY_PAIRS)
    rows = []
    for number, (a, b, km, minutes, tier, raw, pax) in enumerate(CITY_PAIRS, start=1):
        for o, d in ((a, b), (b, a)):
            rows.append((f"{o}-{d}", o, d, cities[o], cities[d], number, km, minutes,
                         pax, tier, raw / 2, raw / raw_total / 2))
    return rows


# sector, origin, destination, origin_city, destination_city, pair_id, distance_km,
# approx_flight_minutes, annual_pax_millions, route_tier, raw weight (sums to .9),
# index weight (sums to 1)
SECTORS = _both_ways()
SECTOR_CODES = [row[0] for row in SECTORS]
CARRIER_CODES = [row[0] for row in CARRIERS]
CARRIER_SHARES = {**{row[0]: row[3] for row in CARRIERS}, OTHER_CARRIERS_SHARE[0]: OTHER_CARRIERS_SHARE[1]}
SECTOR_WEIGHTS = {row[0]: row[11] for row in SECTORS}
SECTOR_TIERS = {row[0]: row[9] for row in SECTORS}
SECTOR_SPECS = {row[0]: (row[6], row[7]) for row in SECTORS}
DEFAULT_SPEC = (1000, 120)
INCOMES = {row[0]: row[4] for row in AIRPORTS}
