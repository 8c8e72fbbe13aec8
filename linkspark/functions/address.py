"""US postal addresses: combine, parse, keys, completeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of states and territories by their usual short forms.
STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming",
    "dc": "district of columbia", "as": "american samoa", "gu": "guam", "mp": "northern mariana islands", "pr": "puerto rico", "vi": "us virgin islands", "d.c.": "district of columbia", "d c": "district of columbia", "calif": "california", "cal": "california", "penn": "pennsylvania", "penna": "pennsylvania", "mass": "massachusetts", "conn": "connecticut", "okla": "oklahoma",
}
PARTS = ["street_number", "street_name", "city", "state", "zip"]
#: number and street, city, state, zip; the commas may be missing between state and zip.
GRAMMAR = r"^\s*(\d+)\s+([^,]+?)\s*,\s*([^,]+?)\s*,\s*([a-z.]+(?: [a-z.]+)*)[\s,]+(\d{5})(?:-\d{4})?\s*$"
PO_BOX = r"(?:^|[^a-z])p\.?\s*o\.?\s*box\s+(\d+)"


def combine(*columns: Column) -> Column:
    """One lower-case line of several columns, empty ones left out, separators turned into spaces."""
    filled = [F.when(F.trim(c) != "", F.trim(c)) for c in columns]
    line = F.concat_ws(" ", *filled)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[,|;/]+", " "), r"\s+", " "))


def state_name(column: Column) -> Column:
    """Full lower-case name of a state; unknown values stay, nulls too."""
    low = F.lower(F.trim(column))
    table = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return F.coalesce(F.element_at(table, low), low)


def parse(column: Column) -> dict[str, Column]:
    """The five parts; '' where the grammar finds none."""
    low = F.lower(F.coalesce(column, F.lit("")))
    number, street, city, state, zip_ = (F.regexp_extract(low, GRAMMAR, k) for k in range(1, 6))
    box = F.regexp_extract(low, PO_BOX, 1)
    street = F.when((street == "") & (box != ""), F.concat(F.lit("po box "), box)).otherwise(street)
    return {"street_number": number, "street_name": street, "city": city, "state": F.coalesce(state_name(state), F.lit("")), "zip": zip_}


def key(parts: dict[str, Column]) -> Column:
    """Five parts joined by a bar; '' if all are empty."""
    number = F.regexp_replace(parts["street_number"], r"[^0-9].*", "")
    street = F.regexp_replace(F.lower(parts["street_name"]), r"\s+(n|s|e|w|north|south|east|west)$", "")
    whole = F.concat_ws("|", number, street, F.lower(parts["city"]), F.lower(parts["state"]), F.substring(parts["zip"], 1, 5))
    whole = F.trim(F.regexp_replace(whole, r"\s+", " "))
    return F.when(whole.rlike(r"^[| ]*$"), "").otherwise(whole)


def completeness(parts: dict[str, Column]) -> Column:
    """Street 2, number, city, state and zip (five digits) 1 each."""
    present = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", 1).otherwise(0)
    zip_ = F.when(F.coalesce(parts["zip"], F.lit("")).rlike(r"^\d{5}$"), 1).otherwise(0)
    return 2 * present(parts["street_name"]) + present(parts["street_number"]) + present(parts["city"]) + present(parts["state"]) + zip_
