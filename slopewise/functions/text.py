"""Column expressions over names, addresses and search text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slopewise.sources.street_network import choose

# How street words are written, and how they are shortened for search.
SUFFIXES = {
    "ST": "St", "AVE": "Ave", "BLVD": "Blvd", "DR": "Dr", "RD": "Rd", "CT": "Ct", "PL": "Pl", "LN": "Ln", "TER": "Ter", "WAY": "Way", "HWY": "Hwy", "PKWY": "Pkwy",
    "CIR": "Cir", "ALY": "Aly", "SQ": "Sq", "TERR": "Ter", "STWY": "Stwy", "HL": "Hl", "WALK": "Walk", "LOOP": "Loop", "ROW": "Row", "PATH": "Path", "EXPY": "Expy", "PLZ": "Plz",
}
DIRECTIONS = ("N", "S", "E", "W")
SHORT = {
    "street": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "road": "rd", "court": "ct", "place": "pl", "lane": "ln", "terrace": "ter", "highway": "hwy", "parkway": "pkwy",
    "circle": "cir", "alley": "aly", "square": "sq", "stairway": "stwy", "stairs": "stwy", "way": "wy", "north": "n", "south": "s", "east": "e", "west": "w", "saint": "st", "mount": "mt",
}
# Categories shown, by group; a category in two groups belongs to the later one.
GROUPS = {
    "park": (
        "park", "garden", "playground", "beach", "dog_park", "hiking_trail", "scenic_point", "nature_preserve", "botanical_garden", "national_park", "state_park", "plaza", "picnic_ground",
    ),
    "landmark": (
        "landmark_and_historical_building", "monument", "tourist_attraction", "museum", "art_museum", "history_museum", "science_museum", "aquarium", "zoo", "stadium_arena", "observatory", "lighthouse",
        "historical_site", "memorial", "pier", "marina", "amusement_park", "theatre", "performing_arts_theatre", "concert_hall", "cinema", "library", "public_library",
    ),
    "transit": (
        "train_station", "light_rail_station", "subway_station", "bus_station", "ferry_terminal", "transit_station", "cable_car_station", "metro_station", "public_transportation",
    ),
    "school": ("school", "university", "college_university", "high_school", "elementary_school", "middle_school", "community_college", "campus"),
    "civic": (
        "city_hall", "courthouse", "post_office", "hospital", "fire_station", "police_station", "community_center", "recreation_center", "swimming_pool", "public_swimming_pool", "church_cathedral",
        "synagogue", "mosque", "temple", "farmers_market", "public_market",
    ),
    "food": (
        "restaurant", "cafe", "coffee_shop", "bakery", "bar", "pub", "brewery", "ice_cream_shop", "pizza_restaurant", "taco_restaurant", "diner", "dessert_shop", "tea_room", "wine_bar", "cocktail_bar", "food_court",
    ),
    "shop": (
        "grocery_store", "supermarket", "bookstore", "shopping_center", "hardware_store", "bicycle_shop", "pharmacy", "farmers_market", "convenience_store", "department_store", "record_store", "florist",
    ),
    "lodging": ("hotel", "hostel", "bed_and_breakfast"),
}
# Kinds of mapped features by type and class.
KINDS = {
    "land_use": {
        "park": "park", "dog_park": "dog park", "playground": "playground", "garden": "garden", "allotments": "community garden", "plaza": "plaza", "pedestrian": "plaza", "school": "school", "kindergarten": "school",
        "university": "university", "college": "college", "hospital": "hospital", "golf_course": "golf course", "stadium": "stadium", "marina": "marina", "recreation_ground": "park", "national_park": "park",
        "military": "landmark", "protected_landscape_seascape": "park",
    },
    "infrastructure": {
        "railway_station": "station", "subway_station": "station", "ferry_terminal": "ferry", "pier": "pier", "bridge": "bridge", "viewpoint": "viewpoint", "observation": "landmark", "communication_tower": "landmark",
    },
    "land": {"peak": "peak", "hill": "hill", "beach": "beach", "island": "island", "islet": "island"},
}
# Fixed value: words that make any other category a landmark.
LANDMARK_WORDS = "park|garden|museum|station|landmark|monument|library|theat|school|universit|college|church|cathedral|hospital|beach|plaza|square|pier|market|stadium|trail|overlook"


def title_street(raw: Column) -> Column:
    """'OLD MILL AVE' becomes 'Old Mill Ave', '3RD' becomes '3rd'; a direction keeps its capital unless it comes first."""

    def word(t: Column, i: Column) -> Column:
        plain = F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2))))
        return F.coalesce(choose(t, SUFFIXES), F.when(t.rlike(r"^\d+(ST|ND|RD|TH)$"), F.lower(t)).when(t.isin(*DIRECTIONS) & (i > 0), t).when(t.rlike(r"^\d+$"), t).otherwise(plain))

    words = F.filter(F.split(raw, r"\s+"), lambda t: t != "")
    return F.array_join(F.transform(words, word), " ")


def core(name: Column, city: str, regions: tuple[str, ...] = ("wa", "washington", "usa")) -> Column:
    """The name in lower case without what follows it only to name the city or region."""
    regions_re = "|".join(regions)
    return F.lower(F.trim(F.regexp_replace(name, rf"(?i)(?:[\s,\-/]+{city}(?:[\s,]+(?:{regions_re}))?|[,\-/]\s*(?:{regions_re}))\s*$", "")))


def group_of(category: Column) -> Column:
    known = choose(category, {c: g for g, members in GROUPS.items() for c in members})
    return F.coalesce(known, F.when(category.rlike(f"(?i){LANDMARK_WORDS}"), "landmark"))


def kind_of(type_: Column, class_: Column) -> Column:
    """The kind under which a mapped feature is listed, null for those that are not."""
    out = F.lit(None).cast("string")
    for name, kinds in KINDS.items():
        out = F.when(type_ == name, choose(class_, kinds)).otherwise(out)
    return out


def feet(metres: Column) -> Column:
    return metres * 3.28084


def miles(metres: Column) -> Column:
    return metres / 1609.344


def human_bytes(n: Column) -> Column:
    """A number of bytes with one decimal in the largest unit that leaves at least one, up to TB."""
    out = F.concat(F.format_number(n / 1024.0**4, 1), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024.0 ** (power + 1), F.concat(F.format_number(n / 1024.0**power, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def lead_streets(names: Column) -> Column:
    """The first street of each corridor's name, once each."""
    return F.array_distinct(F.transform(names, lambda n: F.split(n, " - ")[0]))


def leading_number(text: Column, below: int = 65536) -> Column:
    """The number a text begins with, if there is one and it is small enough."""
    digits = F.regexp_extract(text, r"^(\d+)", 1)
    number = F.when((digits != "") & (F.length(F.ltrim(digits, F.lit("0"))) <= 9), digits.cast("long"))
    return F.when(number < below, number)


def normalised(text: Column) -> Column:
    """Lower-case words without punctuation, street words shortened."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), "[’']", ""), r"[^\p{L}\p{N}\s]", " ")
    words = F.filter(F.split(F.trim(F.regexp_replace(flat, r"\s+", " ")), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(choose(w, SHORT), w)), " ")


def match_score(name: Column, wanted: Column) -> Column:
    """0 equal, 1 begins so, 2 every word begins a word, 3 stands within (from three letters on), else -1; both normalised."""
    words = F.split(wanted, " ")
    all_begin = F.forall(words, lambda t: F.contains(F.concat(F.lit(" "), name), F.concat(F.lit(" "), t)))
    return F.when(name == wanted, 0).when(F.startswith(name, wanted), 1).when(all_begin, 2).when((F.length(wanted) >= 3) & F.contains(name, wanted), 3).otherwise(-1)


def short_street(name: Column) -> Column:
    """The name with its street words shortened, capitals kept elsewhere."""
    return F.array_join(F.transform(F.split(name, " "), lambda w: F.coalesce(F.initcap(choose(F.lower(w), SHORT)), w)), " ")


def share_token(kind: str, fields: list[str]) -> str:
    """A link's text: the kind, `t` for a trip or `l` for a loop, then the fields; what is not a letter or digit becomes hex."""
    if kind not in ("t", "l"):
        raise ValueError(f"unknown kind {kind!r}")
    plain = lambda s: "".join(c if c.isascii() and c.isalnum() else "".join(f"_{b:02x}" for b in c.encode()) for c in s)
    return "~".join([kind, *map(plain, fields)])


def read_token(token: str) -> tuple[str, list[str]]:
    """The kind and fields of a link's text; ValueError if it is none."""
    kind, *fields = token.split("~")
    if kind not in ("t", "l"):
        raise ValueError(f"unknown kind {kind!r}")

    def field(s: str) -> str:
        out, at = bytearray(), 0
        while at < len(s):
            if s[at] == "_":
                out.append(int(s[at + 1 : at + 3], 16))
                at += 3
            else:
                out += s[at].encode()
                at += 1
        return out.decode()

    return kind, [field(s) for s in fields]
