"""Cleaning and parsing of single values, as SQL expressions that ``F.expr`` makes columns of."""

from __future__ import annotations

from claimweave.functions import vocabulary as V
from claimweave.functions.expressions import any_of, first, text

# Spellings of units and what they stand for; the first that a text contains decides.
UNIT_NAMES = [
    ("tonnes", "tonnes"), ("tonne", "tonnes"), ("tons", "tonnes"), ("ton", "tonnes"), ("metric tons", "tonnes"), ("metric ton", "tonnes"), ("mt", "tonnes"),
    ("kg", "kg"), ("kilograms", "kg"), ("kilogram", "kg"),
    ("tco2e", "tCO2e"), ("tonnes co2e", "tCO2e"), ("tonnes co2", "tCO2e"), ("tons co2e", "tCO2e"), ("mtco2e", "MtCO2e"),
    ("kwh", "kWh"), ("mwh", "MWh"), ("gwh", "GWh"), ("twh", "TWh"), ("megawatts", "MW"), ("mw", "MW"), ("gw", "GW"), ("gigajoules", "GJ"), ("gj", "GJ"), ("terajoules", "TJ"), ("tj", "TJ"),
    ("hectares", "hectares"), ("hectare", "hectares"), ("ha", "hectares"), ("acres", "acres"), ("acre", "acres"), ("sq km", "km²"), ("square kilometers", "km²"), ("km2", "km²"),
    ("litres", "litres"), ("liters", "litres"), ("litre", "litres"), ("liter", "litres"), ("cubic meters", "m³"), ("m3", "m³"),
    ("kilolitres", "kL"), ("kiloliters", "kL"), ("kl", "kL"), ("megalitres", "ML"), ("megaliters", "ML"), ("ml", "ML"),
    ("%", "%"), ("percent", "%"), ("per cent", "%"), ("percentage", "%"), ("trees", "trees"), ("saplings", "trees"), ("employees", "employees"), ("people", "people"),
]
# Numbers in words, in the order in which they are looked for.
NUMBER_WORDS = [
    *zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20), strict=True),
    *zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10), strict=True),
    ("hundred", 100), ("thousand", 1000), ("million", 1000000), ("billion", 1000000000),
]
# Hints at a unit in a table's labels.
UNIT_HINTS = [
    ("%", "%"), ("percent", "%"), ("gj", "GJ"), ("tj", "TJ"), ("kwh", "kWh"), ("mwh", "MWh"), ("gwh", "GWh"), ("kcal/kwh", "kcal/kWh"), ("kilolitre", "kilolitres"), ("kl", "kilolitres"), ("m3", "m3"),
    ("tco2", "tCO2e"), ("co2", "tCO2e"), ("tonne", "tonnes"), ("mt", "tonnes"), ("kg", "kg"), ("inr", "INR"), ("crore", "INR crore"),
]
# Names that are no places, and places too large for a point sample.
NOT_PLACES = (
    r"^(global|globally|worldwide|various|multiple|company|the entire planet|earth|planet|n/?a|shell|tata|infosys|microsoft|group|all (our )?(sites|facilities|locations))\b"
    r"|^(world heritage|marine environment|critical habitats?|offshore|onshore|communities|protected areas?|high.risk (areas|countries))\b|(facilities|operations)$"
)
TOO_COARSE = ["india", "china", "usa", "united states", "uk", "united kingdom", "netherlands", "australia", "brazil", "nigeria", "germany", "canada", "andhra pradesh", "tamil nadu", "gujarat", "kerala", "amazon", "amazon rainforest", "europe", "asia", "africa"]
# Kinds of features that are ground to look at.
GEO_CLASSES = ["place", "natural", "water", "waterway", "boundary", "landuse", "geological", "landcover"]
GOOD_LEISURE = ["park", "nature_reserve", "garden", "recreation_ground", "common"]
# Cities by country, country names, and words for a facility.
CITIES = {
    "India": "mumbai delhi pune bangalore bengaluru hyderabad chennai kolkata ahmedabad jamshedpur surat noida gurugram gurgaon bhubaneswar vadodara nagpur lucknow chandigarh raipur visakhapatnam vizag kochi coimbatore".split(),
    "Singapore": ["singapore"], "United Kingdom": ["london", "manchester", "edinburgh"], "Germany": ["berlin", "frankfurt", "munich", "hamburg"], "France": ["paris", "lyon"],
    "USA": ["new york", "houston", "chicago", "san francisco", "los angeles", "seattle", "boston", "dallas"], "Australia": ["sydney", "melbourne", "perth"], "Japan": ["tokyo", "osaka", "yokohama"],
    "China": ["beijing", "shanghai", "shenzhen", "guangzhou"], "UAE": ["dubai", "abu dhabi", "sharjah"], "South Africa": ["johannesburg", "cape town", "durban"], "Brazil": ["são paulo", "rio de janeiro", "brasilia"],
    "Canada": ["toronto", "vancouver", "montreal"], "Netherlands": ["amsterdam", "rotterdam"], "Sweden": ["stockholm"], "Norway": ["oslo"], "Denmark": ["copenhagen"], "Switzerland": ["zurich", "geneva"],
    "South Korea": ["seoul", "busan"], "Indonesia": ["jakarta"], "Malaysia": ["kuala lumpur"], "Thailand": ["bangkok"],
}
COUNTRIES = ["india", "china", "usa", "united states", "uk", "united kingdom", "germany", "france", "japan", "australia", "brazil", "singapore", "uae", "south africa", "canada", "mexico", "indonesia", "bangladesh"]
FACILITY = r"(plant|factory|facility|site|campus|mine|refinery|mill|warehouse|depot)"


def clean_text(value: str) -> str:
    """The trimmed text, null for a placeholder."""
    return f"CASE WHEN lower(trim({value})) NOT IN ('', 'null', 'none', 'nan', 'n/a') THEN trim({value}) END"


def clean_date(value: str) -> str:
    """An ISO date from year-month-day with dashes or slashes, or from a year; else null."""
    v = f"trim({value})"
    parts = rf"regexp_extract_all({v}, '(\\d+)', 1)"
    day = f"try_to_date(concat(lpad({parts}[0], 4, '0'), '-', lpad({parts}[1], 2, '0'), '-', lpad({parts}[2], 2, '0')), 'yyyy-MM-dd')"
    return rf"CASE WHEN {v} RLIKE '^\\d{{4}}$' THEN concat({v}, '-01-01') WHEN {v} RLIKE '^\\d{{4}}(-\\d{{1,2}}-|/\\d{{1,2}}/)\\d{{1,2}}$' THEN date_format({day}, 'yyyy-MM-dd') END"


def slug(value: str) -> str:
    return f"coalesce(nullif(trim(BOTH '_' FROM regexp_replace(lower({value}), '[^a-z0-9]+', '_')), ''), 'company')"


def parse_number(cell: str) -> str:
    """The number of a table cell with its decoration; null for dashes, bare years and anything else."""
    s = f"trim(coalesce({cell}, ''))"
    raw = rf"replace(regexp_extract({s}, r'^[^\d\-+]*([-+]?\d[\d,]*\.?\d*)\s*[%a-zA-Z°/³²]*\s*[*†‡]?$', 1), ',', '')"
    return f"CASE WHEN {s} IN ('', '-', '--', 'n/a', 'N/A', 'NA') OR {raw} = '' OR {raw} RLIKE '^(19|20)[0-9]{{2}}$' THEN NULL ELSE try_cast({raw} AS DOUBLE) END"


def cell_number(cell: str) -> str:
    """The number that a plain cell is, commas aside."""
    plain = f"replace(trim({cell}), ',', '')"
    return f"CASE WHEN {plain} NOT IN ('', '-', '–') THEN try_cast({plain} AS DOUBLE) END"


def unit_named(value: str) -> str:
    """The unit of the first spelling that a lower-cased text contains; null for none."""
    return first([(f"contains({value}, {text(k)})", text(u)) for k, u in UNIT_NAMES], "NULL")


def number_named(value: str) -> str:
    """The first number of a lower-cased text, in digits, else in words."""
    digits = rf"replace(regexp_extract({value}, r'[\d,]+\.?\d*', 0), ',', '')"
    words = first([(f"contains({value}, {text(w)})", f"{n}e0") for w, n in NUMBER_WORDS], "NULL")
    return f"coalesce(try_cast(nullif({digits}, '') AS DOUBLE), {words})"


def unit_hint(value: str) -> str:
    return first([(f"contains(lower({value}), {text(k)})", text(u)) for k, u in UNIT_HINTS], "'unspecified'")


def inferred_unit(unit: str, aspect: str, value: str) -> str:
    """The unit of a metric, spelled as by UNIT_NAMES; an unset one follows from the aspect where it can."""
    a, u = f"lower(coalesce({aspect}, ''))", f"lower(trim(coalesce({unit}, '')))"
    guess = first([(any_of(a, ["employ", "work", "diversity"]), f"CASE WHEN {value} > 100 THEN 'employees' ELSE 'unspecified' END"), (any_of(a, ["emissions", "ghg"]), "'tCO2e'"), (f"contains({a}, 'water')", "'kL'")], "'unspecified'")
    exact = first([(f"lower({unit}) = {text(k)}", text(n)) for k, n in UNIT_NAMES], unit)
    return f"CASE WHEN {u} IN ('', 'none') OR {unit} = 'unspecified' THEN {guess} ELSE {exact} END"


def unit_base(unit: str) -> str:
    """The family that a unit is scored by."""
    u = f"regexp_replace(lower(trim({unit})), r'\\s*/\\s*', '/')"
    hour = " AND ".join(f"NOT contains({u}, '{h}')" for h in ("kwh", "mwh", "gwh"))
    cases = [
        (f"{unit} IS NULL OR {u} IN ('', 'unspecified', 'none', 'na', 'n/a')", "NULL"), (any_of(u, ["%", "percent"]), "'percent'"), (any_of(u, ["co2", "coe"]), "'co2e_mass'"),
        (any_of(u, ["/inr", "/turnover", "per rupee", "/mwh", "/kwh", "kcal/kwh", "intensity", "/mj"]), "'rate'"), (f"{any_of(u, ['mw', 'gw', 'kw'])} AND {hour}", "'power_capacity'"),
        (any_of(u, ["litre", "liter", "gallon", "m3", "cubic", "kilo litre", "kl"]), "'volume'"), (any_of(u, ["kwh", "mwh", "gwh", "joule", "gj", "tj", "pj", "kcal"]), "'energy'"), (any_of(u, ["ton", "mt", "kg"]), "'mass'"),
        (any_of(u, ["gbp", "usd", "inr", "eur", "rs", "rupee", "$", "cr"]), "'currency'"), (any_of(u, ["employee", "worker", "count", "number", "no.", "connection", "case", "complaint", "incident"]), "'count'"),
    ]
    return first(cases, "'other'")


def check_key(report: str, aspect: str, place: str, time: str) -> str:
    """Sixteen digits that name what a satellite check is about, whatever the claim's id."""
    return f"left(sha2(concat_ws('|', {', '.join(f"coalesce({c}, '')" for c in (report, aspect, place, time))}), 256), 16)"


def short_sha1(value: str) -> str:
    return f"left(sha1({value}), 12)"


def geocodable(place: str) -> str:
    """Whether a place name is specific enough to be looked up."""
    t = f"trim({place})"
    return f"coalesce(length({t}) > 3 AND NOT regexp_like(lower({t}), r'{NOT_PLACES}') AND lower({t}) NOT IN ({', '.join(map(text, TOO_COARSE))}), false)"


def place_named(sentence: str) -> str:
    """The country or city that a sentence names as a word, the first of the lists that it has; null for none."""
    s = f"lower({sentence})"
    names = [*COUNTRIES, *(c for cities in CITIES.values() for c in cities)]
    return first([(f"regexp_like({s}, r'(^|[^a-z])({n})($|[^a-z])')", text(n)) for n in names], "NULL")


def place_kind(place: str, sentence: str) -> str:
    """How specific a named place is; a sentence without one may still speak of a facility."""
    cities = ", ".join(text(c) for cs in CITIES.values() for c in cs)
    return f"CASE WHEN {place} IN ({', '.join(map(text, COUNTRIES))}) THEN 'country' WHEN {place} IN ({cities}) THEN 'city' WHEN regexp_like(lower({sentence}), r'{FACILITY}') THEN 'facility' END"


def place_country(place: str) -> str:
    return first([(f"{place} IN ({', '.join(map(text, COUNTRIES))})", f"initcap({place})")] + [(f"{place} IN ({', '.join(map(text, cs))})", text(c)) for c, cs in CITIES.items()], "NULL")


def direction_named(sentence: str) -> str:
    return first([(f"contains(lower({sentence}), {text(k)})", text(d)) for k, d in V.DIRECTIONS], "NULL")


def ladder(place: str) -> str:
    """Ever simpler spellings of a place name, longer than three letters, each once."""
    t = rf"regexp_replace(trim({place}), '\\s+', ' ')"
    what = r"(?i)\\b(riverbed|revitali[sz]ation|datacenter|data center|buffer zones?|neighboring|surrounding|near|around|project|programme|program|campus|facility|plant|site)\\b"
    bare = rf"trim(BOTH ' ,-' FROM regexp_replace(regexp_replace(t, '{what}', ''), '\\s{{2,}}', ' '))"
    owned = r"'^([A-Z][\\w ]+?)\'s (.+)$'"
    tries = [
        "t",
        f"CASE WHEN t RLIKE {owned} THEN concat(regexp_extract(t, {owned}, 2), ', ', regexp_extract(t, {owned}, 1)) END",
        f"CASE WHEN t RLIKE {owned} THEN concat(trim(regexp_replace(regexp_extract(t, {owned}, 2), '{what}', '')), ', ', regexp_extract(t, {owned}, 1)) END",
        "CASE WHEN contains(t, ' at ') THEN substr(t, locate(' at ', t) + 4) END",
        f"CASE WHEN {bare} <> '' AND lower({bare}) <> lower(t) THEN {bare} END",
        "CASE WHEN contains(t, ',') THEN trim(substring_index(t, ',', -1)) END",
    ]
    every = f"transform(array({t}), t -> filter(array({', '.join(tries)}), c -> length(c) > 3))[0]"
    return f"transform(array({every}), c -> filter(c, (x, i) -> array_position(transform(c, y -> lower(y)), lower(x)) = i + 1))[0]"
