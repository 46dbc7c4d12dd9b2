"""The controlled vocabularies that results depend on, in order of precedence."""

from __future__ import annotations

# Taxonomy nodes and the phrases that name them; the order decides ties.
TAXONOMY: dict[str, list[str]] = {
    "emissions.scope1": ["scope 1", "direct emissions", "direct ghg", "fleet emissions", "stationary combustion"],
    "emissions.scope2": ["scope 2", "indirect emissions", "purchased electricity", "purchased energy"],
    "emissions.scope3": ["scope 3", "value chain emissions", "supply chain emissions", "indirect ghg"],
    "emissions.total": ["total emissions", "ghg emissions", "carbon footprint", "co2e"],
    "emissions.air_pollutants": ["air pollutant", "air pollutants", "air quality"],
    "emissions.air_pollutants.pm": ["particulate matter", "pm10", "pm2.5", "pm 10", "pm 2.5"],
    "emissions.air_pollutants.sox": ["sox", "so2", "sulphur oxides", "sulfur oxides", "oxides of sulphur", "oxides of sulfur"],
    "emissions.air_pollutants.nox": ["nox", "nitrogen oxides", "oxides of nitrogen"],
    "emissions.air_pollutants.voc": ["voc", "vocs", "volatile organic compounds"],
    "emissions.offsets": ["carbon credits", "carbon offsets", "carbon offset", "emissions offset", "carbon-compensated", "carbon compensated"],
    "emissions.ccs": ["carbon capture", "ccs", "ccus", "carbon capture and storage"],
    "emissions.intensity": ["carbon intensity", "net carbon intensity", "emission intensity", "emissions intensity"],
    "emissions.methane": ["methane", "methane emissions", "ogmp"],
    "energy.supply": ["lng", "liquefied natural gas", "gas supply", "energy security"],
    "energy.ev_charging": ["charge points", "charging points", "ev charging", "electric vehicle charging", "charging stations"],
    "energy.investment": ["low-carbon investment", "investment in low-carbon", "low-carbon energy solutions"],
    "energy.renewable": ["renewable energy", "solar", "wind power", "clean energy", "green power"],
    "energy.total": ["energy consumption", "total energy", "power usage", "fuel consumption", "energy consumed", "electricity consumption"],
    "energy.efficiency": ["energy efficiency", "heat rate", "net heat rate", "specific energy consumption"],
    "water.consumption": ["water consumption", "water usage", "freshwater used", "water use", "water withdrawal"],
    "water.recycled": ["recycled water", "water reused", "wastewater treated"],
    "water.discharge": ["water discharge", "water discharged", "effluent discharge", "effluent"],
    "waste.total": ["total waste", "solid waste", "hazardous waste", "waste generated", "plastic waste", "e-waste", "waste management"],
    "waste.recycled": ["recycled waste", "waste diverted", "circular economy", "waste recycling", "re-used waste", "reused waste", "waste re-used", "waste recovered", "other recovery"],
    "waste.landfilled": ["landfill", "landfilled waste", "landfilling", "waste to landfill"],
    "waste.incinerated": ["incineration", "incinerated waste", "waste incinerated"],
    "biodiversity.conservation": ["biodiversity", "reforestation", "habitat protection", "tree planting"],
    "social.diversity.gender": ["gender diversity", "women in management", "female employees", "female representation", "diversity", "workforce diversity", "diversity in workforce", "employee diversity"],
    "social.diversity.gender.female": [],
    "social.diversity.gender.male": [],
    "social.health_safety.ltifr": ["ltifr", "lost time injury", "safety incident rate", "work-related injuries"],
    "social.health_safety.fatalities": ["fatalities", "workplace deaths"],
    "social.workforce.total": ["total employees", "workforce size", "employment"],
    "social.workforce.permanent": [],
    "social.workforce.contractual": [],
    "social.training.hours": ["training hours", "learning and development", "employee training"],
    "social.human_rights": ["human rights", "human rights due diligence"],
    "social.community": ["csr", "corporate social responsibility", "community development", "community investment", "beneficiaries"],
    "social.labor_relations": ["union membership", "collective bargaining", "freedom of association", "labor relations", "industrial relations"],
    "social.posh_complaints": ["posh", "sexual harassment"],
    "social.supply_chain.training": ["value chain partners", "value chain awareness"],
    "social.accessibility": ["accessibility", "differently abled", "assistive technologies"],
    "social.supply_chain": ["suppliers", "supplier", "supply chain"],
    "social.health_safety": ["health and safety", "process safety", "safety assessment", "exposure hours", "occupational safety"],
    "social.health_safety.sif": ["serious injuries and fatalities", "sif rate"],
    "governance.board.diversity": ["board diversity", "independent directors", "women on board"],
    "governance.ethics.incidents": ["ethics incidents", "whistleblower", "corruption cases", "anti-bribery"],
    "governance.stakeholder_engagement": ["stakeholder engagement", "materiality survey", "materiality assessment", "stakeholder consultation"],
    "governance.payments_to_governments": ["payments to governments", "production entitlements"],
    "governance.compliance": ["administrative penalty", "regulatory penalty", "penalties paid"],
    "governance.lobbying": ["lobbying", "transparency register"],
}

# Physical dimension of a unit: the first with a phrase contained in it.
DIMENSIONS: list[tuple[str, list[str]]] = [
    ("percent", ["%", "percent", "per cent"]),
    ("rate", ["per million hours", "per 100 million", "per hundred thousand", "per 100,000", "per one million", "/100 million", "million hours", "ltifr", "frequency rate", " rate", "/hour"]),
    ("intensity", ["intensity", "/mj", "/gj", "/tj", "/kwh", "/mwh", "/gwh", "/boe", "/inr", "/usd", "/tonne", "/m2", "/m²", "uedctm", "per inr", "per boe", "per kwh", "per mwh", "per tonne", "per unit"]),
    ("co2e", ["co2e", "co2", "tco2", "mtco2", "ktco2", "ghg"]),
    ("energy", ["kwh", "mwh", "gwh", "twh", "kva", "gj", "tj", "joule"]),
    ("power", ["mwac", "wac", "mwp", "kwp", "gwp", "mw", "gw", "kw", "megawatt", "gigawatt", "watt"]),
    ("volume", ["litre", "liter", "cubic met", "m3", "m³", "kilolitre", "megalitre", "gallon", "barrel", "bbl"]),
    ("area", ["hectare", "acre", "km2", "km²", "sq km", "square", "m2", "m²"]),
    ("currency", ["usd", "inr", "eur", "gbp", "$", "dollar", "rupee", "euro", "spend", "cost"]),
    ("mass", ["tonne", "ton", "kilogram", "gram", "kg", "kt", "mt"]),
    ("length", ["km", "kilomet", "mile", "metre", "meter"]),
    ("fatalities", ["fatalit"]),
    ("injuries", ["injur"]),
    ("headcount", ["employee", "people", "person", "headcount", "fte", "staff", "workforce", "worker", "director"]),
    ("incidents", ["incident", "event", "case", "breach", "spill", "assessment"]),
    ("count", ["count", "number", "tree", "sapling", "credit", "report", "hour"]),
]

# Dimensions that make sense for a family of metrics, the first family that fits.
PLAUSIBLE: list[tuple[str, list[str]]] = [
    ("emissions", ["co2e", "mass", "intensity", "percent"]),
    ("energy", ["energy", "power", "intensity", "percent", "count"]),
    ("water", ["volume", "mass", "intensity", "percent"]),
    ("waste", ["mass", "volume", "percent"]),
    ("biodiversity", ["area", "count", "headcount", "incidents", "percent"]),
    ("social.diversity", ["percent", "count", "headcount"]),
    ("social.health_safety", ["rate", "count", "fatalities", "injuries", "incidents", "headcount", "percent"]),
    ("social.workforce", ["count", "headcount", "percent"]),
    ("social.training", ["count", "headcount", "rate"]),
    ("social.community", ["currency", "count", "headcount", "percent"]),
    ("social.posh_complaints", ["count", "incidents", "percent"]),
    ("social.labor_relations", ["percent", "count", "headcount"]),
    ("governance", ["count", "incidents", "percent"]),
]

# Canonical unit, factor, and the spellings that have it.
CONVERSIONS: list[tuple[str, float, list[str]]] = [
    ("tCO2e", 1.0, ["tco2e"]), ("tCO2e", 1e3, ["ktco2e"]), ("tCO2e", 1e6, ["mtco2e"]), ("tCO2e", 1e-6, ["gco2e"]), ("tCO2e", 1e-3, ["kgco2e"]),
    ("tonnes", 1.0, ["tonnes", "tonne", "ton", "mt"]), ("tonnes", 1e-3, ["kg", "kilograms", "kilogram"]), ("tonnes", 1e-6, ["g", "gram", "grams"]), ("tonnes", 1e3, ["kt"]),
    ("MWh", 1e-3, ["kwh"]), ("MWh", 1.0, ["mwh"]), ("MWh", 1e3, ["gwh"]), ("MWh", 1e6, ["twh"]),
    ("MWh", 2.777778e-4, ["mj", "megajoule", "megajoules"]), ("MWh", 0.2777778, ["gj", "gigajoule", "gigajoules"]), ("MWh", 277.7778, ["tj", "terajoule", "terajoules"]),
    ("MWh", 277777.8, ["pj", "petajoule", "petajoules"]), ("MWh", 2.777778e-10, ["joule", "joules"]),
    ("m3", 1e-3, ["litres", "litre", "liters", "liter", "l"]), ("m3", 1.0, ["m3", "m³", "kl", "cubic metre", "cubic metres", "cubic meter", "cubic meters", "kilolitres", "kilolitre"]),
    ("m3", 1e3, ["ml", "megalitres", "megalitre"]), ("m3", 3.78541e-3, ["gallon", "gallons"]), ("m3", 0.158987, ["barrel", "barrels", "bbl"]),
    ("hectares", 1.0, ["hectares", "hectare", "ha"]), ("hectares", 0.404686, ["acres", "acre"]), ("hectares", 100.0, ["km2", "km²", "sqkm"]),
    ("hectares", 1e-4, ["m2", "m²", "square metre", "square metres", "square meter", "square meters"]), ("%", 1.0, ["%", "percent"]),
]

# Words that multiply a unit, and endings that say how often it is reported; the first found counts.
MAGNITUDES = [("trillion", 1e12), ("billion", 1e9), ("bn", 1e9), ("crore", 1e7), ("million", 1e6), ("lakh", 1e5), ("thousand", 1e3)]
CADENCES = [" per year", " per annum", " per yr", " per a", " annually", "/year", "/yr", "/a", " p.a.", " pa"]

# Verbs of promise and of delivery, and what tells a direction, in order.
TARGET_VERBS = ["aim", "plan", "intend", "commit", "target", "aspire", "will", "goal"]
PERFORMANCE_VERBS = ["reduced", "increased", "achieved", "delivered", "improved", "generated", "maintained"]
DIRECTIONS = [
    ("reduced", "decrease"), ("reduction", "decrease"), ("decreased", "decrease"), ("decline", "decrease"), ("declined", "decrease"), ("lower", "decrease"), ("cut", "decrease"),
    ("saved", "decrease"), ("avoided", "decrease"), ("increased", "increase"), ("increase", "increase"), ("grew", "increase"), ("growth", "increase"), ("higher", "increase"),
    ("expanded", "increase"), ("achieved", "absolute"), ("reached", "absolute"), ("maintained", "absolute"), ("generated", "absolute"), ("produced", "absolute"), ("consumed", "absolute"),
]

# Aspects that imagery can show.
OBSERVABLE = ["reforestation", "deforestation", "land use", "vegetation", "forest", "plantation", "solar", "wind farm", "water surface", "green cover", "facility", "mining", "construction", "flooding", "wetland", "biodiversity", "habitat", "mangrove", "coral"]

# Disclosure clauses of a node, and clause codes printed in a text.
FRAMEWORKS: dict[str, list[str]] = {
    "emissions.scope1": ["GRI 305-1", "ESRS E1-6", "TCFD Metrics & Targets"],
    "emissions.scope2": ["GRI 305-2", "ESRS E1-6", "TCFD Metrics & Targets"],
    "emissions.scope3": ["GRI 305-3", "ESRS E1-6", "TCFD Metrics & Targets"],
    "emissions.total": ["GRI 305", "ESRS E1-6", "TCFD Metrics & Targets"],
    "energy.total": ["GRI 302-1", "ESRS E1-5"],
    "energy.renewable": ["GRI 302-1", "ESRS E1-5"],
    "water.consumption": ["GRI 303-5", "ESRS E3-4"],
    "water.recycled": ["GRI 303-3", "ESRS E3-4"],
    "waste.total": ["GRI 306-3", "ESRS E5-5"],
    "waste.recycled": ["GRI 306-4", "ESRS E5-5"],
    "biodiversity.conservation": ["GRI 304-3", "ESRS E4"],
    "social.diversity.gender": ["GRI 405-1", "ESRS S1-9"],
    "social.health_safety.ltifr": ["GRI 403-9", "ESRS S1-14"],
    "social.health_safety.fatalities": ["GRI 403-9", "ESRS S1-14"],
    "social.workforce.total": ["GRI 2-7", "ESRS S1-6"],
    "social.training.hours": ["GRI 404-1", "ESRS S1-13"],
    "governance.board.diversity": ["GRI 405-1", "ESRS G1", "TCFD Governance"],
    "governance.ethics.incidents": ["GRI 205-3", "ESRS G1-4"],
}
CLAUSE_CODE = r"\b(2-\d{1,2}|20[1-8]-\d{1,2}|30[1-8]-\d{1,2}|4[0-1]\d-\d{1,2})\b"

# Metrics for which less, or more, is better; materiality of families; evidence tiers.
LOWER_BETTER = ["emissions", "waste.total", "water.consumption", "social.health_safety.ltifr", "social.health_safety.fatalities", "governance.ethics.incidents"]
HIGHER_BETTER = ["energy.renewable", "water.recycled", "waste.recycled", "biodiversity", "social.diversity", "social.training", "governance.board.diversity"]
MATERIALITY = [("emissions", 3.0), ("energy", 2.0), ("water", 2.0), ("waste", 2.0), ("biodiversity", 2.0), ("governance", 1.5)]
QUALITY_RANK = {"verified": 3, "self_reported": 2, "illustrative": 1, "unverified": 0}
NONZERO_ENDINGS = [".co2e", ".intensity", ".energy", ".volume", ".mass"]

# Signals in a sentence that correct an aspect, lower-cased text.
SIGNALS: dict[str, str] = {
    "scope1": r"\bscope\s*[- ]?1\b",
    "scope2": r"\bscope\s*[- ]?2\b",
    "scope3": r"\bscope\s*[- ]?3\b",
    "scope12": r"\bscope\s*1\s*and\s*(scope\s*)?2\b",
    "gender": r"\b(male|female|women|men|gender)\b",
    "waste": r"\b(waste|e-waste)\b",
    "water": r"\b(water|effluent|wastewater)\b",
    "future": r"\b(target|aim|aspire|commit|pledge|goal|will|by\s+20[2-9]\d)\b",
    "commitment": r"\b(we (have )?set a target|we pledged?|pledged|we aim to|we are committed to|we will \w+|expected to be \w+ed)\b|\bby\s+20[2-9]\d,?\s+we will\b",
    "air": r"\b(sox|nox|particulate matter|pm10|pm2\.5|air pollutant)",
    "discharge": r"\bdischarg",
    "destination": r"^\s*to\s+(surface\s*water|sea\s*water|seawater|ground\s*water|third\s*part)",
    "planting": r"\b(afforestation|reforestation|tree plant\w*|plantation)\b",
    "reuse": r"\b(reused|recycled|zero.liquid discharge|zld)\b",
    "nonrenewable": r"\b(non-?renewable|fuel consumption)\b",
    "total_energy": r"\btotal energy consum",
    "renewable": r"\brenewable\b",
    "heat_rate": r"\b(heat rate)\b|kcal\s*/\s*kwh",
    "posh": r"\b(posh|sexual harassment)\b",
    "rights": r"\bhuman rights\b",
    "union": r"\b(union|collective bargaining|freedom of association)\b",
    "csr": r"\b(csr|corporate social responsibility|beneficiaries)\b",
    "partners": r"\bvalue chain partners\b",
    "access": r"\b(wheelchair|assistive technolog|braille|differently.abled)\b",
    "offset": r"\b(carbon.?compensated|carbon credits?|carbon offsets?|emissions? offset)\b",
    "capture": r"\b(carbon capture|ccus|ccs)\b|\bco2\b[^.]*\bcaptured\b|\bcaptured\b[^.]*\bco2\b",
    "intensity": r"\b(net carbon intensity|carbon intensity|emissions? intensity)\b|gco2e\s*/\s*mj",
    "methane": r"\b(ogmp|methane)\b",
    "lng": r"\b(lng|liquefied natural gas)\b",
    "charging": r"\b(charge points|charging points|ev charging|charging stations)\b",
    "investment": r"\binvest\w*\b[^.]*\b(low.carbon|non.energy)|\b(low.carbon|non.energy)[^.]*\binvest\w*\b",
    "payments": r"\b(payments? to governments?|production entitlements)\b",
    "lobbying": r"\b(lobbying|transparency register)\b",
    "penalty": r"\b(administrative penalty|penalty of|fined)\b",
    "sif": r"\bserious injuries and fatalities\b",
    "ltifr": r"\b(ltifr|lost time injury)\b",
    "safety": r"\b(exposure hours|safety principles|process safety|assessments of assets|change impact assessments)\b",
    "suppliers": r"\bsuppliers\b",
    "emission_word": r"\bemissions?\b",
    "landfill": r"\blandfill",
    "incineration": r"\bincinerat",
    "recovery": r"\b(re-?used?|recycl\w*|recover\w*)\b",
    "pm": r"\b(particulate matter|pm\s?10|pm\s?2\.5)\b",
    "sox": r"\b(sox|so2|sulph?ur oxides?|oxides of sulph?ur)\b",
    "nox": r"\b(nox|nitrogen oxides?|oxides of nitrogen)\b",
    "voc": r"\b(vocs?|volatile organic)\b",
    "female": r"\b(female|women)\b",
    "male": r"\b(male|men)\b",
    "permanent": r"\bpermanent\b",
    "contractual": r"\b(contractual|other than permanent|contract workers?)\b",
    "employee": r"\b(employees?|workers?|workforce|headcount)\b",
    "question": r"\?\s*$",
    "form_label": r"^\s*(please specify|not applicable|if yes)",
    "disclose": r"\bdisclose\b",
    "count_label": r"^\s*(no\.|number)\s+of\b",
    "digit": r"\d",
}

# How a claim can be checked, by what can be observed of it.
METHODS = {"optical_possible": "imagery", "directly_observable": "data_crosscheck", "reported_metric": "data_crosscheck", "not_observable": "document_review"}
# Placeholders that stand for no value.
PLACEHOLDERS = ["", "null", "none", "n/a", "na", "nan", "unknown", "-"]
