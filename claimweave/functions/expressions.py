"""Column logic as SQL expressions, generated from the vocabularies.

Every function takes the SQL of its inputs and gives the SQL of its result; ``F.expr`` makes a column of
it. Patterns are matched on lower-cased text.
"""

from __future__ import annotations

from claimweave.functions import vocabulary as V


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def matches(column: str, pattern: str) -> str:
    return f"regexp_like({column}, r'{pattern}')"


def any_of(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(p)})" for p in phrases) + ")"


def first(cases: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {otherwise} END"


def signal(name: str, sentence: str) -> str:
    return matches(sentence, V.SIGNALS[name])


def metric_family(aspect: str) -> str:
    """The first two segments of a node."""
    return f"CASE WHEN coalesce({aspect}, '') IN ('', 'uncategorized') THEN 'uncategorized' ELSE concat_ws('.', split_part({aspect}, '.', 1), CASE WHEN split_part({aspect}, '.', 2) <> '' THEN split_part({aspect}, '.', 2) END) END"


def dimension(unit: str) -> str:
    """Physical dimension of a unit, ``unspecified`` for none."""
    u = f"lower(trim(coalesce({unit}, '')))"
    return first([(f"{u} IN ('', 'unspecified', 'none', 'null')", "'unspecified'")] + [(any_of(u, k), text(d)) for d, k in V.DIMENSIONS], "'unspecified'")


def plausible(aspect: str, dim: str) -> str:
    """Whether a dimension makes sense for an aspect; unknown ones do."""
    cases = [(f"{dim} = 'unspecified'", "TRUE")]
    for family, allowed in V.PLAUSIBLE:
        cases.append((f"({aspect} = {text(family)} OR {aspect} LIKE {text(family + '.%')})", f"{dim} IN ({', '.join(map(text, allowed))})"))
    return first(cases, "TRUE")


def metric_key(aspect: str, dim: str) -> str:
    return f"CASE WHEN coalesce({aspect}, '') IN ('', 'uncategorized') THEN 'uncategorized' WHEN {plausible(aspect, dim)} THEN concat({aspect}, '.', {dim}) ELSE concat({aspect}, '.unspecified') END"


def _cadence(unit: str) -> str:
    u = f"lower(trim({unit}))"
    return first([(f"{u} LIKE {text('%' + c)}", f"trim(left({u}, length({u}) - {len(c)}))") for c in V.CADENCES], u)


def unit_stem(unit: str) -> str:
    """The unit in lower case without an ending that says how often it is reported."""
    return _cadence(unit)


def _unit_rules(u: str) -> list[tuple[str, str, str]]:
    """(condition, canonical unit, factor) for a unit stem that is no exact spelling."""
    rules = [
        (f"({any_of(u, ['co2', 'ghg'])})", "tCO2e", first([(any_of(u, ["ktco2", "kt co2", "kilotonne"]), "1e3"), (any_of(u, ["mtco2", "mt co2", "megatonne"]), "1e6"), (any_of(u, ["kgco2", "kg co2", "kilogram"]), "1e-3"), (f"(contains({u}, 'gco2') OR {matches(u, r'\bg(ram)?s?\b')})", "1e-6")], "1e0")),
        (f"({any_of(u, ['tonne', 'tons'])} OR {u} = 'ton')", "tonnes", first([(any_of(u, ["ktonne", "kilotonne"]), "1e3"), (f"contains({u}, 'megatonne')", "1e6")], "1e0")),
        (f"contains({u}, 'wh')", "MWh", first([(f"contains({u}, 'twh')", "1e6"), (f"contains({u}, 'gwh')", "1e3"), (f"contains({u}, 'kwh')", "1e-3")], "1e0")),
        (f"contains({u}, 'joule')", "MWh", first([(f"contains({u}, 'peta')", "277777.8e0"), (f"contains({u}, 'tera')", "277.7778e0"), (f"contains({u}, 'giga')", "0.2777778e0"), (f"contains({u}, 'mega')", "2.777778e-4")], "2.777778e-10")),
        (any_of(u, ["hectare", "acre"]), "hectares", first([(f"contains({u}, 'acre')", "0.404686e0")], "1e0")),
        (any_of(u, ["km2", "km²", "sq km", "square kilomet"]), "hectares", "1e2"),
        (f"contains({u}, 'square met')", "hectares", "1e-4"),
        (any_of(u, ["barrel", "bbl"]), "m3", "0.158987e0"),
        (f"contains({u}, 'gallon')", "m3", "3.78541e-3"),
        (f"contains({u}, 'cubic met')", "m3", "1e0"),
        (any_of(u, ["litre", "liter"]), "m3", "1e-3"),
    ]
    return rules


def _number(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def canonical_unit(unit: str, stem: str) -> str:
    """Canonical unit: by exact spelling, the unit itself for ratios and unknown ones, else by rule; null
    for an empty unit."""
    exact = [(f"{stem} IN ({', '.join(map(text, k))})", text(base)) for base, _, k in V.CONVERSIONS]
    ratio = [(f"contains({stem}, '/') OR contains({stem}, ' per ')", unit)]
    rules = [(c, text(base)) for c, base, _ in _unit_rules(stem)]
    return first([(f"coalesce(trim({unit}), '') = ''", "NULL")] + exact + ratio + rules, unit)


def canonical_factor(unit: str, stem: str) -> str:
    """What a value is multiplied by to be in the canonical unit."""
    exact = [(f"{stem} IN ({', '.join(map(text, k))})", _number(f)) for _, f, k in V.CONVERSIONS]
    ratio = [(f"contains({stem}, '/') OR contains({stem}, ' per ')", "1e0")]
    scale = first([(f"contains({stem}, {text(w)})", _number(m)) for w, m in V.MAGNITUDES], "1e0")
    rules = [(c, f"({f}) * ({scale})") for c, _, f in _unit_rules(stem)]
    return first([(f"coalesce(trim({unit}), '') = ''", "1e0")] + exact + ratio + rules, "1e0")


def value_plausible(key: str, value: str) -> str:
    """Whether a value has the shape that its metric key asks for."""
    count = " OR ".join(f"{key} LIKE '%{e}'" for e in (".count", ".headcount", ".fatalities", ".injuries", ".incidents"))
    return first(
        [
            (f"{key} IS NULL OR {value} IS NULL", "TRUE"),
            (f"{key} LIKE '%.percent'", f"{value} BETWEEN -100 AND 1000"),
            (count, f"{value} >= 0 AND abs({value} - floor({value} + 0.5)) < 0.01"),
            (f"{key} LIKE '%.rate'", f"{value} BETWEEN 0 AND 10000"),
        ],
        "TRUE",
    )


def classify_type(action: str, sentence: str) -> str:
    a, s = f"lower(coalesce({action}, 'reported'))", f"lower(coalesce({sentence}, ''))"
    names = lambda verbs: ", ".join(map(text, verbs))
    return first([(f"{a} IN ({names(V.TARGET_VERBS)})", "'target'"), (f"{a} IN ({names(V.PERFORMANCE_VERBS)})", "'performance'"), (any_of(s, V.TARGET_VERBS), "'target'"), (any_of(s, V.PERFORMANCE_VERBS), "'performance'")], "'narrative'")


def direction(context: str) -> str:
    return first([(f"contains(lower({context}), {text(k)})", text(d)) for k, d in V.DIRECTIONS], "NULL")


def vagueness(value: str, time: str, place: str, kind: str) -> str:
    """0 to 1 in hundredths: no metric, time or place, and what kind of claim it is."""
    tenths = f"CASE WHEN {value} IS NULL THEN 5 ELSE 0 END + CASE WHEN {time} IS NULL THEN 3 ELSE 0 END + CASE WHEN {place} IS NULL THEN 2 ELSE 0 END + CASE lower(coalesce({kind}, '')) WHEN 'narrative' THEN 2 WHEN 'target' THEN 1 ELSE 0 END"
    return f"least({tenths}, 10) / 10e0"


def observability(value: str, time: str, place: str, aspect: str) -> str:
    return first([(any_of(f"lower(coalesce({aspect}, ''))", V.OBSERVABLE), "'optical_possible'"), (f"{value} IS NOT NULL AND {time} IS NOT NULL AND {place} IS NOT NULL", "'directly_observable'"), (f"{value} IS NOT NULL", "'reported_metric'")], "'not_observable'")


def groundability(value: str, time: str, place: str, scope: str, seen: str, kind: str) -> str:
    """0 to 1: evidence points over 2.5, at most 1, weighted by the kind of claim; in hundredths."""
    where = f"CASE WHEN {place} IS NULL THEN 0 ELSE CASE {scope} WHEN 'facility' THEN 100 WHEN 'city' THEN 75 WHEN 'region' THEN 75 WHEN 'country' THEN 50 ELSE 15 END END"
    points = f"(CASE WHEN {value} IS NULL THEN 0 ELSE 100 END + CASE WHEN {time} IS NULL THEN 0 ELSE 100 END + {where} + CASE WHEN {seen} = 'optical_possible' THEN 100 ELSE 0 END)"
    weight = f"CASE lower(coalesce({kind}, '')) WHEN 'performance' THEN 10 WHEN 'target' THEN CASE WHEN {seen} = 'optical_possible' THEN 7 ELSE 6 END ELSE CASE WHEN {seen} = 'optical_possible' THEN 7 ELSE 5 END END"
    return f"floor(least({points}, 250) * ({weight}) / 25e0 + 0.5e0) / 100e0"


def polarity(key: str) -> str:
    k = f"coalesce({key}, '')"
    starts = lambda ps: " OR ".join(f"{k} LIKE {text(p + '%')}" for p in ps)
    return first([(starts(V.LOWER_BETTER), "'lower_better'"), (starts(V.HIGHER_BETTER), "'higher_better'")], "'neutral'")


def materiality(key: str) -> str:
    return first([(f"coalesce({key}, '') LIKE {text(p + '%')}", _number(w)) for p, w in V.MATERIALITY], "1e0")


def artefact_zero(key: str, value: str) -> str:
    return f"({value} = 0 AND (" + " OR ".join(f"{key} LIKE {text('%' + e)}" for e in V.NONZERO_ENDINGS) + "))"


def verification_method(seen: str, value: str) -> str:
    return first([(f"lower(trim(coalesce({seen}, ''))) = {text(k)}", text(v)) for k, v in V.METHODS.items()], f"CASE WHEN {value} IS NOT NULL THEN 'data_crosscheck' ELSE 'document_review' END")


def grade(score: str) -> str:
    return first([(f"{score} >= 85", "'A'"), (f"{score} >= 70", "'B'"), (f"{score} >= 55", "'C'"), (f"{score} >= 40", "'D'")], "'F'")


def furniture(sentence: str, value: str, source: str) -> str:
    """Whether a text claim is a form question or a bare label. ``sentence`` is trimmed and lower-cased."""
    s = sentence
    label = f"NOT {signal('digit', s)} AND ({signal('count_label', s)} OR (length({s}) < 80 AND {value} IS NOT NULL))"
    return f"({source} <> 'table' AND ({s} = '' OR {signal('question', s)} OR {signal('form_label', s)} OR {signal('disclose', s)} OR ({label})))"


def fixed_type(kind: str, sentence: str, value: str, source: str) -> str:
    """The type of a claim after correction."""
    s = sentence
    return first(
        [
            (f"{source} = 'table' AND {value} IS NULL", kind),
            (f"{source} = 'table'", f"CASE WHEN {signal('future', s)} THEN 'target' ELSE 'performance' END"),
            (f"{kind} = 'target' AND NOT {signal('future', s)}", "'narrative'"),
            (f"{kind} IN ('performance', 'narrative') AND {signal('commitment', s)}", "'target'"),
            (f"{kind} = 'narrative' AND {value} IS NOT NULL AND NOT {signal('future', s)} AND {signal('digit', s)}", "'performance'"),
            (f"{kind} = 'performance' AND {value} IS NOT NULL AND NOT {signal('digit', s)}", "'narrative'"),
        ],
        kind,
    )


def aspect_rules(a: str, s: str) -> list[tuple[str, str, str]]:
    """(guard, node, flag) in order: the first guard that holds decides, even where the node stays."""
    has = lambda name: signal(name, s)
    under = lambda *roots: "(" + " OR ".join([f"{a} LIKE {text(r + '%')}" for r in roots] + [f"{a} = 'uncategorized'"]) + ")"
    e = under("emissions")
    kinds = {"pm": has("pm"), "sox": has("sox"), "nox": has("nox"), "voc": has("voc")}
    count = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in kinds.values())
    pollutant = f"CASE WHEN {count} = 1 THEN " + first([(c, text(f"emissions.air_pollutants.{k}")) for k, c in kinds.items()], "NULL") + " ELSE 'emissions.air_pollutants' END"
    rules = [
        (f"{e} AND (({has('scope1')} AND {has('scope2')}) OR {has('scope12')})", "'emissions.total'", "scope_fixed"),
        (f"{e} AND {has('scope1')}", "'emissions.scope1'", "scope_fixed"),
        (f"{e} AND {has('scope2')}", "'emissions.scope2'", "scope_fixed"),
        (f"{e} AND {has('scope3')}", "'emissions.scope3'", "scope_fixed"),
        (f"{e} AND ({' OR '.join([has('air'), *kinds.values()])})", pollutant, "aspect_fixed"),
    ]
    plain = [
        (under("emissions", "energy"), "offset", "emissions.offsets"), (under("emissions", "energy"), "capture", "emissions.ccs"), (e, "intensity", "emissions.intensity"), (e, "methane", "emissions.methane"),
        (under("energy"), "lng", "energy.supply"), (under("energy"), "charging", "energy.ev_charging"), ("TRUE", "investment", "energy.investment"),
        ("TRUE", "payments", "governance.payments_to_governments"), ("TRUE", "lobbying", "governance.lobbying"), (under("governance"), "penalty", "governance.compliance"),
    ]
    rules += [(f"{scope} AND {has(name)}", text(node), "aspect_fixed") for scope, name, node in plain]
    chain = f"CASE WHEN {a} IN ('social.supply_chain', 'social.supply_chain.training') THEN {a} ELSE 'social.supply_chain' END"
    rules.append((f"{under('emissions', 'social')} AND {has('suppliers')} AND NOT {has('emission_word')}", chain, "aspect_fixed"))
    social = under("social")
    rules += [(f"{social} AND {has(n)}", text(node), "aspect_fixed") for n, node in (("ltifr", "social.health_safety.ltifr"), ("sif", "social.health_safety.sif"), ("safety", "social.health_safety"))]
    rules.append((f"{under('energy', 'emissions')} AND {has('heat_rate')}", "'energy.efficiency'", "aspect_fixed"))
    rules.append((f"{under('energy')} AND ({has('nonrenewable')} OR ({has('total_energy')} AND NOT {has('renewable')}))", "'energy.total'", "aspect_fixed"))
    rules.append((f"{under('water')} AND ({has('discharge')} OR {has('destination')})", f"CASE WHEN {has('reuse')} THEN 'water.recycled' ELSE 'water.discharge' END", "aspect_fixed"))
    rules.append((f"{a} = 'uncategorized' AND {has('planting')}", "'biodiversity.conservation'", "aspect_fixed"))
    gaps = [("posh", "social.posh_complaints"), ("access", "social.accessibility"), ("rights", "social.human_rights"), ("partners", "social.supply_chain.training"), ("union", "social.labor_relations"), ("csr", "social.community")]
    rules += [(f"{social} AND {has(n)}", text(node), "aspect_fixed") for n, node in gaps]
    cohort = f"CASE WHEN {has('female')} AND NOT {has('male')} THEN 'social.diversity.gender.female' WHEN {has('male')} AND NOT {has('female')} THEN 'social.diversity.gender.male' ELSE 'social.diversity.gender' END"
    rules.append((f"{under('biodiversity', 'social.workforce', 'social.diversity.gender')} AND {has('gender')}", cohort, "gender_fixed"))
    staff = f"({a} LIKE 'social.workforce%' OR ({a} = 'uncategorized' AND {has('employee')}))"
    rules.append((f"{staff} AND {has('contractual')} AND {a} <> 'social.workforce.contractual'", "'social.workforce.contractual'", "aspect_fixed"))
    rules.append((f"{staff} AND NOT {has('contractual')} AND {has('permanent')} AND {a} <> 'social.workforce.permanent'", "'social.workforce.permanent'", "aspect_fixed"))
    return rules


def aspect_rule(aspect: str, sentence: str) -> str:
    """Number of the rule that decides an aspect, null if none does."""
    return first([(g, str(i)) for i, (g, _, _) in enumerate(aspect_rules(aspect, sentence))], "NULL")


def ruled_aspect(rule: str, aspect: str, sentence: str) -> str:
    """The node that the deciding rule gives; without one, waste taken for water is put right."""
    swap = f"CASE WHEN {aspect} LIKE 'water%' AND {signal('waste', sentence)} AND NOT {signal('water', sentence)} THEN 'waste.total' ELSE {aspect} END"
    return f"CASE {rule} " + " ".join(f"WHEN {i} THEN {node}" for i, (_, node, _) in enumerate(aspect_rules(aspect, sentence))) + f" ELSE {swap} END"


def waste_route(rule: str, ruled: str, sentence: str) -> str:
    """Where no rule decided, a waste node goes to its disposal route if exactly one is named."""
    routes = {"waste.landfilled": signal("landfill", sentence), "waste.incinerated": signal("incineration", sentence), "waste.recycled": signal("recovery", sentence)}
    count = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in routes.values())
    return f"CASE WHEN {rule} IS NULL AND {ruled} LIKE 'waste%' AND {count} = 1 THEN " + first([(c, text(n)) for n, c in routes.items()], "NULL") + f" ELSE {ruled} END"


def aspect_flag(rule: str) -> str:
    flags = [f for _, _, f in aspect_rules("a", "s")]
    return f"CASE WHEN {rule} IS NULL THEN NULL " + " ".join(f"WHEN {rule} IN ({', '.join(str(i) for i, x in enumerate(flags) if x == f)}) THEN {text(f)}" for f in dict.fromkeys(flags)) + " END"
