"""SQL text for the comparison engine."""

from __future__ import annotations

import re

from claimweave.functions import vocabulary as V
from claimweave.operators.claims import ENRICHED, GATED
from claimweave.sources.tables import CLAIMS_SQL


def portable(sql: str) -> str:
    """Spark's names and literals to those of the comparison engine."""
    return re.sub(r", r'", ", '", sql.replace("regexp_like(", "regexp_matches("))


def steps(name: str, source: str, columns: list[tuple[str, str]]) -> str:
    """CTEs that add columns one after another to ``source``, the last of them called ``name``."""
    out, last = [], source
    for i, (column, sql) in enumerate(columns):
        now = name if i == len(columns) - 1 else f"{name}_{i}"
        out.append(f"{now} AS MATERIALIZED (SELECT *, {portable(sql)} AS {column} FROM {last})")
        last = now
    return ", ".join(out)


CLAIMS = f"claims AS ({CLAIMS_SQL.replace('{lineitem}', 'lineitem')})"
ENRICH = f"{CLAIMS}, {steps('enriched', 'claims', ENRICHED)}"
_NUMBERS = r"list_transform(regexp_extract_all(source_sentence, '\d[\d,]*(?:\.\d+)?'), lambda t: CAST(replace(t, ',', '') AS DOUBLE))"
_INVENTED = f"CASE WHEN metric_value IS NOT NULL AND source_type <> 'table' AND len(list_filter({_NUMBERS}, lambda f: f = metric_value OR (f <> 0 AND abs(f - metric_value) / abs(f) < 1e-9))) = 0 THEN 'value_not_in_source' END"
GATE = f"{ENRICH}, {steps('ruled_claims', 'enriched', GATED)}, gated AS (SELECT *, list_filter([aspect_flag, route_flag, type_flag, {_INVENTED}, unit_flag], lambda f: f IS NOT NULL) AS quality_flags FROM ruled_claims WHERE NOT is_furniture)"
GATE_ALL = GATE.replace(" WHERE NOT is_furniture)", ")")
#: The taxonomy as rows.
PHRASES = "(VALUES " + ", ".join(f"({i}, '{n}', '{p}')" for i, (n, ps) in enumerate(V.TAXONOMY.items()) for p in ps) + ") AS t(place, node, phrase)"
