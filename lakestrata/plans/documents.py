"""Jobs built from the JSON documents that describe them; `json.load` is all they need before.

Single documents have their own constructors too: `Contract.from_dict`, `rules_for` and
`Governance.from_dict`.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from lakestrata.functions.columns import quoted
from lakestrata.operators.contract import Contract
from lakestrata.operators.quality import RuleDocument
from lakestrata.operators.steps import AggSpec, LayerStep, Step, template_step
from lakestrata.plans.daily import DailyJob


def step_from_template(template: Mapping[str, Any], parameters: Mapping[str, Any]) -> Step:
    """A step from a template document: its SQL with names quoted and values bound.

    The clauses of an aggregate template are made from its parameters: the columns to group by, and a
    function call for each aggregate, of the functions that `AggSpec` knows.
    """
    logic = template.get("logic", {})
    if logic.get("sql_template"):
        return template_step(with_clauses(logic["sql_template"], parameters), parameters)
    if logic.get("sql"):
        return template_step(logic["sql"], parameters)
    raise NotImplementedError("the template has neither sql nor sql_template")


def with_clauses(sql: str, parameters: Mapping[str, Any]) -> str:
    """The text of an aggregate template with its two clauses written out."""

    def name(column: str) -> str:
        return quoted(column).replace("{", "{{").replace("}", "}}")

    specs = [AggSpec(item["source_column"], item["function"], item["target_column"]) for item in parameters["aggregation_specs"]]
    clauses = {
        "group_by_clause": ", ".join(map(name, parameters["group_by_columns"])),
        "aggregation_clause": ", ".join(f"{spec.function.lower()}({name(spec.source)}) AS {name(spec.target)}" for spec in specs),
    }
    return re.sub(r"\{(group_by_clause|aggregation_clause)\}", lambda match: clauses[match[1]], sql)


def steps_from_definition(definition: Mapping[str, Any], templates: Mapping[str, Mapping[str, Any]]) -> list[LayerStep]:
    """The steps of a job definition, in order; `templates` maps a template id to its document."""
    return [
        LayerStep(
            step_from_template(templates[item["template_id"]], item["parameters"]),
            item.get("target_layer_step", "silver"),
        )
        for item in definition["processing"]["transformations"]
    ]


def job_from_documents(
    definition: Mapping[str, Any],
    contract: Mapping[str, Any],
    rules: Mapping[str, Any],
    templates: Mapping[str, Mapping[str, Any]],
    layers: Mapping[str, Sequence[str]],
    root: str,
    checked_layer: str = "silver",
    **more: Any,
) -> DailyJob:
    """A daily job from its definition, contract, rules and templates; `layers` names the columns of each layer.

    Relative places are the documents' own; `more` sets what they do not say, or puts another value in place.
    """
    metadata, source = definition["metadata"], definition["source_config"]["bronze"]
    handling = definition.get("error_handling", {}).get("quarantine_config", {})
    checks = RuleDocument.from_dict(rules)
    given = {
        "pipeline_id": metadata["pipeline_id"],
        "domain": metadata["domain"],
        "version": metadata.get("version", "unknown"),
        "contract": Contract.from_dict(contract, layers),
        "steps": steps_from_definition(definition, templates),
        "rules": checks.rules(checked_layer),
        "landing": source["location"],
        "landing_format": source.get("format", "csv"),
        "expected_interval_hours": source.get("freshness_rules", {}).get("expected_interval_hours", 24),
        "allow_partial_success": checks.allow_partial_success,
        "quarantine_enabled": handling.get("enabled", True),
        "quarantine_path": handling.get("path"),
        "checked_layer": checked_layer,
        "root": root,
    }
    return DailyJob(**(given | more))
