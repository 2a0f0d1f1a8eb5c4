"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from plumbline.plans.levels import levels
from plumbline.plans.measurements import measurements
from plumbline.plans.merges import merges
from plumbline.plans.networks import networks
from plumbline.plans.outputs import outputs
from plumbline.plans.plannings import plannings
from plumbline.plans.records import records
from plumbline.plans.registry import Query
from plumbline.plans.reviews import reviews
from plumbline.plans.shapes import shapes
from plumbline.plans.simulations import simulations
from plumbline.plans.studies import studies
from plumbline.plans.texts import texts

_ALL = (levels, measurements, merges, networks, plannings, records, reviews, shapes, simulations, studies, texts, outputs)


def queries() -> dict[str, Query]:
    return {k: v for r in _ALL for k, v in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for r in _ALL for k, v in r.sql.items()}
