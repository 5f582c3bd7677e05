"""Every registered query."""

from __future__ import annotations

from ledgerline.plans.fundamentals import fundamentals
from ledgerline.plans.landing import landing
from ledgerline.plans.listing import listed
from ledgerline.plans.market import market
from ledgerline.plans.modelling import modelling
from ledgerline.plans.serving import served
from ledgerline.plans.ticks import ticks

CATALOGS = [market, landing, served, listed, fundamentals, modelling, ticks]


def all_queries() -> dict:
    return {name: fn for catalog in CATALOGS for name, fn in catalog.queries.items()}


def all_oracles() -> dict:
    return {name: sql for catalog in CATALOGS for name, sql in catalog.oracles.items()}
