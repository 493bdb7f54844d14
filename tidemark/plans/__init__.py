"""Registered queries and the SQL each one is checked against."""

from tidemark.plans import corpus, ledger, lifecycle, replay, stores

MODULES = (corpus, ledger, lifecycle, replay, stores)
