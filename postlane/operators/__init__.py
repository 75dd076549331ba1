"""Relational building blocks: order, state, scoring, host health, search plans."""
