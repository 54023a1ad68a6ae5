"""Importing this registers every query."""

from queries import accounts, atoms, bars, books, by_hand, combine, compare, expressions, indicators, lots, names, portfolio, rebalance, rules, stats, streams  # noqa: F401
