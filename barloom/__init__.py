"""Price-bar analytics on Spark: bars, indicators, rules, books and their statistics."""
