"""Rules, keyed aggregates and other relational operators."""
