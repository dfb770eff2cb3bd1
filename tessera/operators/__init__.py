"""Relational operators: views, predicates, joins, upserts and windows over operational tables."""
