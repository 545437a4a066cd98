"""Operators for preparing training text: ten independent modules and the queries that apply them."""
