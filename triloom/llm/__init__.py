"""Operators for preparing large text corpora: ten operators, their queries and their SQL.

Nothing outside this package imports it; ``queries.py`` lists what the entry module registers.
"""
