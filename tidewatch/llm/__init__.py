"""Training-data operators: each takes DataFrames and returns DataFrames.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered
queries, the other modules the operators behind them.
"""
