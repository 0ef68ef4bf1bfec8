"""Training-data operators (ten numbered operators and their queries).

Self-contained: nothing outside this folder imports it.
"""
