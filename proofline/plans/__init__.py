"""Compositions of operators: reports, pre-flight and the optimise chain."""
