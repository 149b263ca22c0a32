"""Compositions of operators into whole jobs, and checks of their plans."""
