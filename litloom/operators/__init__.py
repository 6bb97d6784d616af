"""Relational and analytic operators; every public function maps DataFrames to DataFrames."""
