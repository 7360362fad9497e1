"""Relational and temporal operators over DataFrames."""
