"""Typed Datalog on Spark: programs are compiled to DataFrame plans."""
