"""Types and scalar expressions as Spark columns."""
