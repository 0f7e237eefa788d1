"""From rules to DataFrames: schemas, rule plans and fixpoints."""
