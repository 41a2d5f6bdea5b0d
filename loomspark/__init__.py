"""loomspark: brand visibility, company scoring and workflow-graph analytics on Spark DataFrames."""
