"""millrace: batch analytics over DataFrames - text, index, relational, graph and learning operators."""
