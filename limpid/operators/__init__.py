"""Table operators: DataFrame in, DataFrame (or a few numbers per column) out."""
