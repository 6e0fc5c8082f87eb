"""Table operators: DataFrame in, tidy DataFrame out."""
