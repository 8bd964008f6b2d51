"""Record-linkage operators: DataFrame to DataFrame."""
