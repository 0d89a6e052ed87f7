"""Index builders and query operators: DataFrame in, DataFrame out."""
