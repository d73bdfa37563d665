"""DuckDB SQL that computes each query's expected result independently of the Spark code."""
