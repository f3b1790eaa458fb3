"""Column functions: everything here is a native Spark expression unless it says so."""
