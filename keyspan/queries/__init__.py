"""The registered queries with their SQL, one module for each family of operators."""
