"""DataFrame operators: every function takes and returns DataFrames and triggers no job unless its docstring says so."""
