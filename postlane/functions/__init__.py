"""Column expressions. All are native Spark expressions unless their docstring says otherwise."""
