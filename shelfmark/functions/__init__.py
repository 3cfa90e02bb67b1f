"""Column expressions: everything here is a pure function of columns and stays inside codegen."""
