"""Column expressions and fixed names shared by the operators."""
