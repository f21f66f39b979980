"""Column expressions and small dense kernels."""
