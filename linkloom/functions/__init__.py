"""Column expressions and small scalar kernels."""
