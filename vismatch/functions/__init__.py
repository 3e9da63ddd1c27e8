"""Column functions: paths and ids, geometry, vectors, scores; numpy kernels for pixels."""
