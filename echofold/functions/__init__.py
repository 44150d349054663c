"""Parameters, errors, hashes and numpy kernels."""
