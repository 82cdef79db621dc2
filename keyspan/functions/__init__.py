"""Column expressions: scalars, arrays, strings, paths, options, results, versions, decoding."""
