"""Column functions: paths, names, escapes and globs."""
