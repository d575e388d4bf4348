"""DataFrame operators: profiling, windows, features, selection, models,
validation, scoring and diagnostics."""
