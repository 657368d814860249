"""Column builders: character semantics, span folds, pattern scans."""
