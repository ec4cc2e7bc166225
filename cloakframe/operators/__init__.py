"""DataFrame operators: scope, detection, rewriting, mapping, audit."""
