"""From text to a bound query: words, syntax tree, parser, binder and EXPLAIN."""
