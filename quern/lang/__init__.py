"""Surface language: syntax tree, parser and rewriting passes."""
