"""From MySQL text to plans: lexing, expression rewriting, statements."""
