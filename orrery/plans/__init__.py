"""From T-SQL text to Spark SQL: lexer, parser, syntax tree, lowering; and the registered queries."""
