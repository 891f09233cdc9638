"""The Cypher subset: lexer, parser, compiler to DataFrame plans."""
