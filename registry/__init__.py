"""The registered queries: the library's operators over the given tables, with equivalent SQL."""
