"""Made-up input of queries and tests; no part of the library."""
