"""Job postings as Spark tables: collect, resolve, age, search, score, account."""
