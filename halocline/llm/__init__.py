"""Training-corpus operators: formatting, filtering, de-duplication, mixing and sharding of text.

Nothing outside this folder imports it.  `queries` holds the registered queries and their SQL."""
