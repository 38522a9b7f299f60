"""The study as a lazy plan, the registered queries and their SQL oracle."""
