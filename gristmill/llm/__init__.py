"""Training-data operators: fingerprints, near-duplicates, packing, archives and scans.

Nothing outside this subpackage imports it; ``gristmill.llm.queries`` holds the queries it registers.
"""
