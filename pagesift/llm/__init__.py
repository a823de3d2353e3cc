"""Training-data operators: language ID, packing, decontamination, extraction, dedup, scoring.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
