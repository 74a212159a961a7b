"""Training-data operators (decontamination, dedup, quality, tokenisation...).

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
