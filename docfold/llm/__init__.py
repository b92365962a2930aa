"""Training-data operators: cleaning, deduplication, tokenisation and packing of text corpora.

Nothing outside this subpackage imports it. Every operator takes a DataFrame, names its id
and text columns by parameter and returns a DataFrame; rows stay partitioned throughout.
"""
