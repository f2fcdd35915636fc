"""Training-data operators: packing, de-duplication, search, sharding, text
classification and extraction.  Nothing outside this folder imports it."""
