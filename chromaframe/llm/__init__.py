"""Training-data operators: secrets, sharding, chat formatting, URL filters, packing,
decontamination, exact and near deduplication, and toxicity.

Nothing outside this subpackage imports it.
"""
