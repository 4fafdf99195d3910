"""Training-data operators: language, chat, decontamination, archives, toxicity, packing, secrets, joins, ids, quality."""
