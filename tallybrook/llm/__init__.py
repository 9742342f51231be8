"""Training-data operators: tokens, secrets, chat, near copies, toxicity, WARC, URLs."""
