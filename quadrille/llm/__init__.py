"""Operators on free text: canonical mapping, tokenizer encoding, leakage and truncation. Nothing outside imports this."""
