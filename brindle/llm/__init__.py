"""Operators that prepare training data: fingerprints, archives, duplicates, tokens, personal data, licences, toxicity, mixing."""
