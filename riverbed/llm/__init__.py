"""Training-data operators: quality, near duplicates, personal data, secrets, language, tokens, search, licences, mixing."""
