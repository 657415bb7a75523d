"""Training-data operators: near-duplicates, decontamination, language, mixing, licences,
main-text extraction, secrets and personal data. Nothing outside this package imports it."""
