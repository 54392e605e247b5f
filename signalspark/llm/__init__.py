"""Training-data operators: token counts, decontamination, licences, near duplicates, chat formatting,
language-model scoring, language identification, mixing, vector search and secret scans.

Nothing else in the library imports this subpackage.
"""
